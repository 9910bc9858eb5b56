"""Attitude matrices as row-major 9-element arrays, and their Euler angles."""
from pyspark.sql import Column, functions as F

LOCK = 1e-9


def _el(dcm: Column, row: int, col: int) -> Column:
    return dcm[3 * row + col]


def _pitch(sine: Column) -> Column:
    half = F.lit(1.5707963267948966)
    return F.when(sine >= 1.0, half).when(sine <= -1.0, -half).otherwise(F.asin(sine))


def to_euler(dcm: Column, order: str = "body2nav") -> dict[str, Column]:
    """roll, pitch and yaw of a matrix.

    ``zyx`` and ``body2nav`` read a body-to-navigation matrix, ``xyz`` and
    ``nav2body`` its transpose.  The dictionary's order is the angle order of
    the named convention.
    """
    half = F.lit(1.5707963267948966)
    if order in ("zyx", "body2nav"):
        pitch = _pitch(-_el(dcm, 2, 0))
        locked = F.abs(F.abs(pitch) - half) < LOCK
        roll = F.when(locked, F.lit(0.0)).otherwise(F.atan2(_el(dcm, 2, 1), _el(dcm, 2, 2)))
        yaw = F.when(locked, F.atan2(_el(dcm, 0, 1), _el(dcm, 1, 1))).otherwise(
            F.atan2(_el(dcm, 1, 0), _el(dcm, 0, 0)))
    elif order in ("xyz", "nav2body"):
        pitch = _pitch(-_el(dcm, 0, 2))
        locked = F.abs(F.abs(pitch) - half) < LOCK
        roll = F.when(locked, F.atan2(_el(dcm, 1, 0), _el(dcm, 1, 1))).otherwise(
            F.atan2(_el(dcm, 1, 2), _el(dcm, 2, 2)))
        yaw = F.when(locked, F.lit(0.0)).otherwise(F.atan2(_el(dcm, 0, 1), _el(dcm, 0, 0)))
    else:
        raise ValueError(f"unsupported angle order {order!r}")
    if order == "zyx":
        return {"yaw": yaw, "pitch": pitch, "roll": roll}
    return {"roll": roll, "pitch": pitch, "yaw": yaw}


def product(a: list[Column], b: list[Column]) -> list[Column]:
    """Row-major 3x3 matrix product."""
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j]
            for i in range(3) for j in range(3)]


def transpose(m: list[Column]) -> list[Column]:
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def elements(dcm: Column) -> list[Column]:
    return [dcm[i] for i in range(9)]


def _turn(axis: str, angle: Column) -> list[Column]:
    c, s, one, nil = F.cos(angle), F.sin(angle), F.lit(1.0), F.lit(0.0)
    return {"x": [one, nil, nil, nil, c, -s, nil, s, c],
            "y": [c, nil, s, nil, one, nil, -s, nil, c],
            "z": [c, -s, nil, s, c, nil, nil, nil, one]}[axis]


def from_euler(a1: Column, a2: Column, a3: Column, order: str = "zyx") -> Column:
    """Nine-element matrix of three angles.

    ``zyx`` takes (yaw, pitch, roll), ``body2nav`` takes (roll, pitch, yaw) and
    both give Rz(yaw) Ry(pitch) Rx(roll); ``xyz`` takes (roll, pitch, yaw) and
    gives Rx Ry Rz.
    """
    if order == "body2nav":
        a1, a3 = a3, a1
    if order in ("zyx", "body2nav"):
        cy, sy, cp, sp, cr, sr = (f(a) for a in (a1, a2, a3) for f in (F.cos, F.sin))
        return F.array(cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr,
                       sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr,
                       -sp, cp * sr, cp * cr)
    if order == "xyz":
        return F.array(*product(product(_turn("x", a1), _turn("y", a2)), _turn("z", a3)))
    raise ValueError(f"unsupported angle order {order!r}")


def tilt_corrected(dcm: Column, tx: Column, ty: Column, tz: Column,
                   true_rotation: bool = False) -> Column:
    """(I - sin m/m S - (1-cos m)/m^2 S^2) C, with S the cross-product matrix of
    the tilt vector and m its length.  ``true_rotation`` adds the squared term
    instead, which makes the factor an exact rotation."""
    m2 = tx * tx + ty * ty + tz * tz
    m = F.sqrt(m2)
    tiny = m <= 1e-8
    a = F.when(tiny, F.lit(0.0)).otherwise(F.sin(m) / m)
    b = F.when(tiny, F.lit(0.0)).otherwise((F.lit(1.0) - F.cos(m)) / m2)
    if true_rotation:
        b = -b
    nil = F.lit(0.0)
    skew = [nil, -tz, ty, tz, nil, -tx, -ty, tx, nil]
    square = product(skew, skew)
    factor = [F.lit(1.0 if i % 4 == 0 else 0.0) - a * skew[i] - b * square[i] for i in range(9)]
    return F.array(*product(factor, elements(dcm)))


# fixed values: names of the angle products, c/s = cosine/sine, r/p/y = roll/pitch/yaw
ANGLE_PRODUCTS = [
    "crcy", "cpcy", "crsy", "cpsy", "srcy", "spcy", "srsy", "spsy",
    "crcpcy", "srcpcy", "crspcy", "srspcy", "crcpsy", "srcpsy", "crspsy", "srspsy",
    "crcp", "srcp", "crsp", "srsp",
]


def angle_features(roll: Column, pitch: Column, yaw: Column) -> dict[str, Column]:
    """The attitude feature block: matrix elements column by column (of the
    navigation-to-body matrix), angle products, and sine and cosine of each."""
    angle = {"r": roll, "p": pitch, "y": yaw}
    trig = {"c": F.cos, "s": F.sin}
    nav2body = transpose(elements(from_euler(roll, pitch, yaw, "body2nav")))
    out = {f"dcm_{3 * j + i + 1}": nav2body[3 * i + j] for j in range(3) for i in range(3)}
    for name in ANGLE_PRODUCTS:
        value = None
        for f, a in zip(name[::2], name[1::2]):
            factor = trig[f](angle[a])
            value = factor if value is None else value * factor
        out[name] = value
    for word, a in (("roll", roll), ("pitch", pitch), ("yaw", yaw)):
        out[f"{word}_sin"], out[f"{word}_cos"] = F.sin(a), F.cos(a)
    return out

"""Finite differences and lags along a line."""
from pyspark.sql import Column, DataFrame, functions as F

from aerofield.operators.sequence import blockwise

REACH = {"backward": 2, "forward": 2, "central": 1, "central2": 1, "backward2": 3,
         "forward2": 3, "fourth": 2, "central4": 2}


def _shift(v: Column, w, k: int) -> Column:
    """The value ``k`` rows ahead (negative: behind)."""
    return F.lead(v, k).over(w) if k > 0 else F.lag(v, -k).over(w) if k < 0 else v


def unit_difference(v: Column, w, scheme: str = "central", pos: Column | None = None,
                    n: Column | None = None) -> Column:
    """Difference per sample step.  Ends use one-sided first differences; the
    fourth-difference scheme is zero there.  Too few rows or an unknown scheme
    give 0."""
    pos = F.col("pos") if pos is None else pos
    n = F.col("n_line") if n is None else n
    s = lambda k: _shift(v, w, k)
    first, last, zero = pos == 0, pos == n - 1, F.lit(0.0)
    step_on, step_back = s(1) - v, v - s(-1)
    if scheme == "backward":
        return F.when(n < 2, zero).when(first, step_on).otherwise(step_back)
    if scheme == "forward":
        return F.when(n < 2, zero).when(last, step_back).otherwise(step_on)
    if scheme in ("central", "central2"):
        return (F.when(n < 3, zero).when(first, step_on).when(last, step_back)
                .otherwise((s(1) - s(-1)) / 2.0))
    if scheme == "backward2":
        return (F.when(n < 4, zero).when(first, step_on).when(pos == 1, step_back)
                .otherwise((v * 3.0 - s(-1) * 4.0 + s(-2)) / 2.0))
    if scheme == "forward2":
        return (F.when(n < 4, zero).when(pos >= n - 2, step_back)
                .otherwise((s(1) * 4.0 - s(2) - v * 3.0) / 2.0))
    if scheme in ("fourth", "central4"):
        inner = (s(-2) - s(-1) * 4.0 + v * 6.0 - s(1) * 4.0 + s(2)) / 16.0
        return F.when((n < 5) | (pos < 2) | (pos >= n - 2), zero).otherwise(inner)
    return zero


# fixed values: least number of rows for each derivative scheme
DERIVATIVE_ROWS = {"central": 3, "forward": 2, "backward": 2, "fourth": 5}


def derivative(v: Column, dt: Column, w, scheme: str = "central",
               strict: bool = True) -> Column:
    """First derivative with (possibly varying) time steps.  A line shorter than
    the scheme needs is an error, or null if not ``strict``."""
    if scheme not in DERIVATIVE_ROWS:
        raise ValueError(f"unsupported scheme {scheme!r}")
    pos, n = F.col("pos"), F.col("n_line")
    s, d = (lambda k: _shift(v, w, k)), (lambda k: _shift(dt, w, k))
    first, last = pos == 0, pos == n - 1
    head, tail = (s(1) - v) / dt, (v - s(-1)) / dt
    central = (s(1) - s(-1)) / (d(1) + d(-1))
    if scheme == "central":
        out = F.when(first, head).when(last, tail).otherwise(central)
    elif scheme == "forward":
        out = F.when(last, tail).otherwise(head)
    elif scheme == "backward":
        out = F.when(first, head).otherwise((v - s(-1)) / d(-1))
    else:
        wide = (s(-2) - s(-1) * 8.0 + s(1) * 8.0 - s(2)) / (dt * 12.0)
        out = (F.when(first, head).when(last, tail)
               .when(pos == 1, (s(1) - s(-1)) / (dt + d(-1)))
               .when(pos == n - 2, (s(1) - s(-1)) / (dt + d(-1))).otherwise(wide))
    short = n < DERIVATIVE_ROWS[scheme]
    guard = (F.raise_error(F.lit(f"line too short for the {scheme} derivative")).cast("double")
             if strict else F.lit(None).cast("double"))
    return F.when(short, guard).otherwise(out)


def add_differences(df: DataFrame, columns: list[str], schemes: list[str]) -> DataFrame:
    reach = max(REACH.get(s, 0) for s in schemes)
    return blockwise(df, lambda w: {f"{c}_{s}": unit_difference(F.col(c), w, s)
                                    for c in columns for s in schemes}, reach, reach)


def add_derivatives(df: DataFrame, columns: dict[str, Column], dt: Column,
                    schemes: dict[str, str], strict: bool = True) -> DataFrame:
    """``schemes`` maps a suffix to a scheme: ``{"dot": "central", "dot4": "fourth"}``."""
    return blockwise(df, lambda w: {f"{n}_{suffix}": derivative(c, dt, w, scheme, strict)
                                    for n, c in columns.items()
                                    for suffix, scheme in schemes.items()}, 2, 2)


def add_lags(df: DataFrame, columns: list[str], depth: int = 3) -> DataFrame:
    """Lags 1..depth; rows without a predecessor that far keep their own value."""
    return blockwise(df, lambda w: {
        f"{c}_lag_{i}": F.when(F.col("pos") >= i, F.lag(c, i).over(w)).otherwise(F.col(c))
        for c in columns for i in range(1, depth + 1)}, before=depth)


def derivative_features(df: DataFrame, mags: list[str], dt: Column) -> DataFrame:
    """Derivatives of the magnetometers (central and fourth order), of the attitude
    angles and of their sine and cosine."""
    angles = {a: F.col(a) for a in ("roll", "pitch", "yaw")}
    trig = {f"{a}_{f.__name__}": f(F.col(a)) for a in angles for f in (F.sin, F.cos)}

    def build(w):
        out = {}
        for m in mags:
            out[f"{m}_dot"] = derivative(F.col(m), dt, w, "central")
            out[f"{m}_dot4"] = derivative(F.col(m), dt, w, "fourth")
        for n, c in {**angles, **trig}.items():
            out[f"{n}_fdm"] = derivative(c, dt, w, "central")
        return out
    return blockwise(df, build, 2, 2)

"""Linear aircraft-field model: design columns and coefficient layout.

The model writes the aircraft's disturbance of a scalar magnetometer as
permanent + induced + eddy-current parts of the vector field.
"""
import sys

from pyspark.sql import Column, functions as F

SCALE = 50000.0
DEFAULT_TERMS = ("permanent", "induced", "eddy")

# fixed values: block name -> accepted names, in block order
TERM_NAMES = {
    "p3": ("permanent", "p", "permanent3", "p3"),
    "i6": ("induced", "i", "induced6", "i6"),
    "i5": ("induced5", "i5"),
    "i3": ("induced3", "i3"),
    "e9": ("eddy", "e", "eddy9", "e9"),
    "e8": ("eddy8", "e8"),
    "e3": ("eddy3", "e3"),
    "f3": ("fdm", "f", "fdm3", "f3"),
    "b1": ("bias", "b"),
}
_AXES = "xyz"
_UPPER = [(a, b) for i, a in enumerate(_AXES) for b in _AXES[i:]]
_ALL = [(a, b) for a in _AXES for b in _AXES]
_SAME = [(a, a) for a in _AXES]


def block_of(term: str) -> str:
    for block, names in TERM_NAMES.items():
        if term == block or term in names:
            return block
    raise ValueError(f"unknown term {term!r}")


def term_blocks(terms) -> list[str]:
    """Blocks of a term list, in design order whatever the list order."""
    terms = [terms] if isinstance(terms, str) else list(terms)
    wanted = {block_of(t) for t in terms}
    if not wanted:
        raise ValueError("no terms given")
    return [b for b in TERM_NAMES if b in wanted]


def _pairs(block: str) -> list[tuple[str, str]]:
    kind, count = block[0], int(block[1:])
    full = _UPPER if kind == "i" else _ALL
    return _SAME if count == 3 else full[:count]


def term_names(terms=DEFAULT_TERMS) -> list[str]:
    """Column names of the design, block by block."""
    out = []
    for block in term_blocks(terms):
        kind = block[0]
        if kind == "p":
            out += [f"perm_{a}" for a in _AXES]
        elif kind == "f":
            out += [f"rate_{a}" for a in _AXES]
        elif kind == "b":
            out.append("bias")
        else:
            word = {"i": "ind", "e": "eddy"}[kind] + block[1:]
            out += [f"{word}_{a}{b}" for a, b in _pairs(block)]
    return out


def term_range(term: str, terms) -> range:
    """Positions of one block's coefficients in the model vector."""
    start = 0
    for block in term_blocks(terms):
        n = int(block[1:])
        if block == block_of(term):
            return range(start, start + n)
        start += n
    return range(0)


def design_columns(field: dict[str, Column], rate: dict[str, Column], total: Column,
                   terms=DEFAULT_TERMS, scale: float = SCALE) -> dict[str, Column]:
    """Design columns of a vector field, its change per sample and a total field.

    ``total`` is the vector's length, a scalar magnetometer or a map value; where
    it is 0 the machine epsilon stands in.
    """
    safe = F.when(total == 0, F.lit(sys.float_info.epsilon)).otherwise(total)
    unit = {a: field[a] / safe for a in _AXES}
    out: dict[str, Column] = {}
    for block in term_blocks(terms):
        kind = block[0]
        if kind == "p":
            values = [unit[a] for a in _AXES]
        elif kind == "i":
            values = [unit[a] * field[b] / scale for a, b in _pairs(block)]
        elif kind == "e":
            values = [unit[a] * rate[b] / scale for a, b in _pairs(block)]
        elif kind == "f":
            values = [rate[a] for a in _AXES]
        else:
            values = [F.lit(1.0)]
        out.update(zip(term_names([block]), values))
    return out


def coefficient_matrices(coef: list[float], terms, scale: float = SCALE) -> dict[str, list[float]]:
    """Model vector -> permanent 3-vector, symmetric induced and full eddy 3x3
    matrices (row-major).  Off-diagonal induced terms count twice in the vector."""
    blocks = term_blocks(terms)
    kinds = [b[0] for b in blocks]
    if "p" not in kinds or "i" not in kinds:
        raise ValueError("permanent and induced terms are required")
    if {"f", "b"} & set(kinds):
        raise ValueError("rate and bias terms have no matrix form")
    induced, eddy = [0.0] * 9, [0.0] * 9
    for b in blocks:
        values = [coef[i] for i in term_range(b, terms)]
        if b[0] == "p":
            permanent = values
            continue
        for (a, c), v in zip(_pairs(b), values):
            i, j = _AXES.index(a), _AXES.index(c)
            if b[0] == "e":
                eddy[3 * i + j] = v / scale
            else:
                v = v / scale if i == j else v / scale / 2
                induced[3 * i + j] = induced[3 * j + i] = v
    return {"permanent": permanent, "induced": induced, "eddy": eddy}


def coefficient_vector(permanent, induced, eddy, terms, scale: float = SCALE) -> list[float]:
    """Inverse of ``coefficient_matrices``."""
    out = []
    for b in term_blocks(terms):
        if b[0] == "p":
            out += list(permanent)
        for a, c in (_pairs(b) if b[0] in "ie" else []):
            i, j = _AXES.index(a), _AXES.index(c)
            if b[0] == "e":
                out.append(eddy[3 * i + j] * scale)
            else:
                out.append((induced[3 * i + j] + (induced[3 * j + i] if i != j else 0.0)) * scale)
    return out


def aircraft_field(field: dict[str, Column], rate: dict[str, Column],
                   mats: dict[str, list[float]]) -> dict[str, Column]:
    """Aircraft vector field p + I B + E dB; a missing part counts as zero."""
    out = {}
    for i, a in enumerate(_AXES):
        parts = {"permanent": F.lit(float(mats["permanent"][i])) if mats.get("permanent") else F.lit(0.0)}
        for name, vec in (("induced", field), ("eddy", rate)):
            m = mats.get(name)
            parts[name] = (sum((vec[b] * float(m[3 * i + j]) for j, b in enumerate(_AXES)), F.lit(0.0))
                           if m else F.lit(0.0))
        out[a] = parts["permanent"] + parts["induced"] + parts["eddy"]
        out.update({f"{n}_{a}": c for n, c in parts.items()})
    return out


def weighted_sum(columns: list[Column], weights: list[float]) -> Column:
    """Dot product of columns with driver-side coefficients."""
    total = F.lit(0.0)
    for c, v in zip(columns, weights):
        total = total + c * float(v)
    return total

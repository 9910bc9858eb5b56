"""Line selection, targets and feature assembly."""
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from aerofield.operators.sequence import LINE, blockwise, unnumbered
from aerofield.session import small


def minutes_from_start(df: DataFrame, keys=LINE) -> DataFrame:
    """Minutes since the first sample of each selection."""
    start = df.groupBy(*keys).agg(F.min_by("tt", "rn").alias("_t0"))
    return df.join(small(start), list(keys)).withColumn("minutes", (F.col("tt") - F.col("_t0")) / 60.0).drop("_t0")


def filter_events(events: DataFrame, flight, keyword: str = "", limits=None) -> DataFrame:
    """Events of one flight, inside closed time limits, whose text matches a
    case-insensitive pattern."""
    out = events.filter(F.col("flight").cast("string") == str(flight))
    if limits:
        if len(limits) != 2:
            raise ValueError("time limits are a start and an end")
        out = out.filter(F.col("tt").between(*limits))
    if keyword:
        out = out.filter(F.lower(F.col("event").cast("string")).rlike(keyword.lower()))
    return out


def on_lines(lines="all") -> Column:
    """Whether a row is on all lines, one line, or a list of lines."""
    if isinstance(lines, str):
        if lines.lower() != "all":
            raise ValueError("lines is a number, a list of numbers, or 'all'")
        return F.col("line").isNotNull()
    return F.coalesce(F.col("line").isin(lines if isinstance(lines, (list, tuple, set)) else [lines]), F.lit(False))


def select_lines(df: DataFrame, lines="all") -> DataFrame:
    """Rows of all lines, one line, or a list of lines."""
    return df.filter(on_lines(lines))


def every(df: DataFrame, modulus: int, remainders=0, row: str = "rn") -> DataFrame:
    """Rows whose global position leaves one of the remainders."""
    wanted = [remainders] if isinstance(remainders, int) else list(remainders)
    return df.filter(F.pmod(F.col(row), F.lit(modulus)).isin(wanted)) if modulus > 1 else df


def correction(diurnal: bool = False, igrf: bool = False) -> Column:
    """What to take off a scalar magnetometer."""
    zero = F.lit(0.0)
    parts = [F.coalesce(F.col(c), zero) for c, on in (("diurnal", diurnal), ("igrf", igrf)) if on]
    return reduce(lambda a, b: a + b, parts, zero)


def corrected_mags(df: DataFrame, mags: list[str], diurnal=False, igrf=False) -> DataFrame:
    off = correction(diurnal, igrf)
    return df.withColumns({m: F.col(m) - off for m in mags})


def target(df: DataFrame, kind: str, mag: str = "mag_1_uc", mag_c: str = "mag_1_c",
           map_val: str | None = None, diurnal=False, igrf=False) -> Column:
    """Fit target: ``a`` compensated field, ``b`` map value, ``c`` uncompensated
    minus map, ``d`` uncompensated minus compensated, ``e`` uncompensated field
    (band-pass it with the filter operator).  A vector magnetometer stands for
    its total."""
    def reading(name):
        if name not in df.columns:
            raise ValueError(f"column {name} needed by target {kind}")
        is_vector = isinstance(df.schema[name].dataType, T.StructType)
        return F.col(f"{name}.t") if is_vector else F.col(name)
    off = correction(diurnal, igrf)
    if kind in ("b", "c") and (map_val is None or map_val not in df.columns):
        raise ValueError(f"target {kind} needs a map value column")
    if kind == "a":
        return reading(mag_c) - off
    if kind == "b":
        return F.col(map_val)
    if kind == "c":
        return reading(mag) - off - F.col(map_val)
    if kind == "d":
        return reading(mag) - reading(mag_c)
    if kind == "e":
        return reading(mag) - off
    raise ValueError(f"invalid target {kind!r}")


def mag_differences(mags: list[str], suffix: str) -> dict[str, Column]:
    """All pairwise differences, self-pairs included, numbered from 1."""
    return {f"mag_{i}_{j}_{suffix}": F.col(a) - F.col(b)
            for i, a in enumerate(mags, 1) for j, b in enumerate(mags, 1)}


def pick_lines(samples: DataFrame, lines: DataFrame, flights: DataFrame,
               wanted: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Samples of the wanted lines inside each line's time range.

    Returns the samples and the number of them per wanted line, zero included.
    Unknown lines are skipped; repeated lines or flights of different record
    sets are errors.
    """
    if wanted is not None:
        if len(set(wanted)) != len(wanted):
            raise ValueError("duplicate lines requested")
        lines = lines.filter(F.col("line").isin(wanted))
    repeated = lines.groupBy("line").count().filter("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"duplicate line {repeated[0]['line']}")
    kinds = (flights.join(lines.select("flight").distinct(), "flight")
             .select("xyz_set").distinct().limit(2).collect())
    if len(kinds) > 1:
        raise ValueError("lines come from incompatible record sets")
    dim = small(lines.select("flight", "line", "t_start", "t_end"))
    hit = samples.join(dim, ["flight", "line"]).filter(
        F.col("tt").between(F.col("t_start"), F.col("t_end"))).drop("t_start", "t_end", "pos", "n_line")
    found = hit.groupBy("flight", "line").agg(F.count(F.lit(1)).alias("n"))
    lengths = (lines.select("flight", "line").join(found, ["flight", "line"], "left")
               .withColumn("n", F.coalesce("n", F.lit(0))))
    return hit, lengths


def whole_windows(df: DataFrame, width: int) -> DataFrame:
    """Drop the last ``n mod width`` rows of each line of a numbered frame; the rows
    that are left are no longer numbered."""
    n = F.col("n_line")
    return unnumbered(df.filter(F.col("pos") < n - n % width))


def normalized(df: DataFrame, stats: dict[str, tuple[float, float]], undo: bool = False) -> DataFrame:
    """Apply stored (bias, scale) per column, or undo it."""
    one = (lambda c, b, s: F.col(c) * s + b) if undo else (lambda c, b, s: (F.col(c) - b) / s)
    return df.withColumns({c: one(c, b, s) for c, (b, s) in stats.items()})


def unpack_norms(norms: tuple) -> dict:
    """Stored normalizations of 4 to 7 parts; missing design parts default to
    bias 0, scale 1 and the missing projection to 1."""
    names = {4: "x_bias x_scale y_bias y_scale", 5: "v_scale x_bias x_scale y_bias y_scale",
             6: "A_bias A_scale x_bias x_scale y_bias y_scale",
             7: "A_bias A_scale v_scale x_bias x_scale y_bias y_scale"}
    if len(norms) not in names:
        raise ValueError("normalizations have 4 to 7 parts")
    return {"A_bias": 0.0, "A_scale": 1.0, "v_scale": 1.0, **dict(zip(names[len(norms)].split(), norms))}


def select_features(df: DataFrame, names: list[str], unscaled: list[str] = (),
                    groups: dict[str, list[str]] | None = None, keep=("flight", "line", "rn")):
    """Feature columns by name, with multi-column features expanded to ``name_i``.

    Returns the frame, the final names and which of them are exempt from
    normalization.  Unknown names and missing values are errors.
    """
    groups = groups or {}
    cols, out, exempt = [], [], []
    for name in names:
        members = groups.get(name, [name])
        for i, m in enumerate(members):
            if m not in df.columns:
                raise ValueError(f"feature {name} not found")
            label = name if len(members) == 1 else f"{name}_{i}"
            cols.append(F.col(m).cast("double").alias(label))
            out.append(label)
            exempt.append(name in unscaled)
    picked = df.select(*keep, *cols)
    missing = picked.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in out]).first()
    bad = [c for c in out if missing[c]]
    if bad:
        raise ValueError(f"features with missing values: {bad}")
    return picked, out, exempt


def stack_features(parts: list[tuple[DataFrame, list[str], list[bool]]]):
    """Stack the feature tables of several flights; names and exemptions must agree."""
    first = parts[0]
    for df, names, exempt in parts[1:]:
        if names != first[1] or list(exempt) != list(first[2]):
            raise ValueError("feature sets differ between flights")
    return reduce(lambda a, b: a.unionByName(b), [p[0] for p in parts]), first[1], first[2]


def field_of(name: str = "flux_a") -> dict[str, Column]:
    return {a: F.col(f"{name}.{a}") for a in "xyz"}


def vector_fields(df: DataFrame) -> list[str]:
    """Names of the vector magnetometers: structs of x, y, z and t."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StructType)
            and {"x", "y", "z", "t"} <= set(f.dataType.names)]


def with_design(df: DataFrame, vector: str = "flux_a", total: str | None = None, terms=None,
                keep_rates: bool = False) -> tuple[DataFrame, list[str]]:
    """Add the compensation design columns of a numbered frame."""
    from aerofield.functions import compensation as comp
    from aerofield.operators.differences import unit_difference
    terms = terms or comp.DEFAULT_TERMS
    rates = blockwise(df, lambda w: {f"_rate_{a}": unit_difference(c, w)
                                     for a, c in field_of(vector).items()}, 1, 1)
    cols = comp.design_columns(field_of(vector), {a: F.col(f"_rate_{a}") for a in "xyz"},
                               F.col(total or f"{vector}.t"), terms)
    out = rates.withColumns(cols)
    return (out if keep_rates else out.drop("_rate_x", "_rate_y", "_rate_z")), list(cols)

"""Map spectra: two-dimensional transforms as one round over rows and one over
columns of the grid, with transfer functions as Columns between them.

A task holds single grid rows or columns, so map size is not limited by memory.  Only
``continued`` takes maps that fit a task as a whole.
Grids must be full; gaps and masked cells count as 0.  What belongs to a map, a level or a grid
row is joined to whole grid rows, before they are laid out in cells.
"""
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerofield.functions.fourier import invert_arrays, transform_arrays
from aerofield.functions.geodesy import lat_to_north, lon_to_east
from aerofield.operators import wholemaps
from aerofield.operators.maps import is_gap, map_meta
from aerofield.session import small

TILE = ["map_id", "iz"]


def steps_in_metres(cells: DataFrame) -> DataFrame:
    """Cell size in metres of maps in radians, at each map's mean latitude."""
    meta = map_meta(cells).select("map_id", F.col("dx").alias("_sx"), F.col("dy").alias("_sy"))
    mean = cells.select("map_id", "yy").distinct().groupBy("map_id").agg(F.avg("yy").alias("_lat"))
    j = meta.join(mean, "map_id")
    return j.select("map_id", lon_to_east(F.col("_sx"), F.col("_lat")).alias("dx"),
                    lat_to_north(F.col("_sy"), F.col("_lat")).alias("dy"))


def _wave(i: Column, n: Column, step: Column) -> Column:
    signed = F.when(i <= F.floor((n - 1) / 2), i).otherwise(i - n)
    return F.when(n * step == 0, F.lit(0.0)).otherwise(signed * F.lit(2 * math.pi) / (n * step))


def wavenumbers(sizes: DataFrame) -> DataFrame:
    """kx, ky and k [rad/m] of grids (``nx, ny, dx, dy`` per map)."""
    rows = sizes.withColumn("iy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)))
    grid = rows.withColumn("ix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)))
    kx, ky = _wave(F.col("ix"), F.col("nx"), F.col("dx")), _wave(F.col("iy"), F.col("ny"), F.col("dy"))
    return grid.select("map_id", "iy", "ix", kx.alias("kx"), ky.alias("ky"), F.sqrt(kx * kx + ky * ky).alias("k"))


def _arrays(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    got = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "re", "im"))).alias("_r"))
    return got.select(*keys, F.col("_r.re").alias("re"), F.col("_r.im").alias("im"))


def _transformed(df: DataFrame, keys: list[str], order: str, udf) -> DataFrame:
    """A row per grid row or column, with its transform ``_f``."""
    return _arrays(df, keys, order).select(*keys, udf("re", "im").alias("_f"))


def _laid_out(rows: DataFrame, into: str) -> DataFrame:
    keys = [c for c in rows.columns if c != "_f"]
    return rows.select(*keys, F.posexplode(F.arrays_zip("_f.re", "_f.im")).alias(into, "_z")).select(
        *keys, F.col(into).cast("long").alias(into), F.col("_z.re").alias("re"), F.col("_z.im").alias("im"))


def _pass(df: DataFrame, keys: list[str], order: str, into: str, udf) -> DataFrame:
    return _laid_out(_transformed(df, keys, order, udf), into)


def forward(cells: DataFrame, value: str = "val", steps: DataFrame | None = None, told: DataFrame | None = None) -> DataFrame:
    """Spectrum of each map level: rows (map_id, iz, jx, jy, re, im, kx, ky, k), and the
    columns of ``told``, which has a row per wanted level."""
    v = F.col(value)
    live = F.when(is_gap(v) | ~F.coalesce("mask", F.lit(True)), F.lit(0.0)) if "mask" in cells.columns else F.when(is_gap(v), F.lit(0.0))
    flat = cells.select(*TILE, "iy", "ix", live.otherwise(v).alias("re"), F.lit(0.0).alias("im"))
    by_x = _pass(flat, [*TILE, "iy"], "ix", "jx", transform_arrays)
    rows = _transformed(by_x, [*TILE, "jx"], "iy", transform_arrays)
    meta = map_meta(cells).select("map_id", "nx", "ny", *(["dx", "dy"] if steps is None else []))
    if steps is not None:
        meta = meta.join(steps, "map_id")
    kx, ky = _wave(F.col("jx"), F.col("nx"), F.col("dx")), _wave(F.col("jy"), F.col("ny"), F.col("dy"))
    rows = rows.join(small(meta), "map_id")
    rows = rows.join(small(told), TILE) if told is not None else rows
    return (_laid_out(rows, "jy").withColumns({"kx": kx, "ky": ky})
            .withColumn("k", F.sqrt(F.col("kx") * F.col("kx") + F.col("ky") * F.col("ky"))))


def inverse(spec: DataFrame, into: str = "val", extra: tuple[str, ...] = ()) -> DataFrame:
    """Real values of a spectrum; ``extra`` keys tell several outputs apart."""
    keys = [*TILE, *extra]
    return _laid_out(_inverse_rows(spec, keys), "ix").select(*keys, "iy", "ix", F.col("re").alias(into))


def _inverse_rows(spec: DataFrame, keys: list[str]) -> DataFrame:
    """The grid rows of a spectrum's values (``_f``)."""
    by_y = _pass(spec.select(*keys, "jx", "jy", "re", "im"), [*keys, "jx"], "jy", "iy", invert_arrays)
    return _transformed(by_y, [*keys, "iy"], "jx", invert_arrays)


def scaled(spec: DataFrame, h: Column) -> DataFrame:
    return spec.withColumns({"re": F.col("re") * h, "im": F.col("im") * h})


def power(cells: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Squared magnitude of the spectrum of each map's lowest level."""
    lowest = cells.join(small(cells.groupBy("map_id").agg(F.min("iz").alias("iz"))), TILE)
    spec = forward(lowest, "val", steps)
    return spec.select("map_id", "jy", "jx", "kx", "ky", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("psd"))


def _continuation(dz: Column, alpha: Column) -> Column:
    k = F.col("k")
    up = F.exp(-k * dz)
    return up / (F.lit(1.0) + F.when(dz >= 0, F.lit(0.0)).otherwise(alpha) * k * k * up)


def padded(cells: DataFrame, pad: int, value: str = "val") -> DataFrame:
    """Full grids with ``pad`` more cells on every side, which lead each grid row, and then
    each column, around the ring from its last value to its first in even steps, so that
    the transform meets no jump at the map's edges.  Gaps and masked cells count as 0."""
    v = F.col(value)
    gap = is_gap(v) | ~F.coalesce("mask", F.lit(True)) if "mask" in cells.columns else is_gap(v)
    rows = cells.select(*TILE, "iy", "ix", "yy", "xx", "alt", F.when(gap, F.lit(0.0)).otherwise(v).alias(value))
    for line, along, fixed, moving in (("iy", "ix", "yy", "xx"), ("ix", "iy", "xx", "yy")):
        ends = rows.groupBy(*TILE, line).agg(
            F.min_by(value, along).alias("_a"), F.max_by(value, along).alias("_b"), F.min(along).alias("_lo"), F.max(along).alias("_hi"),
            F.min(fixed).alias(fixed), F.min(moving).alias("_c0"), F.max(moving).alias("_c1"), F.min("alt").alias("alt"))
        at = F.explode(F.sequence(F.lit(1), F.lit(2 * pad))).alias("_r")
        step = F.when(F.col("_hi") > F.col("_lo"), (F.col("_c1") - F.col("_c0")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(1.0))
        after, r, back = F.col("_r") <= pad, F.col("_r"), F.lit(2 * pad + 1) - F.col("_r")
        more = ends.select("*", at).select(
            *TILE, line, F.when(after, F.col("_hi") + r).otherwise(F.col("_lo") - back).alias(along), fixed,
            F.when(after, F.col("_c1") + r * step).otherwise(F.col("_c0") - back * step).alias(moving), "alt",
            (F.col("_b") + (F.col("_a") - F.col("_b")) * r / (2 * pad + 1)).alias(value))
        rows = rows.unionByName(more)
    return rows


def continued(cells: DataFrame, altitudes: list[float], alpha: float = 0.0, steps: DataFrame | None = None,
              value: str = "val", pad: int = 0) -> DataFrame:
    """Maps continued to other altitudes: up by exp(-k dz), down with the
    regularized inverse, which needs ``alpha``.  With ``pad`` they are continued with that
    many more cells on every side (``padded``), which are cut off again.

    A map of one level gives one level per altitude.  A map of several keeps its levels;
    altitudes below come from the lowest, those above from the highest, and those
    between its levels are left out.  Components of vector maps are continued one by
    one (``value``).

    Maps of one level that fit a task are continued as a whole there (``wholemaps``), all
    others in passes over their grid rows and columns."""
    unfit = wholemaps.unfit(cells, pad)
    down = F.col("_alt") > min(altitudes) if alpha <= 0 else F.lit(False)
    other = small(unfit.select("map_id", "_odd", down.alias("_down")).filter("_odd OR _down"))
    if alpha <= 0 and not other.filter("_down").isEmpty():
        raise ValueError("downward continuation needs alpha")
    v = F.col(value)
    live = ~is_gap(v) & F.coalesce("mask", F.lit(True)) if "mask" in cells.columns else ~is_gap(v)
    fit = cells.filter("map_id IS NOT NULL").join(other.select("map_id"), "map_id", "left_anti")
    out = wholemaps.continued(fit, altitudes, alpha, steps, value, pad, live)
    if other.filter("map_id IS NOT NULL").isEmpty():
        return out
    rest = cells.join(other.select("map_id"), "map_id", "left_semi")
    return out.unionByName(_continued_in_passes(rest, altitudes, alpha, steps, value, pad))


def _continued_in_passes(cells: DataFrame, altitudes: list[float], alpha: float, steps: DataFrame | None, value: str, pad: int) -> DataFrame:
    levels = cells.groupBy(*TILE).agg(F.min("alt").alias("_from"))
    ends = levels.groupBy("map_id").agg(F.min("_from").alias("_lo"), F.max("_from").alias("_hi"), F.count("*").alias("_n"))
    known = levels.join(small(ends), "map_id")
    border = known.filter((F.col("_from") == F.col("_lo")) | (F.col("_from") == F.col("_hi")))
    source = cells.join(small(border.select(*TILE)), TILE, "left_semi")
    source = padded(source, pad, value) if pad else source
    spec = forward(source, value, steps, border)
    many = spec.withColumn("alt", F.explode(F.array(*[F.lit(float(a)) for a in sorted(set(altitudes))]))).filter(
        (F.col("_n") == 1) | ((F.col("alt") < F.col("_lo")) & (F.col("_from") == F.col("_lo")))
        | ((F.col("alt") > F.col("_hi")) & (F.col("_from") == F.col("_hi"))))
    wanted = known.select("map_id", "_lo", "_hi", "_n").distinct().withColumn(
        "alt", F.explode(F.array(*[F.lit(float(a)) for a in sorted(set(altitudes))]))).filter(
        "_n = 1 OR alt < _lo OR alt > _hi").select("map_id", "alt").union(known.filter("_n > 1").select("map_id", "_from"))
    index = wanted.distinct().withColumn("iz", (F.row_number().over(Window.partitionBy("map_id").orderBy("alt")) - 1).cast("long"))
    rows = _inverse_rows(scaled(many, _continuation(F.col("alt") - F.col("_from"), F.lit(alpha))), [*TILE, "alt"])
    shift = map_meta(cells).select("map_id", "ix_min", "iy_min")
    rows = rows.join(small(shift), "map_id").withColumn("iy", F.col("iy") + F.col("iy_min") - pad)
    mask = F.col("mask") if "mask" in cells.columns else F.lit(True).alias("mask")
    axes = cells.groupBy(*TILE, "iy").agg(F.collect_list(F.struct("ix", "xx", "yy", mask)).alias("_cells"))
    placed = rows.join(axes, [*TILE, "iy"]).drop("iz").join(small(index), ["map_id", "alt"])
    out = placed.select("map_id", "iz", "iy", "alt", "ix_min", F.col("_f.re").alias("_v"), F.explode("_cells").alias("_c")).select(
        "map_id", "iz", "iy", "_c.ix", "_c.xx", "_c.yy", "alt", F.get("_v", (F.col("_c.ix") - F.col("ix_min") + pad).cast("int")).alias(value), "_c.mask")
    kept = cells.join(small(ends.filter("_n > 1").select("map_id")), "map_id", "left_semi").withColumn("mask", mask).drop("iz")
    return out.unionByName(kept.join(small(index), ["map_id", "alt"]).select(*out.columns))


def smoothed(cells: DataFrame, kind: str = "lowpass", wavelength=None, steps: DataFrame | None = None) -> DataFrame:
    """Gaussian low-, high- or band-pass by wavelength (five of the larger steps
    unless given; a band takes a shorter and a longer one)."""
    spec = forward(cells, "val", steps)
    k2 = F.col("k") * F.col("k")
    default = F.greatest("dx", "dy") * 5
    gauss = lambda length: F.exp(-k2 / (F.pow(F.lit(2 * math.pi) / length, F.lit(2.0)) * 2))
    one = default if wavelength is None or isinstance(wavelength, (tuple, list)) else F.lit(float(wavelength))
    if kind == "lowpass":
        h = gauss(one)
    elif kind == "highpass":
        h = F.lit(1.0) - gauss(one)
    elif kind == "bandpass":
        if not isinstance(wavelength, (tuple, list)) or len(wavelength) != 2:
            raise ValueError("a band needs a shorter and a longer wavelength")
        h = gauss(F.lit(float(wavelength[0]))) - gauss(F.lit(float(wavelength[1])))
    else:
        raise ValueError(f"unknown filter {kind!r}")
    return inverse(scaled(spec, h))


def spectral_gradient(cells: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Gradient along x and y by i kx and i ky."""
    spec = forward(cells, "val", steps)
    both = spec.withColumn("axis", F.explode(F.array(F.lit("x"), F.lit("y"))))
    k = F.when(F.col("axis") == "x", F.col("kx")).otherwise(F.col("ky"))
    turned = both.withColumns({"re": -k * F.col("im"), "im": k * F.col("re")})
    return inverse(turned, "grad", ("axis",))


def vector_components(cells: DataFrame, declination: float, inclination: float,
                      steps: DataFrame | None = None) -> DataFrame:
    """Vector components of a scalar map for a core field direction; the mean
    passes unchanged into each."""
    spec = forward(cells, "val", steps)
    l, m, n = (math.cos(inclination) * math.cos(declination), math.cos(inclination) * math.sin(declination),
               math.sin(inclination))
    each = spec.withColumn("part", F.explode(F.array(*[F.lit(p) for p in "xyz"])))
    kx, ky, k, re, im = (F.col(c) for c in ("kx", "ky", "k", "re", "im"))
    # denominator n k + i q
    p, q = k * n, kx * l + ky * m
    size = p * p + q * q
    along = F.when(F.col("part") == "x", kx).otherwise(ky)
    # i a / (p + i q) and k / (p + i q)
    hr = F.when(F.col("part") == "z", k * p).otherwise(along * q) / size
    hi = F.when(F.col("part") == "z", -k * q).otherwise(along * p) / size
    dc = (F.col("jx") == 0) & (F.col("jy") == 0)
    hr, hi = F.when(dc, F.lit(1.0)).otherwise(hr), F.when(dc, F.lit(0.0)).otherwise(hi)
    return inverse(each.withColumns({"re": re * hr - im * hi, "im": re * hi + im * hr}), "field", ("part",))


def regularization_curve(cells: DataFrame, dz: float, alphas: list[float], steps: DataFrame | None = None) -> DataFrame:
    """Largest change between continuations with successive alphas, over the
    unmasked cells."""
    spec = forward(cells, "val", steps).withColumn("_a", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(a)).alias("alpha")) for i, a in enumerate(alphas)])))
    spec = spec.withColumns({"step": F.col("_a.i"), "alpha": F.col("_a.alpha")})
    k = F.col("k")
    up = F.exp(-k * dz)
    vals = inverse(scaled(spec, up / (F.lit(1.0) + F.col("alpha") * k * k * up)), extra=("step", "alpha"))
    if "mask" in cells.columns:
        shift = map_meta(cells).select("map_id", "ix_min", "iy_min")
        keep = cells.join(small(shift), "map_id").filter(F.coalesce("mask", F.lit(True))).select(
            *TILE, (F.col("iy") - F.col("iy_min")).alias("iy"), (F.col("ix") - F.col("ix_min")).alias("ix"))
        vals = vals.join(keep, [*TILE, "iy", "ix"], "left_semi")
    w = Window.partitionBy(*TILE, "iy", "ix").orderBy("step")
    change = vals.withColumn("_d", F.abs(F.col("val") - F.lag("val").over(w))).filter(F.col("_d").isNotNull())
    return change.groupBy(*TILE, "step", "alpha").agg(F.max("_d").alias("norm"))

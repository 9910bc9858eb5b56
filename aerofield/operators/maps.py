"""Gridded maps as long cell tables: geometry, lookups, combination, filling.

Cells carry ``map_id, iz, iy, ix`` and their coordinates ``xx, yy, alt``.  A gap
is a null, NaN or zero value.  Lookups are equi-joins on cell indices.
"""
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from aerofield.functions.geodesy import lat_to_north
from aerofield.session import materialized, small

CELL = ["map_id", "iz", "iy", "ix"]


def is_gap(v: Column) -> Column:
    return v.isNull() | F.isnan(v) | (v == 0)


def cells_of_arrays(df: DataFrame, degrees: bool = True) -> DataFrame:
    """Map arrays (``xx``, ``yy``, ``alt``, ``val[iy][ix]``) to cells; degrees
    become radians and an altitude array its mean."""
    turn = F.radians if degrees else (lambda c: c)
    mean_alt = F.aggregate("alt", F.lit(0.0), lambda a, x: a + x) / F.size("alt")
    rows = df.select("map_id", "xx", "val", mean_alt.alias("alt"), F.posexplode("yy").alias("iy", "_y"))
    flat = rows.select("map_id", "alt", "iy", "_y", F.col("val")[F.col("iy")].alias("_row"),
                       F.posexplode("xx").alias("ix", "_x"))
    return flat.select("map_id", F.lit(0).cast("long").alias("iz"), F.col("iy").cast("long").alias("iy"),
                       F.col("ix").cast("long").alias("ix"), turn(F.col("_x")).alias("xx"),
                       turn(F.col("_y")).alias("yy"), "alt", F.col("_row")[F.col("ix")].alias("val"),
                       F.lit(True).alias("mask"))


# ---- geometry -------------------------------------------------------------

def _median_step(values: Column) -> Column:
    """Median absolute step of a sorted array; 0 for a single value."""
    steps = F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(F.size(values) - 1, F.lit(1))),
                                     lambda i: F.abs(F.get(values, i) - F.get(values, i - 1))))
    n = F.size(steps)
    middle = (F.get(steps, F.floor((n - 1) / 2).cast("int")) + F.get(steps, F.floor(n / 2).cast("int"))) / 2
    return F.when(F.size(values) < 2, F.lit(0.0)).otherwise(middle)


def map_meta(cells: DataFrame) -> DataFrame:
    """Limits, resolution and shape per map, from one aggregate that keeps only
    the distinct axis values."""
    axes = (("xx", "ix", "x"), ("yy", "iy", "y"), ("alt", "iz", "z"))
    got = cells.groupBy("map_id").agg(
        *[F.array_sort(F.collect_set(a)).alias(f"_{a}") for a, _, _ in axes],
        *[f(i).alias(f"{i}_{n}") for _, i, _ in axes for n, f in (("min", F.min), ("max", F.max))],
        *[F.size(F.collect_set(i)).cast("long").alias(f"n{k}") for _, i, k in axes])
    return got.select(
        "map_id", *[F.array_min(f"_{a}").alias(f"{a}_min") for a, _, _ in axes],
        *[F.array_max(f"_{a}").alias(f"{a}_max") for a, _, _ in axes],
        *[f"{i}_{n}" for _, i, _ in axes for n in ("min", "max")], "nx", "ny", "nz",
        *[_median_step(F.col(f"_{a}")).alias(f"d{k}") for a, _, k in axes])


def limits(cells: DataFrame, buffer_percent: float = 0.0) -> DataFrame:
    """Map limits widened by a percentage of their range."""
    lims = cells.groupBy("map_id").agg(F.min("yy").alias("y0"), F.max("yy").alias("y1"),
                                       F.min("xx").alias("x0"), F.max("xx").alias("x1"))
    by, bx = ((F.col(f"{a}1") - F.col(f"{a}0")) * buffer_percent / 100.0 for a in "yx")
    return lims.select("map_id", (F.col("y0") - by).alias("lat_min"), (F.col("y1") + by).alias("lat_max"),
                       (F.col("x0") - bx).alias("lon_min"), (F.col("x1") + bx).alias("lon_max"))


def gap_counts(cells: DataFrame) -> DataFrame:
    """Valid and gap cells per map; the axes must agree with the cell count."""
    got = cells.groupBy("map_id", "iz").agg(
        F.count_if(~is_gap(F.col("val"))).alias("valid"), F.count_if(is_gap(F.col("val"))).alias("gaps"),
        F.count_distinct("ix").alias("nx"), F.count_distinct("iy").alias("ny"))
    whole = F.col("valid") + F.col("gaps") == F.col("nx") * F.col("ny")
    return got.withColumn("nx", F.when(whole, F.col("nx")).otherwise(
        F.raise_error(F.lit("map axes inconsistent with its cells")).cast("long")))


def full_grid(cells: DataFrame) -> DataFrame:
    """All cells of each map's axes, null where the table has none."""
    keep = [c for c in cells.columns if c not in (*CELL, "xx", "yy", "alt")]
    pairs = (("iz", "alt"), ("iy", "yy"), ("ix", "xx"))
    grid = cells.groupBy("map_id").agg(*[F.collect_set(F.struct(i, a)).alias(f"_{i}") for i, a in pairs])
    for i, _ in pairs:
        grid = grid.withColumn(f"_e{i}", F.explode(f"_{i}"))
        if i == "iy":
            # a map's rows are spread before its columns are expanded
            grid = grid.repartition("map_id", "_eiz.iz", "_eiy.iy")
    grid = grid.select("map_id", "_eiz.*", "_eiy.*", "_eix.*")
    return grid.join(cells.select(*CELL, *keep), CELL, "left")


def data_limits(df: DataFrame, column: str, frac: float = 0.0, keys=()) -> DataFrame:
    """Extrema without NaN, widened by a fraction of their range."""
    v = F.when(~F.isnan(column), F.col(column))
    got = df.groupBy(*keys).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    by = (F.col("hi") - F.col("lo")) * frac
    return got.select(*keys, (F.col("lo") - by).alias("lo"), (F.col("hi") + by).alias("hi"))


def extended_axis(axis: DataFrame, column: str, lims: DataFrame | None = None, extra: bool = False,
                  keys=("map_id",), index: str = "i") -> DataFrame:
    """A regular axis continued outwards to limits (``lo``, ``hi``), with one more
    step if asked.  ``original`` tells the given values apart."""
    w = Window.partitionBy(*keys).orderBy(column)
    whole = Window.partitionBy(*keys)
    values = axis.select(*keys, column).distinct()
    own = values.select(*keys, F.col(column).alias("_x"), (F.row_number().over(w) - 1).alias("_k"),
                        F.min(column).over(whole).alias("_lo"), F.max(column).over(whole).alias("_hi"),
                        F.count(F.lit(1)).over(whole).alias("_n"))
    if lims is not None:
        own = own.join(lims, list(keys))
    else:
        own = own.withColumns({"lo": F.col("_lo"), "hi": F.col("_hi")})
    step = (F.col("_hi") - F.col("_lo")) / (F.col("_n") - 1)
    more = 1 if extra else 0
    steps = lambda gap: F.when(F.col("_n") < 2, F.lit(0)).when(
        gap >= 0, F.floor(gap / step + 1e-9) + more).otherwise(F.lit(more))
    before, after = steps(F.col("_lo") - F.col("lo")), steps(F.col("hi") - F.col("_hi"))
    # the ends carry the steps beyond them
    own = own.withColumn("_m", F.explode(
        F.when((F.col("_k") == 0) & (F.col("_n") == 1), F.array(F.lit(0).cast("long")))
        .when(F.col("_k") == 0, F.sequence(-before, F.lit(0).cast("long")))
        .when(F.col("_k") == F.col("_n") - 1, F.sequence(F.lit(0).cast("long"), after))
        .otherwise(F.array(F.lit(0).cast("long")))))
    return own.select(*keys, (F.col("_k") + F.col("_m") + before).alias(index),
                      F.when(F.col("_m") == 0, F.col("_x")).otherwise(F.col("_x") + F.col("_m") * step).alias(column),
                      (F.col("_m") == 0).alias("original"))


def trimmed(cells: DataFrame, pad: int = 0, to_data: bool = True, lat=None, lon=None, alt=None) -> DataFrame:
    """Cells of the bounding box of valid cells (plus padding), inside limits."""
    out = cells
    if to_data:
        ok = ~is_gap(F.col("val"))
        box = cells.groupBy("map_id").agg(*[f(F.when(ok, F.col(i))).alias(f"_{i}{n}") for i in ("iy", "ix")
                                            for n, f in (("0", F.min), ("1", F.max))])
        out = out.join(small(box), "map_id").filter(F.col("_iy0").isNull() | reduce(lambda a, b: a & b, [
            F.col(i).between(F.col(f"_{i}0") - pad, F.col(f"_{i}1") + pad) for i in ("iy", "ix")]))
        out = out.drop("_iy0", "_iy1", "_ix0", "_ix1")
    for column, lim in (("yy", lat), ("xx", lon), ("alt", alt)):
        if lim is not None:
            out = out.filter(F.col(column).between(*lim))
    return out


def gradient(cells: DataFrame, value: str = "val", levels: bool = False) -> DataFrame:
    """Gradient along yy and xx (and altitude): second order on uneven axes
    inside, one-sided at the ends."""
    out = cells
    axes = [("iy", "yy", "grad_y", ["map_id", "iz", "ix"]), ("ix", "xx", "grad_x", ["map_id", "iz", "iy"])]
    if levels:
        axes.append(("iz", "alt", "grad_z", ["map_id", "iy", "ix"]))
    for index, axis, name, keys in axes:
        w = Window.partitionBy(*keys).orderBy(index)
        v, a = F.col(value), F.col(axis)
        vb, va, ab, aa = (f(c).over(w) for c in (value, axis) for f in (F.lag, F.lead))
        # names: value before/after, axis before/after
        hb, ha = a - ab, aa - a
        inner = (hb * hb * va + (ha * ha - hb * hb) * v - ha * ha * vb) / (ha * hb * (ha + hb))
        out = out.withColumn(name, F.when(ab.isNull(), (va - v) / ha).when(aa.isNull(), (v - vb) / hb).otherwise(inner))
    return out


# ---- lookups --------------------------------------------------------------

def corner_table(cells: DataFrame, values=("val",), levels: bool = False) -> DataFrame:
    """For each grid square its corner values ``<v>_<dz><dy><dx>`` and bounds.

    Each cell is sent to the squares it is a corner of and the squares are
    assembled by one aggregate; incomplete squares are dropped.
    """
    ups = [(dz, dy, dx) for dz in ((0, 1) if levels else (0,)) for dy in (0, 1) for dx in (0, 1)]
    sent = cells.select(*CELL, "xx", "yy", "alt", *values, F.explode(F.array(*[
        F.struct(F.lit(z).alias("z"), F.lit(y).alias("y"), F.lit(x).alias("x")) for z, y, x in ups])).alias("_c"))
    sent = sent.withColumns({"iz": F.col("iz") - F.col("_c.z"), "iy": F.col("iy") - F.col("_c.y"),
                             "ix": F.col("ix") - F.col("_c.x")})
    at = lambda z, y, x: (F.col("_c.z") == z) & (F.col("_c.y") == y) & (F.col("_c.x") == x)
    z1 = 1 if levels else 0
    picks = [F.max(F.when(at(*u), F.col(v))).alias(f"{v}_{u[0]}{u[1]}{u[2]}") for v in values for u in ups]
    got = sent.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("_n"), F.min("xx").alias("_x0"), F.max("xx").alias("_x1"),
        F.min("yy").alias("_y0"), F.max("yy").alias("_y1"), F.min("alt").alias("_z0"),
        F.max(F.when(F.col("_c.z") == z1, F.col("alt"))).alias("_z1"), *picks)
    return got.filter(F.col("_n") == len(ups)).drop("_n")


def _indices(points: DataFrame, cells: DataFrame, regular: bool, levels: bool) -> DataFrame:
    """Square index of each point from its map's origin and step; null outside."""
    use = [("ix", "xx", "x", "nx", "dx"), ("iy", "yy", "y", "ny", "dy")]
    if levels:
        use.append(("iz", "alt", "z", "nz", "dz"))
    if regular:
        meta = map_meta(cells).select("map_id", *[c for i, a, _p, n, d in use
                                                  for c in (f"{a}_min", f"{a}_max", f"{i}_min", n, d)])
        got = points.join(small(meta), "map_id")
        for i, a, p, n, d in use:
            inside = F.col(p).between(F.col(f"{a}_min"), F.col(f"{a}_max"))
            k = F.least(F.floor((F.col(p) - F.col(f"{a}_min")) / F.col(d)), F.col(n) - 2)
            got = got.withColumn(f"_{i}", F.when(inside, k + F.col(f"{i}_min")))
        return got.drop(*[c for c in meta.columns if c != "map_id"])
    axis = [cells.select("map_id", i, a).distinct().groupBy("map_id").agg(
        F.array_sort(F.collect_set(a)).alias(f"_v{i}"), F.min(i).alias(f"_o{i}")) for i, a, *_ in use]
    got = points.join(small(reduce(lambda a, b: a.join(b, "map_id"), axis), 2000), "map_id")
    for i, _a, p, *_ in use:
        v = F.col(f"_v{i}")
        below = F.size(F.filter(v, lambda e: e <= F.col(p)))
        inside = F.col(p).between(F.get(v, F.lit(0)), F.get(v, F.size(v) - 1))
        got = got.withColumn(f"_{i}", F.when(inside, F.least(below, F.size(v) - 1) - 1 + F.col(f"_o{i}")))
    return got.drop(*[f"_{k}{i}" for i, *_ in use for k in "vo"])


def _cell_join(placed: DataFrame, cells: DataFrame) -> DataFrame:
    """Points with their cell (``_iz, _iy, _ix``), and whether they are off the map
    (``_off``).  Those have no index; they get indices that no cell has, spread by
    position, so that they do not all meet in one partition."""
    nowhere = F.lit(-(1 << 62)) + F.pmod(F.xxhash64("x", "y"), F.lit(1 << 20))
    spread = placed.withColumn("_off", F.col("_ix").isNull() | F.col("_iy").isNull()).withColumns(
        {i: F.coalesce(F.col(i).cast("long"), nowhere) for i in ("_iz", "_iy", "_ix")})
    return spread.join(cells, ["map_id", "_iz", "_iy", "_ix"], "left")


def lookup(points: DataFrame, cells: DataFrame, values=("val",), into=("map_val",), levels: bool = False,
           regular: bool = True, outside: float | None = None, gapped=("val",)) -> DataFrame:
    """Interpolated map values at points (``map_id, x, y[, z]``): linear inside the
    grid square (or cube), null outside the map, and for the values ``gapped`` also where a
    corner of the square is a gap (null, NaN or 0)."""
    placed = _indices(points, cells, regular, levels)
    if not levels:
        placed = placed.withColumn("_iz", F.col("iz") if "iz" in points.columns else F.lit(0).cast("long"))
    corners = corner_table(cells, values, levels).select(
        F.col("map_id"), F.col("iz").alias("_iz"), F.col("iy").alias("_iy"), F.col("ix").alias("_ix"),
        "_x0", "_x1", "_y0", "_y1", "_z0", "_z1", *[c for v in values for c in _corner_names(v, levels)])
    j = _cell_join(placed, corners)
    tx = (F.col("x") - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    ty = (F.col("y") - F.col("_y0")) / (F.col("_y1") - F.col("_y0"))
    blend = lambda a, b, t: a * (F.lit(1.0) - t) + b * t
    out = {}
    for v, name in zip(values, into):
        corner = [F.col(c) for c in _corner_names(v, levels)]
        plane = lambda z: blend(blend(F.col(f"{v}_{z}00"), F.col(f"{v}_{z}01"), tx),
                                blend(F.col(f"{v}_{z}10"), F.col(f"{v}_{z}11"), tx), ty)
        value = plane(0)
        if levels:
            tz = (F.col("z") - F.col("_z0")) / (F.col("_z1") - F.col("_z0"))
            value = blend(value, plane(1), tz)
        if v in gapped:
            value = F.when(~reduce(lambda a, b: a | b, map(is_gap, corner)), value)
        if outside is not None:
            value = F.when(F.col("_off"), F.lit(outside)).otherwise(value)
        out[name] = value
    return j.select(*points.columns, *[c.alias(n) for n, c in out.items()])


def _corner_names(v: str, levels: bool) -> list[str]:
    return [f"{v}_{z}{y}{x}" for z in ((0, 1) if levels else (0,)) for y in (0, 1) for x in (0, 1)]


def nearest_lookup(points: DataFrame, cells: DataFrame, value: str = "val", into: str = "map_val",
                   outside: float | None = None) -> DataFrame:
    """Value of the nearest cell; half-way points take the lower index."""
    meta = map_meta(cells).select("map_id", *[c for a, i in (("xx", "ix"), ("yy", "iy"))
                                              for c in (f"{a}_min", f"{a}_max", f"{i}_min")], "dx", "dy")
    got = points.join(small(meta), "map_id")
    for i, a, p, d in (("ix", "xx", "x", "dx"), ("iy", "yy", "y", "dy")):
        inside = F.col(p).between(F.col(f"{a}_min"), F.col(f"{a}_max"))
        t = (F.col(p) - F.col(f"{a}_min")) / F.col(d)
        near = F.floor(t) + (t - F.floor(t) > 0.5).cast("long")
        got = got.withColumn(f"_{i}", F.when(inside, near + F.col(f"{i}_min")))
    level = F.col("iz") if "iz" in points.columns else F.lit(0).cast("long")
    target = cells.select("map_id", F.col("iz").alias("_iz"), F.col("iy").alias("_iy"), F.col("ix").alias("_ix"),
                          F.col(value).alias("_v"))
    j = _cell_join(got.withColumn("_iz", level), target)
    v = F.col("_v")
    if outside is not None:
        v = F.when(F.col("_off"), F.lit(outside)).otherwise(v)
    return j.select(*points.columns, v.alias(into))


def choose_map(points: DataFrame, maps: DataFrame, bucket: float) -> DataFrame:
    """Name the map of each point (``x, y, z``): the one whose limits hold the point
    and whose altitude is nearest, the earlier (``ord``) on a tie; else a map
    flagged ``fallback`` that holds it; else null.

    Map limits are spread over coarse squares, each square lists its maps, and
    points meet the list of their square in one equi-join.
    """
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket)))
    lists = (maps.withColumn("_bx", span("x_min", "x_max")).withColumn("_by", span("y_min", "y_max"))
             .groupBy("_bx", "_by").agg(F.collect_list(F.struct(
                 "map_id", "ord", "alt", "fallback", "x_min", "x_max", "y_min", "y_max")).alias("_maps")))
    at = points.withColumns({"_bx": F.floor(F.col("x") / bucket), "_by": F.floor(F.col("y") / bucket)})
    j = at.join(lists, ["_bx", "_by"], "left")
    holds = lambda m: F.col("x").between(m["x_min"], m["x_max"]) & F.col("y").between(m["y_min"], m["y_max"])
    ranked = F.transform(F.filter("_maps", holds), lambda m: F.struct(
        m["fallback"].alias("f"), F.abs(m["alt"] - F.col("z")).alias("d"), m["ord"].alias("o"), m["map_id"].alias("id")))
    return j.withColumn("map_id", F.array_min(ranked)["id"]).drop("_bx", "_by", "_maps")


def resample(cells: DataFrame, axes: DataFrame) -> DataFrame:
    """Values on new axes (one row per map with arrays ``new_yy`` and ``new_xx``):
    linear, 0 outside; the mask marks non-zero values."""
    rows = axes.select("map_id", "new_xx", F.posexplode("new_yy").alias("iy", "y"))
    grid = rows.repartition("map_id", "iy").select("map_id", "iy", "y", F.posexplode("new_xx").alias("ix", "x"))
    levels = small(cells.select("map_id", "iz").distinct())
    pts = grid.join(levels, "map_id")
    got = lookup(pts, cells, ("val", "alt"), ("val", "alt"), outside=0.0)
    return got.select("map_id", "iz", F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"),
                      F.col("x").alias("xx"), F.col("y").alias("yy"), "alt", "val",
                      F.coalesce(F.col("val") != 0, F.lit(False)).alias("mask"))


def slope(points: DataFrame, cells: DataFrame, delta: float = 1e-8, levels: bool = False,
          keys: Sequence[str] | None = None) -> DataFrame:
    """Map slope at each point (identified by ``keys``: flight, line and rn as far as the
    points have them): symmetric offsets along y, x (and altitude), one
    lookup for all offsets, difference over twice the offset.  The altitude
    offset is the northing of ``delta`` at the point."""
    up = lat_to_north(F.lit(delta), F.col("y"))
    axes = ["y", "x"] + (["z"] if levels else [])
    moved = points.withColumn("_up", up).withColumn("_o", F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(s).alias("s")) for a in axes for s in (-1.0, 1.0)])))
    shift = lambda a, size: F.when(F.col("_o.a") == a, F.col(a) + F.col("_o.s") * size).otherwise(F.col(a))
    moved = moved.withColumns({"x": shift("x", delta), "y": shift("y", delta),
                               **({"z": shift("z", F.col("_up"))} if levels else {})})
    got = lookup(moved, cells, levels=levels)
    # both offsets must be on the map
    part = lambda a, size: F.when(F.count(F.when(F.col("_o.a") == a, F.col("map_val"))) == 2, F.sum(
        F.when(F.col("_o.a") == a, F.col("map_val") * F.col("_o.s"))) / (F.max(size) * 2.0))
    keys = list(keys or [c for c in ("flight", "line", "rn") if c in points.columns])
    return got.groupBy("map_id", *keys).agg(
        part("y", F.lit(delta)).alias("slope_y"), part("x", F.lit(delta)).alias("slope_x"),
        *([part("z", F.col("_up")).alias("slope_z")] if levels else []))


def predicted_field(points: DataFrame, cells: DataFrame, measured: str = "measured", deriv: str | None = None,
                    core: str | None = None, bias: str | None = None) -> DataFrame:
    """Map value at the corrected position (``x, y``), plus vertical derivative
    times height above the map, plus core field, plus bias; and the residual."""
    values, into = ["val"], ["map_val"]
    if deriv:
        values, into = ["val", deriv, "alt"], ["map_val", "_deriv", "_map_alt"]
    got = lookup(points, cells, values, into)
    total = F.col("map_val")
    if deriv:
        total = total + (F.col("z") - F.col("_map_alt")) * F.col("_deriv")
    for extra in (core, bias):
        if extra:
            total = total + F.col(extra)
    return got.withColumn("predicted", total).withColumn("residual", F.col(measured) - F.col("predicted"))


# ---- map algebra ----------------------------------------------------------

def core_field_change(cells: DataFrame, field: DataFrame, sub_date=None, add_date=None) -> DataFrame:
    """Valid cells less the core field at one date, plus that at another, from a
    table of the field per cell and date (``f``).  A valid cell without a field row at
    either date has no corrected value: null."""
    out = cells.withColumn("_v", F.col("val"))
    for date, sign in ((sub_date, -1.0), (add_date, 1.0)):
        if date is not None:
            at = field.filter(F.col("date") == date).select(*CELL, (F.col("f") * sign).alias("_f"))
            out = out.join(at, CELL, "left").withColumn("_v", F.col("_v") + F.col("_f")).drop("_f")
    return out.withColumn("val", F.when(is_gap(F.col("val")), F.col("val")).otherwise(F.col("_v"))).drop("_v")


def common_axes(cells: DataFrame, like: str | None = None) -> DataFrame:
    """Axes for combining maps: those of one map, or a grid around all of them
    with the finest step.  One row per map."""
    meta = map_meta(cells)
    src = meta.filter(F.col("map_id") == like) if like else meta
    positive = lambda d: F.coalesce(F.min(F.when(F.col(d) > 0, F.col(d))), F.lit(1.0))
    row = src.agg(F.min("xx_min"), F.max("xx_max"), positive("dx"), F.min("yy_min"), F.max("yy_max"), positive("dy")).first()
    span = lambda lo, hi, d: F.transform(F.sequence(F.lit(0), F.lit(int((hi - lo) / d + 0.5 + 1e-9))), lambda i: i * d + lo)
    return meta.select("map_id", span(*row[:3]).alias("new_xx"), span(*row[3:]).alias("new_yy"))


METHODS = ("average_overlap", "feather", "priority_map1", "priority_map2")


def combine(cells: DataFrame, first: str, second: str, method: str = "average_overlap",
            grid: str = "common", aligned: bool = False, name: str = "combined") -> DataFrame:
    """Two maps on one grid: average, distance-weighted or priority where both
    are valid, else whichever is.  ``aligned`` maps already share their indices."""
    if method not in METHODS:
        raise ValueError(f"invalid method {method!r}")
    both = cells.filter(F.col("map_id").isin(first, second))
    if not aligned:
        both = resample(both, common_axes(both, {"map1": first, "map2": second}.get(grid)))
    side = lambda m, p: both.filter(F.col("map_id") == m).select(
        "iz", "iy", "ix", *[F.col(c).alias(f"{p}{c}") for c in ("xx", "yy", "alt", "val", "mask")])
    j = side(first, "a_").join(side(second, "b_"), ["iz", "iy", "ix"], "full_outer")
    valid = lambda p: (~is_gap(F.col(f"{p}val"))) & F.coalesce(F.col(f"{p}mask"), F.lit(True))
    j = j.withColumns({"_va": F.coalesce(valid("a_"), F.lit(False)), "_vb": F.coalesce(valid("b_"), F.lit(False)),
                       "xx": F.coalesce("a_xx", "b_xx"), "yy": F.coalesce("a_yy", "b_yy")})
    overlap = F.col("_va") & F.col("_vb")
    a, b = F.col("a_val"), F.col("b_val")
    both_val, both_alt = (a + b) / 2, (F.col("a_alt") + F.col("b_alt")) / 2
    if method == "feather":
        j = _with_edge_weights(j)
        total = F.col("_wa") + F.col("_wb")
        both_val = F.when(total.isNull(), both_val).when(total == 0, (F.col("_wa") * a + F.col("_wb") * b)).otherwise(
            (F.col("_wa") * a + F.col("_wb") * b) / total)
        both_alt = F.col("a_alt")
    elif method.startswith("priority"):
        both_val, both_alt = (a, F.col("a_alt")) if method.endswith("1") else (b, F.col("b_alt"))
    pick = lambda both, x, y, none: F.when(overlap, both).when(F.col("_va"), x).when(F.col("_vb"), y).otherwise(none)
    return j.select(F.lit(name).alias("map_id"), "iz", "iy", "ix", "xx", "yy",
                    pick(both_alt, F.col("a_alt"), F.col("b_alt"), F.coalesce("a_alt", "b_alt")).alias("alt"),
                    pick(both_val, a, b, a).alias("val"),
                    (F.col("_va") | F.col("_vb") | F.coalesce("a_mask", F.lit(False))).alias("mask"))


def edge_distances(grid: DataFrame, marked: dict[str, Column]) -> DataFrame:
    """Cells of a full grid with, for each name, the distance in cells to the nearest cell of
    its level that is marked (null if there is none): an exact distance transform.

    In each grid column the nearest marked cell is the last or next one; in each grid row
    the squares of those distances are parabolas, whose lower envelope is the squared
    distance.  Both passes are linear in the cells and see one column or row at a time."""
    column = Window.partitionBy("map_id", "iz", "ix")  # a frame that ends with the column would be summed up for each cell
    before, after = (column.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("iy"), F.desc("iy")))
    y = F.col("iy")
    here = {name: F.when(mark, y) for name, mark in marked.items()}
    near = grid.select(*CELL, *[F.least(y - F.last(m, True).over(before), F.last(m, True).over(after) - y).cast("double").alias(name)
                                for name, m in here.items()])
    names = list(marked)

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ix", ignore_index=True)
        at = pdf["ix"].to_numpy(dtype=float)
        return pdf.assign(**{n: np.sqrt(lower_envelope(at, pdf[n].to_numpy() ** 2)) for n in names})
    return near.groupBy("map_id", "iz", "iy").applyInPandas(rows, near.schema)


def lower_envelope(at: np.ndarray, height: np.ndarray) -> np.ndarray:
    """The least of the parabolas (x - at)^2 + height at every place in ``at`` (ascending);
    a NaN height is no parabola, without any all are NaN."""
    own = np.flatnonzero(~np.isnan(height))
    if not len(own):
        return np.full(len(at), np.nan)
    lift = (height + at * at).tolist()
    x, low, begin = at.tolist(), [], []  # parabolas of the envelope, and where each begins
    for i in own.tolist():
        start = -np.inf
        while low:
            start = (lift[i] - lift[low[-1]]) / (2 * (x[i] - x[low[-1]]))
            if start > begin[-1]:
                break
            low.pop(), begin.pop()
            start = -np.inf
        low.append(i), begin.append(start)
    best = np.array(low)[np.searchsorted(begin, at, side="right") - 1]
    return (at - at[best]) ** 2 + height[best]


def _with_edge_weights(j: DataFrame) -> DataFrame:
    """Distance (in cells) of each overlap cell to the nearest cell where a map is
    invalid, over the largest such distance in the overlap."""
    grid = full_grid(j.select(F.lit("_").alias("map_id"), "iz", "iy", "ix", "xx", "yy",
                              F.lit(0.0).alias("alt"), "_va", "_vb")).fillna(False, ["_va", "_vb"])
    far = edge_distances(grid, {"_wa": ~F.col("_va"), "_wb": ~F.col("_vb")}).drop("map_id")
    out = materialized(j.join(far, ["iz", "iy", "ix"], "left"), "overlap")
    both = F.col("_va") & F.col("_vb")
    top = out.where(both).agg(F.max("_wa"), F.max("_wb")).first()
    return out.withColumns({w: F.when(both, F.col(w) / (t or 1.0)) for w, t in zip(("_wa", "_wb"), top)})


def combine_many(cells: DataFrame, order: DataFrame, aligned: bool = False, name: str = "combined") -> DataFrame:
    """Maps averaged pairwise from left to right (``order``: map_id, ord): each
    further valid map counts as much as all before it together."""
    mine = cells.join(small(order), "map_id", "left_semi")
    if not aligned:
        mine = resample(mine, common_axes(mine))
    ok = mine.filter(~is_gap(F.col("val")) & F.coalesce("mask", F.lit(True))).join(small(order), "map_id")
    got = ok.groupBy("iz", "iy", "ix").agg(
        F.min("xx").alias("xx"), F.min("yy").alias("yy"), F.min_by("alt", "ord").alias("alt"),
        F.array_sort(F.collect_list(F.struct("ord", "val"))).alias("_s"))
    fold = F.aggregate(F.slice("_s", 2, F.size("_s")), F.col("_s")[0]["val"], lambda acc, s: (acc + s["val"]) / 2)
    return got.select(F.lit(name).alias("map_id"), "iz", "iy", "ix", "xx", "yy", "alt", fold.alias("val"),
                      F.lit(True).alias("mask"))


def nearest_cells(targets: DataFrame, sources: DataFrame, grid: DataFrame, k: int, reach: int = 3) -> DataFrame:
    """The ``k`` source cells nearest to each target cell by the coordinates ``xx``,
    ``yy`` of a full grid; ties go by iy, ix.

    In one row of the grid only the k sources on either side of the target's
    column can be among its nearest, so a search over 2R+1 rows meets at most
    (2R+1) 2k candidates.  It is complete once the k-th is nearer than any row left
    out; targets for which it is not are searched again over eight times the rows.
    """
    row = Window.partitionBy("map_id", "iz", "iy").orderBy("ix")
    where = grid.select(*CELL, "xx", "yy")
    ranked = (sources.select(*CELL, "val").join(where, CELL).withColumn("_rank", F.row_number().over(row)).drop("yy")
              .withColumnsRenamed({"iy": "_sy", "ix": "_sx", "xx": "_sxx"}))
    flagged = where.join(sources.select(*CELL, F.lit(1).alias("_one")), CELL, "left")
    counted = flagged.withColumn("_left", F.sum(F.coalesce("_one", F.lit(0))).over(row)).select(
        "map_id", "iz", F.col("iy").alias("_sy"), "ix", "_left")
    axes = small(grid.groupBy("map_id", "iz").agg(F.array_sort(F.collect_set(F.struct("iy", "yy"))).alias("_rows")), 2000)
    height = axes.agg(F.max(F.size("_rows"))).first()[0]
    places = small(axes.select("map_id", "iz", F.posexplode("_rows").alias("_r", "_y")).select(
        "map_id", "iz", F.col("_y.iy").alias("iy"), "_r"))
    todo = targets.select(*CELL).join(where, CELL).join(places, ["map_id", "iz", "iy"])
    found = []
    while height is not None:
        last = F.size("_rows") - 1
        lo, hi = F.greatest(F.lit(0), F.col("_r") - reach), F.least(last, F.col("_r") + reach)
        gap = lambda i: F.abs(F.get("_rows", i)["yy"] - F.col("yy"))
        # distance of the nearest row left out; null if there is none
        beyond = F.least(F.when(lo > 0, gap(lo - 1)), F.when(hi < last, gap(hi + 1)))
        rows = todo.join(axes, ["map_id", "iz"]).select(
            *CELL, "xx", "yy", beyond.alias("_beyond"), F.explode(F.slice("_rows", lo + 1, hi - lo + 1)).alias("_s"))
        sides = rows.withColumns({"_sy": F.col("_s.iy"), "_dy": F.col("_s.yy") - F.col("yy")}).drop("_s").join(
            counted, ["map_id", "iz", "_sy", "ix"]).withColumn("_rank", F.explode(
                F.sequence(F.col("_left") - (k - 1), F.col("_left") + k)))
        cand = sides.join(ranked, ["map_id", "iz", "_sy", "_rank"])
        ox, oy = F.col("_sxx") - F.col("xx"), F.col("_dy")
        cell = Window.partitionBy(*CELL)
        top = (cand.withColumn("d2", ox * ox + oy * oy)
               .withColumn("place", F.row_number().over(cell.orderBy("d2", "_sy", "_sx")))
               .filter(F.col("place") <= k))
        near = (F.max("place").over(cell) == k) & (F.max("d2").over(cell) < F.col("_beyond") * F.col("_beyond"))
        top = top.withColumn("_sure", F.col("_beyond").isNull() | near).select(*CELL, "place", "d2", "val", "_sure")
        if reach >= height:
            found.append(top.drop("_sure"))
            break
        top = materialized(top, "nearest")
        found.append(top.filter("_sure").drop("_sure"))
        todo = todo.join(top.filter("_sure AND place = 1").select(*CELL), CELL, "left_anti")
        if todo.isEmpty():
            break
        reach *= 8
    if not found:
        return targets.select(*CELL).withColumns({"place": F.lit(None).cast("int"), "d2": F.lit(None).cast("double"),
                                                  "val": F.lit(None).cast("double")}).limit(0)
    return reduce(lambda a, b: a.unionByName(b), found)


def fill_gaps(cells: DataFrame, k: int = 3) -> DataFrame:
    """Gaps of full grids filled with the mean of the ``k`` nearest valid cells of
    their level (``k = 1`` copies)."""
    gap = is_gap(F.col("val"))
    cells = materialized(cells, "grid")
    near = nearest_cells(cells.filter(gap), cells.filter(~gap), cells, k)
    filled = near.groupBy(*CELL).agg(F.avg("val").alias("_f"))
    return cells.join(filled, CELL, "left").withColumns({
        "val": F.coalesce("_f", "val"),
        "mask": F.when(gap, F.col("_f").isNotNull()).otherwise(F.lit(True))}).drop("_f")


def with_levels(cells: DataFrame, *more: DataFrame) -> DataFrame:
    """Further levels below or above a map; level indices follow altitude."""
    every = reduce(lambda a, b: a.unionByName(b), more, cells).drop("iz")
    levels = every.select("map_id", "alt").distinct().withColumn(
        "iz", (F.row_number().over(Window.partitionBy("map_id").orderBy("alt")) - 1).cast("long"))
    return every.join(small(levels), ["map_id", "alt"]).select("map_id", "iz", *[c for c in every.columns if c != "map_id"])

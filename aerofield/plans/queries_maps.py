"""Registered queries: map geometry, lookups, combination and filling."""
from pyspark.sql import functions as F

from aerofield.operators import enrich, maps
from aerofield.plans.queries_models import _COEF, _DOT, design_view
from aerofield.plans.registry import query, r, rounded, sql
from aerofield.sources import adapters as src


@query("s10_cells_of_arrays", "S10", sql=sql(f"""SELECT map_id, iy, ix, {r('radians(ix * 0.01 - 80.0)', 'xx', 8)},
    {r('radians(iy * 0.01 + 45.0)', 'yy', 8)}, label * 10.0::DOUBLE + 310.0::DOUBLE AS alt, {r('val', 'val')} FROM tiles""", "tiles"))
def _(spark, sf):
    return maps.cells_of_arrays(src.tiles(spark, sf)).select(
        "map_id", "iy", "ix", *rounded(8, xx=F.col("xx"), yy=F.col("yy")), "alt", *rounded(val=F.col("val")))


@query("a11_axis_steps", "A11", sql=sql(f"""SELECT map_id, {r('median(d)', 'dx')} FROM (SELECT map_id,
    abs(xx - lag(xx) OVER (PARTITION BY map_id ORDER BY xx)) AS d FROM (SELECT DISTINCT map_id, xx FROM cells_type))
    GROUP BY 1""", "cells_type"))
def _(spark, sf):
    return maps.map_meta(src.map_cells(spark, sf, "type")).select("map_id", *rounded(dx=F.col("dx")))


@query("a12_map_limits", "A12", sql=sql(f"""SELECT map_id, {r('min(yy) - 0.05 * (max(yy) - min(yy))', 'lat_min')},
    {r('max(yy) + 0.05 * (max(yy) - min(yy))', 'lat_max')}, {r('min(xx) - 0.05 * (max(xx) - min(xx))', 'lon_min')},
    {r('max(xx) + 0.05 * (max(xx) - min(xx))', 'lon_max')} FROM cells_type GROUP BY 1""", "cells_type"))
def _(spark, sf):
    got = maps.limits(src.map_cells(spark, sf, "type"), 5.0)
    return got.select("map_id", *rounded(**{c: F.col(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")}))


@query("a12_map_shape", "A12", sql=sql("""SELECT map_id, count(DISTINCT ix) AS nx, count(DISTINCT iy) AS ny, count(DISTINCT iz) AS nz,
    1.0::DOUBLE AS dx, 1.0::DOUBLE AS dy FROM cells_levels GROUP BY 1""", "cells_levels"))
def _(spark, sf):
    return maps.map_meta(src.map_cells(spark, sf, "levels")).select("map_id", "nx", "ny", "nz", "dx", "dy")


# full grid of the single map, and of the two parity maps
_GRID = """, grid AS (SELECT x.map_id, 0::BIGINT AS iz, y.iy, x.ix, x.xx, y.yy, 300.0::DOUBLE AS alt, c.val FROM
    (SELECT DISTINCT map_id, ix, xx FROM {v}) x JOIN (SELECT DISTINCT map_id, iy, yy FROM {v}) y ON x.map_id = y.map_id
    LEFT JOIN {v} c ON c.map_id = x.map_id AND c.ix = x.ix AND c.iy = y.iy) """


def grid_view(v: str = "cells") -> str:
    return _GRID.format(v=v)


def grid(spark, sf, split="one"):
    return maps.full_grid(src.map_cells(spark, sf, split))


@query("a13_gap_counts", "A13", sql=sql(grid_view("cells_type") + """SELECT map_id, iz, count(*) FILTER (val IS NOT NULL AND val <> 0) AS valid,
    count(*) FILTER (val IS NULL OR val = 0) AS gaps, count(DISTINCT ix) AS nx, count(DISTINCT iy) AS ny FROM grid GROUP BY 1, 2""", "cells_type"))
def _(spark, sf):
    return maps.gap_counts(grid(spark, sf, "type"))


@query("a14_data_limits", "A14", sql=sql(f"""SELECT flight, {r('min(v) - 0.1 * (max(v) - min(v))', 'lo', 5)},
    {r('max(v) + 0.1 * (max(v) - min(v))', 'hi', 5)} FROM (SELECT flight, mag_1_uc AS v FROM samples) GROUP BY 1""", "samples"))
def _(spark, sf):
    return maps.data_limits(src.samples(spark, sf), "mag_1_uc", 0.1, ["flight"]).select("flight", *rounded(5, lo=F.col("lo"), hi=F.col("hi")))


@query("a15_extended_axis", "A15", "A14", sql=sql(f""", v AS (SELECT DISTINCT map_id, xx FROM cells_type),
    b AS (SELECT map_id, min(xx) AS x0, max(xx) AS x1, count(*) AS n FROM v GROUP BY 1),
    s AS (SELECT *, (x1 - x0) / (n - 1) AS step FROM b),
    k AS (SELECT *, CAST(floor(0.15 * (x1 - x0) / step + 1e-9) AS BIGINT) + 1 AS k FROM s)
    SELECT v.map_id, row_number() OVER (PARTITION BY v.map_id ORDER BY xx) - 1 + k AS i, {r('xx', 'xx')}, true AS original
    FROM v JOIN k ON v.map_id = k.map_id
    UNION ALL SELECT map_id, k - j, {r('x0 - j * step')}, false FROM k, LATERAL (SELECT unnest(generate_series(1, k)) AS j)
    UNION ALL SELECT map_id, k + n - 1 + j, {r('x1 + j * step')}, false FROM k, LATERAL (SELECT unnest(generate_series(1, k)) AS j)""", "cells_type"))
def _(spark, sf):
    cells = src.map_cells(spark, sf, "type")
    got = maps.extended_axis(cells, "xx", maps.data_limits(cells, "xx", 0.15, ["map_id"]), True)
    return got.select("map_id", "i", *rounded(xx=F.col("xx")), "original")


@query("a18_trimmed_map", "A18", sql=sql(""", z AS (SELECT iy, ix, xx, yy, CASE WHEN ix < 5 OR iy > 20 OR ix > 44 THEN 0 ELSE val END AS val FROM cells),
    b AS (SELECT min(iy) - 2 AS y0, max(iy) + 2 AS y1, min(ix) - 2 AS x0, max(ix) + 2 AS x1 FROM z WHERE val <> 0)
    SELECT iy, ix, val FROM z, b WHERE iy BETWEEN y0 AND y1 AND ix BETWEEN x0 AND x1 AND yy BETWEEN 4 AND 30 AND xx <= 45""", "cells"))
def _(spark, sf):
    z = src.map_cells(spark, sf).withColumn("val", F.expr("CASE WHEN ix < 5 OR iy > 20 OR ix > 44 THEN 0 ELSE val END"))
    return maps.trimmed(z, 2, True, (4, 30), (0, 45)).select("iy", "ix", "val")


def _grad(v, a, p):
    w = f"OVER (PARTITION BY map_id, iz, {p} ORDER BY {'iy' if a == 'yy' else 'ix'})"
    hb, ha = f"({a} - lag({a}) {w})", f"(lead({a}) {w} - {a})"
    vb, va = f"lag({v}) {w}", f"lead({v}) {w}"
    return (f"CASE WHEN lag({a}) {w} IS NULL THEN ({va} - {v}) / {ha} WHEN lead({a}) {w} IS NULL THEN ({v} - {vb}) / {hb} "
            f"ELSE ({hb} * {hb} * {va} + ({ha} * {ha} - {hb} * {hb}) * {v} - {ha} * {ha} * {vb}) / ({ha} * {hb} * ({ha} + {hb})) END")


@query("w19_map_gradient", "W19", sql=sql(f"SELECT map_id, iy, ix, {r(_grad('val', 'yy', 'ix'), 'grad_y', 5)}, {r(_grad('val', 'xx', 'iy'), 'grad_x', 5)} FROM cells_type", "cells_type"))
def _(spark, sf):
    got = maps.gradient(src.map_cells(spark, sf, "type"))
    return got.select("map_id", "iy", "ix", *rounded(5, grad_y=F.col("grad_y"), grad_x=F.col("grad_x")))


def squares(v: str, cols=("val",)) -> str:
    """Grid squares with corner values of a cell view."""
    picks = ", ".join(f"{t}.{c} AS {c}_{z}{y}{x}" for c in cols for z, y, x, t in
                      ((0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, "c"), (0, 1, 1, "d")))
    on = lambda t, dy, dx: f"JOIN {v} {t} ON {t}.map_id = a.map_id AND {t}.iz = a.iz AND {t}.iy = a.iy + {dy} AND {t}.ix = a.ix + {dx}"
    return f", sq AS (SELECT a.map_id, a.iz, a.iy, a.ix, {picks} FROM {v} a {on('b', 0, 1)} {on('c', 1, 0)} {on('d', 1, 1)})"


def blend(c: str = "val", s: str = "sq") -> str:
    k = lambda y, x: f"{s}.{c}_0{y}{x}"
    row = lambda y: f"({k(y, 0)} * (1.0 - tx) + {k(y, 1)} * tx)"
    return f"({row(0)} * (1.0 - ty) + {row(1)} * ty)"


def located(src_sql: str, nx: int = 50, ny: int = 25) -> str:
    """Points with square index and weights, for unit-step axes from 1."""
    return f""", place AS (SELECT *, CASE WHEN x BETWEEN 1 AND {nx} THEN least(floor(x - 1), {nx - 2}) + 1 END AS jx,
        CASE WHEN y BETWEEN 1 AND {ny} THEN least(floor(y - 1), {ny - 2}) + 1 END AS jy FROM ({src_sql})),
        pt AS (SELECT *, (x - jx) / 1.0 AS tx, (y - jy) / 1.0 AS ty FROM place)"""


_JOIN = "LEFT JOIN sq ON sq.ix = jx AND sq.iy = jy"


def points(spark, sf, name="parts"):
    return src.samples(spark, sf).select("rn", F.lit(name).alias("map_id"), F.col("xx").alias("x"), F.col("yy").alias("y"),
                                         F.col("alt").alias("z"), "mag_1_uc", "mag_1_c", "igrf", "diurnal")


@query("j3_map_values", "J3", sql=sql(squares("cells") + located("SELECT rn, xx AS x, yy AS y FROM samples")
    + f"SELECT rn, {r(blend(), 'map_val', 9)} FROM pt {_JOIN}", "samples", "cells"))
def _(spark, sf):
    return maps.lookup(points(spark, sf), src.map_cells(spark, sf)).select("rn", *rounded(9, map_val=F.col("map_val")))


@query("j3_irregular_axes", "J3", sql=sql(squares("cells") + located("SELECT rn, xx AS x, sqrt(yy) * 4.9 AS y FROM samples")
    + f""", un AS (SELECT rn, (x * x - jx * jx) / ((jx + 1) * (jx + 1) - jx * jx) AS tx, ty, jx, jy FROM pt)
    SELECT rn, {r(blend(), 'map_val', 7)} FROM un {_JOIN}""", "samples", "cells"))
def _(spark, sf):
    # columns at the squares of their index
    cells = src.map_cells(spark, sf).withColumn("xx", F.col("xx") * F.col("xx"))
    pts = points(spark, sf).withColumns({"x": F.col("x") * F.col("x"), "y": F.sqrt("y") * 4.9})
    return maps.lookup(pts, cells, regular=False).select("rn", *rounded(7, map_val=F.col("map_val")))


@query("j4_level_values", "J4", sql=sql(squares("cells_levels") + located("SELECT rn, xx AS x, yy AS y, alt AS z FROM samples")
    + f""", lo AS (SELECT * FROM sq WHERE iz = 0), hi AS (SELECT * FROM sq WHERE iz = 1)
    SELECT rn, {r(f"{blend(s='lo')} * (1.0 - (z - 300.0) / 100.0) + {blend(s='hi')} * ((z - 300.0) / 100.0)", 'map_val', 7)} FROM pt
    LEFT JOIN lo ON lo.ix = jx AND lo.iy = jy LEFT JOIN hi ON hi.ix = jx AND hi.iy = jy""", "samples", "cells_levels"))
def _(spark, sf):
    got = maps.lookup(points(spark, sf, "deep"), src.map_cells(spark, sf, "levels"), levels=True)
    return got.select("rn", *rounded(7, map_val=F.col("map_val")))


@query("j5_vector_map_values", "J5", sql=sql(""", vc AS (SELECT *, val AS bx, val * 0.5 + ix AS by_, iy - val / 10.0 AS bz FROM cells)"""
    + squares("vc", ("bx", "by_", "bz")) + located("SELECT rn, xx AS x, yy AS y FROM samples")
    + f"SELECT rn, {r(blend('bx'), 'bx', 9)}, {r(blend('by_'), 'by', 9)}, {r(blend('bz'), 'bz', 9)} FROM pt {_JOIN}", "samples", "cells"))
def _(spark, sf):
    v = F.col("val")
    cells = src.map_cells(spark, sf).withColumns({"bx": v, "by": v * 0.5 + F.col("ix"), "bz": F.col("iy") - v / 10.0})
    got = maps.lookup(points(spark, sf), cells, ("bx", "by", "bz"), ("bx", "by", "bz"))
    return got.select("rn", *rounded(9, bx=F.col("bx"), by=F.col("by"), bz=F.col("bz")))


@query("j6_nearest_cells", "J6", sql=sql(f"""SELECT rn, {r('val', 'map_val')} FROM samples s LEFT JOIN cells c
    ON c.ix = floor(s.xx - 1) + CASE WHEN s.xx - 1 - floor(s.xx - 1) > 0.5 THEN 1 ELSE 0 END + 1
    AND c.iy = floor(s.yy - 1) + CASE WHEN s.yy - 1 - floor(s.yy - 1) > 0.5 THEN 1 ELSE 0 END + 1""", "samples", "cells"))
def _(spark, sf):
    return maps.nearest_lookup(points(spark, sf), src.map_cells(spark, sf)).select("rn", *rounded(map_val=F.col("map_val")))


_MAPS = """, kept AS (SELECT * FROM cells_type WHERE ix BETWEEN length(map_id) * 2 AND length(map_id) * 5 AND iy > length(map_id) - 2),
    maps AS (SELECT map_id, row_number() OVER (ORDER BY map_id) AS ord, 300.0 + 20 * length(map_id) - 80 AS alt,
    map_id = 'STANDARD' AS fallback, min(xx) AS x0, max(xx) AS x1, min(yy) AS y0, max(yy) AS y1 FROM kept GROUP BY map_id) """


@query("j7_chosen_map", "J7", sql=sql(_MAPS + """SELECT rn, (SELECT arg_min(map_id, (fallback, abs(m.alt - s.alt), ord)) FROM maps m
    WHERE s.xx BETWEEN x0 AND x1 AND s.yy BETWEEN y0 AND y1) AS map_id FROM samples s""", "samples", "cells_type"))
def _(spark, sf):
    from pyspark.sql import Window
    n = F.length("map_id")
    kept = src.map_cells(spark, sf, "type").filter(F.col("ix").between(n * 2, n * 5) & (F.col("iy") > n - 2))
    meta = kept.groupBy("map_id").agg(F.min("xx").alias("x_min"), F.max("xx").alias("x_max"),
                                      F.min("yy").alias("y_min"), F.max("yy").alias("y_max"))
    meta = meta.withColumns({"ord": F.row_number().over(Window.orderBy("map_id")), "alt": F.lit(220.0) + n * 20,
                             "fallback": F.col("map_id") == "STANDARD"})
    return maps.choose_map(points(spark, sf).drop("map_id"), meta, 8.0).select("rn", "map_id")


@query("j12_resampled_map", "J12", sql=sql(squares("cells") + located("""SELECT iy, ix, iy * 0.5 AS y, ix * 0.5 AS x FROM
    generate_series(0, 53) AS a(iy), generate_series(0, 104) AS b(ix)""")
    + f""", v AS (SELECT pt.iy, pt.ix, CASE WHEN jx IS NULL OR jy IS NULL THEN 0.0 ELSE {blend()} END AS val FROM pt {_JOIN})
    SELECT iy, ix, {r('val', 'val', 9)}, coalesce(val <> 0, false) AS mask FROM v""", "cells"))
def _(spark, sf):
    cells = src.map_cells(spark, sf)
    half = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: i * 0.5)
    axes = cells.select("map_id").distinct().withColumns({"new_yy": half(53), "new_xx": half(104)})
    return maps.resample(cells, axes).select("iy", "ix", *rounded(9, val=F.col("val")), "mask")


@query("j14_map_slope", "J14", sql=sql(squares("cells") + located("""SELECT rn, d, s, xx + CASE WHEN d = 'x' THEN s * 0.25 ELSE 0 END AS x,
    yy + CASE WHEN d = 'y' THEN s * 0.25 ELSE 0 END AS y FROM samples, (VALUES ('x', -1.0), ('x', 1.0), ('y', -1.0), ('y', 1.0)) AS o(d, s)""")
    + f""", v AS (SELECT rn, d, s, {blend()} AS val FROM pt {_JOIN})
    SELECT rn, {r("CASE WHEN count(val) FILTER (d = 'y') = 2 THEN sum(val * s) FILTER (d = 'y') / 0.5 END", 'slope_y', 9)},
    {r("CASE WHEN count(val) FILTER (d = 'x') = 2 THEN sum(val * s) FILTER (d = 'x') / 0.5 END", 'slope_x', 9)} FROM v GROUP BY rn""", "samples", "cells"))
def _(spark, sf):
    got = maps.slope(points(spark, sf), src.map_cells(spark, sf), 0.25)
    return got.select("rn", *rounded(9, slope_y=F.col("slope_y"), slope_x=F.col("slope_x")))


@query("j15_predicted_field", "J15", sql=sql(", dc AS (SELECT *, ix * 0.001 AS deriv FROM cells)" + squares("dc", ("val", "deriv"))
    + located("SELECT rn, xx AS x, yy AS y, alt AS z, mag_1_uc, igrf, diurnal FROM samples")
    + f""", p AS (SELECT rn, mag_1_uc, {blend()} + (z - 300.0) * {blend('deriv')} + igrf + diurnal AS predicted FROM pt {_JOIN})
    SELECT rn, {r('predicted', 'predicted', 9)}, {r('mag_1_uc - predicted', 'residual', 9)} FROM p""", "samples", "cells"))
def _(spark, sf):
    cells = src.map_cells(spark, sf).withColumn("deriv", F.col("ix") * 0.001)
    got = maps.predicted_field(points(spark, sf), cells, "mag_1_uc", "deriv", "igrf", "diurnal")
    return got.select("rn", *rounded(9, predicted=F.col("predicted"), residual=F.col("residual")))


@query("p20_core_field_change", "P20", sql=sql(f"""SELECT iz, iy, ix, {r('val - (ix * 0.5 + iy) + ix * 0.25 * (iz + 1)', 'val', 5)} FROM cells_levels""", "cells_levels"))
def _(spark, sf):
    cells = src.map_cells(spark, sf, "levels")
    field = lambda date, f: cells.select(*maps.CELL, F.lit(date).alias("date"), f.alias("f"))
    table = field(2015.0, F.col("ix") * 0.5 + F.col("iy")).unionByName(field(2020.5, F.col("ix") * 0.25 * (F.col("iz") + 1)))
    return maps.core_field_change(cells, table, 2015.0, 2020.5).select("iz", "iy", "ix", *rounded(5, val=F.col("val")))


_PAIR = """, pair AS (SELECT coalesce(a.iy, b.iy) AS iy, coalesce(a.ix, b.ix) AS ix, a.val AS a, b.val AS b FROM
    (SELECT * FROM cells_parity WHERE map_id = 'odd') a FULL JOIN (SELECT * FROM cells_parity WHERE map_id = 'even') b
    ON a.iy = b.iy AND a.ix = b.ix) """


def _register_combination(method: str, both: str):
    @query(f"j9_combined_{method}", "J9", sql=sql(_PAIR + f"""SELECT iy, ix, {r(f'CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN {both} ELSE coalesce(a, b) END', 'val', 5)} FROM pair""", "cells_parity"))
    def _(spark, sf):
        got = maps.combine(src.map_cells(spark, sf, "parity"), "odd", "even", method, aligned=True)
        return got.select("iy", "ix", *rounded(5, val=F.col("val")))


for _method, _both in (("average_overlap", "(a + b) / 2"), ("priority_map1", "a"), ("priority_map2", "b")):
    _register_combination(_method, _both)


def _edge(flag: str) -> str:
    return f"""(SELECT g.iy, g.ix, sqrt(min((h.iy - g.iy) * (h.iy - g.iy) + (h.ix - g.ix) * (h.ix - g.ix))) AS d
        FROM pair g, pair h WHERE g.a IS NOT NULL AND g.b IS NOT NULL AND h.{flag} IS NULL GROUP BY 1, 2)"""


@query("j9_combined_feather", "J9", sql=sql(_PAIR.replace("pair AS", "some_cells AS") + f""", pair AS (SELECT y.iy, x.ix, s.a, s.b
    FROM (SELECT DISTINCT iy FROM some_cells) y CROSS JOIN (SELECT DISTINCT ix FROM some_cells) x LEFT JOIN some_cells s ON s.iy = y.iy AND s.ix = x.ix), wa AS {_edge('a')}, wb AS {_edge('b')},
    w AS (SELECT p.*, wa.d / (SELECT max(d) FROM wa) AS u, wb.d / (SELECT max(d) FROM wb) AS v FROM pair p
    LEFT JOIN wa ON wa.iy = p.iy AND wa.ix = p.ix LEFT JOIN wb ON wb.iy = p.iy AND wb.ix = p.ix)
    SELECT iy, ix, {r('CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN coalesce((u * a + v * b) / (u + v), (a + b) / 2) ELSE coalesce(a, b) END', 'val', 5)} FROM w WHERE a IS NOT NULL OR b IS NOT NULL""", "cells_parity"))
def _(spark, sf):
    got = maps.combine(src.map_cells(spark, sf, "parity"), "odd", "even", "feather", aligned=True)
    return got.select("iy", "ix", *rounded(5, val=F.col("val")))


@query("j9_combined_resampled", "J9", "J12", sql=sql(squares("cells_parity") + """, ax AS (SELECT min(xx) AS x0, max(xx) AS x1, min(yy) AS y0, max(yy) AS y1 FROM cells_parity),
    g AS (SELECT ix, iy FROM ax, generate_series(0, CAST((SELECT x1 - x0 FROM ax) AS BIGINT)) AS a(ix), generate_series(0, CAST((SELECT y1 - y0 FROM ax) AS BIGINT)) AS b(iy)),
    lim AS (SELECT map_id, min(xx) AS x0, max(xx) AS x1, min(yy) AS y0, max(yy) AS y1 FROM cells_parity GROUP BY 1),
    res AS (SELECT l.map_id, g.iy, g.ix, CASE WHEN g.ix + ax.x0 BETWEEN l.x0 AND l.x1 AND g.iy + ax.y0 BETWEEN l.y0 AND l.y1 THEN
    CASE WHEN g.ix + ax.x0 = l.x1 THEN CASE WHEN g.iy + ax.y0 = l.y1 THEN sq.val_011 ELSE sq.val_001 END
    ELSE CASE WHEN g.iy + ax.y0 = l.y1 THEN sq.val_010 ELSE sq.val_000 END END ELSE 0 END AS val
    FROM g, ax, lim l LEFT JOIN sq ON sq.map_id = l.map_id AND sq.ix = least(g.ix + ax.x0, l.x1 - 1) AND sq.iy = least(g.iy + ax.y0, l.y1 - 1)),
    p AS (SELECT iy, ix, max(CASE WHEN map_id = 'odd' THEN val END) AS a, max(CASE WHEN map_id = 'even' THEN val END) AS b FROM res GROUP BY 1, 2)
    SELECT iy, ix, """ + r("CASE WHEN a <> 0 AND b <> 0 THEN (a + b) / 2 WHEN a <> 0 THEN a WHEN b <> 0 THEN b ELSE a END", "val", 5) + " FROM p", "cells_parity"))
def _(spark, sf):
    got = maps.combine(src.map_cells(spark, sf, "parity"), "odd", "even", "average_overlap", "common")
    return got.select("iy", "ix", *rounded(5, val=F.col("val")))


@query("j10_combined_many", "J10", sql=sql(f"""SELECT iy, ix, {r('list_reduce(list(val ORDER BY map_id), lambda x, y: (x + y) / 2)', 'val', 9)} FROM cells_type GROUP BY 1, 2""", "cells_type"))
def _(spark, sf):
    from pyspark.sql import Window
    cells = src.map_cells(spark, sf, "type")
    order = cells.select("map_id").distinct().withColumn("ord", F.row_number().over(Window.orderBy("map_id")))
    return maps.combine_many(cells, order, aligned=True).select("iy", "ix", *rounded(9, val=F.col("val")))


@query("j11_filled_gaps", "J11", sql=sql(grid_view("cells_type") + """, near AS (SELECT g.map_id, g.iy, g.ix, v.val, row_number() OVER (PARTITION BY g.map_id, g.iy, g.ix
    ORDER BY (v.iy - g.iy) * (v.iy - g.iy) + (v.ix - g.ix) * (v.ix - g.ix), v.iy, v.ix) AS p
    FROM grid g JOIN cells_type v ON g.map_id = v.map_id WHERE g.val IS NULL),
    f AS (SELECT map_id, iy, ix, avg(val) AS val FROM near WHERE p <= 3 GROUP BY 1, 2, 3)
    SELECT g.map_id, g.iy, g.ix, """ + r("coalesce(g.val, f.val)", "val", 7) + """, true AS mask FROM grid g LEFT JOIN f
    ON f.map_id = g.map_id AND f.iy = g.iy AND f.ix = g.ix""", "cells_type"))
def _(spark, sf):
    return maps.fill_gaps(grid(spark, sf, "type"), 3).select("map_id", "iy", "ix", *rounded(7, val=F.col("val")), "mask")


@query("u2_added_levels", "U2", sql=sql("""SELECT CAST(dense_rank() OVER (ORDER BY alt) - 1 AS BIGINT) AS iz, iy, ix, alt, val FROM
    (SELECT iy, ix, alt, val FROM cells_levels UNION ALL SELECT iy, ix, 200.0::DOUBLE, val * 2 FROM cells_levels WHERE iz = 0
    UNION ALL SELECT iy, ix, 500.0::DOUBLE, val / 2 FROM cells_levels WHERE iz = 1)""", "cells_levels"))
def _(spark, sf):
    cells = src.map_cells(spark, sf, "levels")
    below = cells.filter("iz = 0").withColumns({"alt": F.lit(200.0), "val": F.col("val") * 2})
    above = cells.filter("iz = 1").withColumns({"alt": F.lit(500.0), "val": F.col("val") / 2})
    return maps.with_levels(cells, below, above).select("iz", "iy", "ix", "alt", "val")


@query("p19_enriched_flight", "P19", sql=sql(design_view() + squares("cells") + located("SELECT *, xx AS x, yy AS y FROM design")
    + f"""SELECT rn, 2031 AS year, {r("CASE WHEN flight = 'F1' THEN rn % 13 + 1.0 ELSE igrf END", 'igrf', 4)}, {r(blend(), 'mag_map', 9)},
    {r(f"CASE WHEN flight = 'F0' THEN mag_1_uc - ({_DOT}) ELSE mag_1_c END", 'mag_1_c', 5)} FROM pt {_JOIN}""", "numbered", "cells"))
def _(spark, sf):
    raw = src.samples(spark, sf)
    raw = raw.withColumns({"igrf": F.when(F.col("flight") == "F1", F.lit(0.0)).otherwise(F.col("igrf")),
                           "mag_1_c": F.when(F.col("flight") == "F0", F.lit(None)).otherwise(F.col("mag_1_c")),
                           "lon": F.col("xx"), "lat": F.col("yy")})
    core = raw.select("rn", (F.col("rn") % 13 + 1.0).alias("f"))
    got = enrich.enrich(raw, {"year": 2031}, core, src.map_cells(spark, sf), "parts", _COEF)
    return got.select("rn", "year", *rounded(4, igrf=F.col("igrf")), *rounded(9, mag_map=F.col("mag_map")), *rounded(5, mag_1_c=F.col("mag_1_c")))

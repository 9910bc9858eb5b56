"""Registered queries: ingest rules, selections, targets, segments, errors."""
from pyspark.sql import functions as F

from aerofield.functions import geodesy
from aerofield.operators import differences, segments, select, sequence, stats
from aerofield.plans.registry import query, r, rounded, sql
from aerofield.sources import adapters as src
from aerofield.sources import ingest


def numbered(spark, sf):
    return sequence.number_rows(src.samples(spark, sf))


KEY = ["flight", "line", "rn"]


@query("s3_rate_decimation", "S3", sql=sql(f"""SELECT rn, {r('tt', 'tt')} FROM samples
    WHERE (tt + 1e-6) - floor((tt + 1e-6) / 0.1) * 0.1 < 1e-3""", "samples"))
def _(spark, sf):
    return ingest.decimate(src.samples(spark, sf)).select("rn", *rounded(tt=F.col("tt")))


_RANGES = """, ranges AS (SELECT line, t_start AS t0, t_end AS t1 FROM lines WHERE line % 3 = 0)"""


def _ranges(spark, sf):
    return src.lines(spark, sf).filter("line % 3 = 0").select(
        "line", F.col("t_start").alias("t0"), F.col("t_end").alias("t1"))


@query("s4_exclude_line_ranges", "S4", sql=sql(_RANGES + """SELECT rn, line FROM samples s WHERE NOT EXISTS
    (SELECT 1 FROM ranges x WHERE x.line = s.line AND s.tt BETWEEN x.t0 AND x.t1)""", "lines"))
def _(spark, sf):
    return ingest.filter_ranges(src.samples(spark, sf), _ranges(spark, sf), "exclude").select("rn", "line")


@query("s4_include_line_ranges", "S4", sql=sql(_RANGES + """SELECT rn, line FROM samples s WHERE EXISTS
    (SELECT 1 FROM ranges x WHERE x.line = s.line AND s.tt BETWEEN x.t0 AND x.t1)""", "lines"))
def _(spark, sf):
    return ingest.filter_ranges(src.samples(spark, sf), _ranges(spark, sf), "include").select("rn", "line")


@query("s5_time_order", "S5", "T1", sql=sql(
    "SELECT flight, rn, row_number() OVER (PARTITION BY flight ORDER BY tt NULLS LAST, rn) - 1 AS place FROM samples",
    "samples"))
def _(spark, sf):
    got = ingest.time_places(src.samples(spark, sf).select("flight", "rn", "tt"))
    return got.select("flight", "rn", F.col("pos").alias("place"))


@query("s6_flight_meta", "S6", sql=sql("""SELECT flight, count(*) AS n,
    (round(coalesce(median(d), 0.1), 6) + 0.0) AS dt FROM
    (SELECT flight, round(tt - lag(tt) OVER (PARTITION BY flight ORDER BY rn), 9) AS d FROM samples)
    GROUP BY flight""", "samples"))
def _(spark, sf):
    meta = ingest.flight_meta(src.samples(spark, sf))
    return meta.select("flight", "n", *rounded(dt=F.col("dt")))


@query("s6_outlier_quantiles", "S6", sql=sql(f"""SELECT flight, {r('median(v)', 'mid')}, {r('quantile_disc(v, 0.9)', 'top')}
    FROM (SELECT flight, CASE WHEN rn % 2500 = 7 THEN 1e12 ELSE mag_1_uc END AS v FROM samples) GROUP BY 1""", "samples"))
def _(spark, sf):
    """Exact quantiles beside one value that is far from all others in each flight."""
    df = src.samples(spark, sf).withColumn("v", F.when(F.col("rn") % 2500 == 7, 1e12).otherwise(F.col("mag_1_uc")))
    n = F.col("_of_key")
    top = sequence.exact_ranked(df, ["flight"], "v", {"top": F.ceil(n * 9 / 10)})
    return sequence.exact_median(df, ["flight"], "v", "mid").join(top, "flight").select(
        "flight", *rounded(mid=F.col("mid"), top=F.col("top")))


@query("s8_data_set_names", "S8", sql=sql(
    "SELECT DISTINCT 'survey_Flt' || flight || '_L' || CAST(line AS VARCHAR) || '.parquet' AS name FROM samples",
    "samples"))
def _(spark, sf):
    return src.samples(spark, sf).select(ingest.data_set_name("survey", "parquet").alias("name")).distinct()


@query("s9_dimension_counts", "S9", sql=sql("""SELECT 'lines' AS dim, count(*) AS n FROM lines
    UNION ALL SELECT 'flights', count(DISTINCT flight) FROM samples
    UNION ALL SELECT 'maps', count(DISTINCT map_id) FROM cells
    UNION ALL SELECT 'events', count(*) FROM flight_events""", "lines", "flight_events", "cells"))
def _(spark, sf):
    ingest.register_dimensions(lines=src.lines(spark, sf), flights=src.flights(spark, sf),
                               maps=src.map_dim(spark, sf), events=src.flight_events(spark, sf))
    return spark.sql(" UNION ALL ".join(
        f"SELECT '{d}' AS dim, count(*) AS n FROM dim_{d}" for d in ("lines", "flights", "maps", "events")))


@query("s11_table_field_changes", "S11", sql=sql(f"""SELECT 'mag_1_uc' AS field, count(*) FILTER (mag_1_uc <> 0) AS differing
    FROM samples UNION ALL SELECT 'mag_1_c', 0 FROM (SELECT 1) UNION ALL SELECT 'alt', 1 FROM (SELECT 1)
    UNION ALL SELECT 'height', 1 FROM (SELECT 1)""", "samples"))
def _(spark, sf):
    before = src.samples(spark, sf).select(*KEY, "mag_1_uc", "mag_1_c", "alt")
    after = before.withColumn("mag_1_uc", F.col("mag_1_uc") * 2).withColumnRenamed("alt", "height")
    return ingest.differing_fields(before, after, KEY)


@query("s12_decimated_path", "S12", sql=sql(f"""SELECT rn, {r('degrees(lat)', 'lat')}, {r('degrees(lon)', 'lon')},
    alt FROM (SELECT *, row_number() OVER (PARTITION BY flight ORDER BY rn) - 1 AS p,
    count(*) OVER (PARTITION BY flight) AS n FROM samples)
    WHERE p % CASE WHEN n > 1000 THEN CAST(ceil(n / 1000.0) AS BIGINT) ELSE 1 END = 0""", "samples"))
def _(spark, sf):
    path = ingest.export_path(src.samples(spark, sf), 1000)
    return path.select("rn", *rounded(lat=F.col("lat"), lon=F.col("lon")), "alt")


@query("s13_vector_fields", "S13", sql=sql("SELECT DISTINCT 'flux_a' AS field FROM samples", "samples"))
def _(spark, sf):
    df = src.samples(spark, sf)
    names = select.vector_fields(df)
    return df.select(F.explode(F.array(*[F.lit(n) for n in names])).alias("field")).distinct()


_E, _A = "0.0818191908426", "6378137.0"
_FLAT = f"sqrt(1.0 - ({_E} * sin(lat)) * ({_E} * sin(lat)))"


@query("p1_metres_and_radians", "P1", sql=sql(f"""SELECT rn, {r(f'vn * {_FLAT} / {_A} * 1e9', 'dlat', 5)},
    {r(f'vn * {_FLAT} / {_A} / cos(lat) * 1e9', 'dlon', 5)},
    {r(f'(roll * 1e-6) / {_FLAT} * {_A}', 'dn', 6)},
    {r(f'(roll * 1e-6) / {_FLAT} * {_A} * cos(lat)', 'de', 6)} FROM samples""", "samples"))
def _(spark, sf):
    vn, lat, small = F.col("vn"), F.col("lat"), F.col("roll") * 1e-6
    return src.samples(spark, sf).select(
        "rn", *rounded(5, dlat=geodesy.north_to_lat(vn, lat) * 1e9, dlon=geodesy.east_to_lon(vn, lat) * 1e9),
        *rounded(6, dn=geodesy.lat_to_north(small, lat), de=geodesy.lon_to_east(small, lat)))


_LEAP = "CASE WHEN y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0) THEN 366 ELSE 365 END"


@query("p2_decimal_years", "P2", sql=f"""SELECT o_orderkey, {_LEAP} AS days,
    {r('y + (d - 1) / 365.25', 'julian')}, {r(f'y + (d - 1) / CAST({_LEAP} AS DOUBLE)', 'true_days')},
    {r('''y + (epoch_us(o_orderdate) - epoch_us(date_trunc('year', o_orderdate)::TIMESTAMP))
       / CAST(epoch_us((date_trunc('year', o_orderdate) + INTERVAL 1 YEAR)::TIMESTAMP)
       - epoch_us(date_trunc('year', o_orderdate)::TIMESTAMP) AS DOUBLE)''', 'calendar')}
    FROM (SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS y,
          CAST(dayofyear(o_orderdate) AS INTEGER) AS d FROM orders)""")
def _(spark, sf):
    y, d = F.year("o_orderdate"), F.dayofyear("o_orderdate")
    return src.table(spark, sf, "orders").select(
        "o_orderkey", geodesy.days_in_year(y).alias("days"),
        *rounded(julian=geodesy.decimal_year(y, d, "julian"), true_days=geodesy.decimal_year(y, d),
                 calendar=geodesy.decimal_year_of(F.col("o_orderdate"))))


@query("p3_minutes_from_start", "P3", sql=sql(
    f"SELECT rn, {r('(tt - first_value(tt) OVER (PARTITION BY flight, line ORDER BY rn)) / 60.0', 'minutes', 5)} FROM samples",
    "samples"))
def _(spark, sf):
    return select.minutes_from_start(src.samples(spark, sf)).select("rn", *rounded(5, minutes=F.col("minutes")))


@query("p4_event_filter", "P4", sql=sql(f"""SELECT flight, {r('tt', 'tt')}, event FROM flight_events
    WHERE flight = 'F0' AND tt BETWEEN 1000.0 AND 400000.0 AND regexp_matches(lower(event), 'error.*[13579]$')""",
    "flight_events"))
def _(spark, sf):
    got = select.filter_events(src.flight_events(spark, sf), "F0", "ERROR.*[13579]$", (1000.0, 400000.0))
    return got.select("flight", *rounded(tt=F.col("tt")), "event")


@query("p5_line_membership", "P5", sql=sql(
    "SELECT line, rn, line IN (1, 3, 105, 307) AS chosen FROM samples", "samples"))
def _(spark, sf):
    return src.samples(spark, sf).select("line", "rn", select.on_lines([1, 3, 105, 307]).alias("chosen"))


@query("p6_modulo_rows", "P6", sql="SELECT event_id AS rn FROM events WHERE event_id % 7 IN (0, 3)")
def _(spark, sf):
    return select.every(src.samples(spark, sf), 7, [0, 3]).select("rn")


@query("p7_corrected_mags", "P7", sql=sql(f"""SELECT rn, {r('mag_1_uc - diurnal - igrf', 'mag_1_uc', 4)},
    {r('mag_2_c - diurnal - igrf', 'mag_2_c', 4)} FROM samples""", "samples"))
def _(spark, sf):
    got = select.corrected_mags(src.samples(spark, sf), ["mag_1_uc", "mag_2_c"], True, True)
    return got.select("rn", *rounded(4, mag_1_uc=F.col("mag_1_uc"), mag_2_c=F.col("mag_2_c")))


@query("p8_targets", "P8", sql=sql(f""", s AS (SELECT rn, mag_1_uc, mag_1_c, ft, diurnal + igrf AS sub, alt AS map_val FROM samples)
    SELECT rn, {r('mag_1_c - sub', 'a', 4)}, {r('map_val', 'b', 4)}, {r('mag_1_uc - sub - map_val', 'c', 4)},
    {r('mag_1_uc - mag_1_c', 'd', 4)}, {r('mag_1_uc - sub', 'e', 4)}, {r('ft - sub', 'e_vector', 4)} FROM s""", "samples"))
def _(spark, sf):
    df = src.samples(spark, sf).withColumn("map_val", F.col("alt"))
    t = lambda kind, mag="mag_1_uc": select.target(df, kind, mag, "mag_1_c", "map_val", True, True)
    return df.select("rn", *rounded(4, **{k: t(k) for k in "abcde"}, e_vector=t("e", "flux_a")))


@query("p9_mag_differences", "P9", sql=sql("SELECT rn, " + ", ".join(
    r(f"mag_{i}_{k} - mag_{j}_{k}", f"mag_{i}_{j}_{k}", 4) for k in ("c", "uc") for i in (1, 2) for j in (1, 2))
    + " FROM samples", "samples"))
def _(spark, sf):
    cols = {**select.mag_differences(["mag_1_c", "mag_2_c"], "c"),
            **select.mag_differences(["mag_1_uc", "mag_2_uc"], "uc")}
    return src.samples(spark, sf).select("rn", *rounded(4, **cols))


@query("p21_utm_zones", "P21", sql=sql(f"""SELECT rn, CAST(floor((degrees(lon) + 180) / 6) AS INTEGER) + 1 AS zone,
    degrees(lat) - 40 >= 0 AS north FROM samples""", "samples"))
def _(spark, sf):
    lon, lat = F.degrees("lon"), F.degrees("lat") - 40
    return src.samples(spark, sf).select("rn", geodesy.utm_zone(lon).alias("zone"), geodesy.is_north(lat).alias("north"))


@query("j1_pick_lines", "J1", "J2", sql=sql("""SELECT s.rn, s.line FROM samples s JOIN lines l
    ON s.flight = l.flight AND s.line = l.line AND s.tt BETWEEN l.t_start AND l.t_end
    WHERE l.line % 2 = 0""", "lines"))
def _(spark, sf):
    dim = src.lines(spark, sf).filter("line % 2 = 0")
    hit, _n = select.pick_lines(src.samples(spark, sf), dim, src.flights(spark, sf))
    return hit.select("rn", "line")


@query("j1_line_lengths", "J1", sql=sql("""SELECT l.flight, l.line, count(s.rn) AS n FROM
    (SELECT flight, line, t_start, CASE WHEN line % 4 = 0 THEN t_start - 1 ELSE t_end END AS t_end FROM lines) l
    LEFT JOIN samples s ON s.flight = l.flight AND s.line = l.line AND s.tt BETWEEN l.t_start AND l.t_end
    GROUP BY 1, 2""", "lines"))
def _(spark, sf):
    dim = src.lines(spark, sf).withColumn("t_end", F.expr("CASE WHEN line % 4 = 0 THEN t_start - 1 ELSE t_end END"))
    return select.pick_lines(src.samples(spark, sf), dim, src.flights(spark, sf))[1]


@query("j2_whole_windows", "J2", sql=sql("SELECT rn, pos FROM numbered WHERE pos < n_line - n_line % 16", "numbered"))
def _(spark, sf):
    return sequence.number_rows(select.whole_windows(numbered(spark, sf), 16)).select("rn", "pos")


@query("u1_stacked_features", "U1", "P23", sql=sql(f"""SELECT flight, line, rn, {r('mag_1_uc', 'mag_1_uc')},
    {r('fx', 'flux_0')}, {r('fy', 'flux_1')}, {r('fz', 'flux_2')} FROM samples WHERE line % 2 = 0
    UNION ALL SELECT flight, line, rn, {r('mag_1_uc', 'mag_1_uc')},
    {r('fx', 'flux_0')}, {r('fy', 'flux_1')}, {r('fz', 'flux_2')} FROM samples WHERE line % 2 = 1""", "samples"))
def _(spark, sf):
    df = src.samples(spark, sf).select("*", *[F.col(f"flux_a.{a}").alias(f"_f{a}") for a in "xyz"])
    part = lambda odd: select.select_features(df.filter(F.col("line") % 2 == odd), ["mag_1_uc", "flux"], ["flux"],
                                              {"flux": ["_fx", "_fy", "_fz"]})
    out, names, _exempt = select.stack_features([part(0), part(1)])
    return out.select(*KEY, *rounded(**{n: F.col(n) for n in names}))


@query("a1_error_measures", "A1", sql=sql(f"""SELECT flight, line, {r('sqrt(avg(e * e))', 'rmse', 5)},
    {r('avg(abs(e))', 'mae', 5)}, {r('stddev_pop(e)', 'std', 5)} FROM
    (SELECT flight, line, mag_1_uc - mag_1_c AS e FROM samples) GROUP BY 1, 2""", "samples"))
def _(spark, sf):
    e = F.col("mag_1_uc") - F.col("mag_1_c")
    return src.samples(spark, sf).groupBy("flight", "line").agg(
        *rounded(5, rmse=stats.rmse(e), mae=stats.mae(e), std=stats.spread(e)))


def _stat_sql(c):
    return f"""SELECT '{c}' AS feature, {r(f'avg({c})', 'mean', 4)}, {r(f'stddev_pop({c})', 'std', 4)},
    {r(f'min({c})', 'min', 4)}, {r(f'max({c})', 'max', 4)}, {r(f'sqrt(avg({c} * {c}))', 'rmse', 4)},
    {r(f'avg(abs({c}))', 'mae', 4)} FROM samples"""


@query("a2_column_stats", "A2", sql=sql(" UNION ALL ".join(map(_stat_sql, ["mag_1_uc", "mag_2_c", "roll"])), "samples"))
def _(spark, sf):
    return stats.column_stats(src.samples(spark, sf), ["mag_1_uc", "mag_2_c", "roll"], 4)


@query("a3_line_lengths", "A3", sql=sql("SELECT line, count(*) AS n FROM samples GROUP BY 1", "samples"))
def _(spark, sf):
    return stats.line_lengths(src.samples(spark, sf))


_LAGS = ", ".join(r(f"coalesce(lag(mag_1_uc, {i}) OVER w, mag_1_uc)", f"mag_1_uc_lag_{i}") for i in (1, 2, 3))


@query("w3_lags", "W3", sql=sql(f"SELECT rn, {_LAGS} FROM samples WINDOW w AS (PARTITION BY flight, line ORDER BY rn)", "samples"))
def _(spark, sf):
    got = differences.add_lags(numbered(spark, sf), ["mag_1_uc"])
    return got.select("rn", *rounded(**{f"mag_1_uc_lag_{i}": F.col(f"mag_1_uc_lag_{i}") for i in (1, 2, 3)}))


_LEGS = """, legs AS (SELECT *, min(rn) OVER i AS leg, rn - min(rn) OVER i AS leg_pos, count(*) OVER i AS leg_n
    FROM numbered WINDOW i AS (PARTITION BY flight, line, rn - pos))"""


@query("w5_segments", "W5", sql=sql(_LEGS + """ SELECT rn, line, leg FROM legs WHERE leg_n >= 3 + 2 * 8
    AND leg_pos >= 8 AND leg_pos < leg_n - 8""", "numbered"))
def _(spark, sf):
    return segments.segments(src.samples(spark, sf), "all", 3, 8).select("rn", "line", "leg")


@query("w6_row_selection", "W6", sql=sql(_LEGS + """, picked AS (SELECT rn, row_number() OVER (ORDER BY rn) - 1 AS p,
    count(*) OVER () AS n FROM legs WHERE leg_n >= 50 AND leg_n > 10 AND leg_pos >= 5 AND leg_pos < leg_n - 5 AND rn % 3 IN (0, 2))
    SELECT rn FROM picked WHERE p % CAST(greatest(ceil(n / 700.0), 1) AS BIGINT) = 0""", "numbered"))
def _(spark, sf):
    return segments.select_rows(src.samples(spark, sf), "all", 50, 5, 3, [0, 2], 700, 3).select("rn")


@query("w7_downsample", "W7", sql="""SELECT event_id AS rn FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p,
    count(*) OVER () AS n FROM events) WHERE p % CAST(greatest(ceil(n / 300.0), 1) AS BIGINT) = 0""")
def _(spark, sf):
    return segments.downsample(src.samples(spark, sf), 300).select("rn")


@query("w8_line_errors", "W8", sql=sql(f"""SELECT rn, {r('e - avg(e) OVER (PARTITION BY flight, line)', 'err', 7)},
    {r('avg(e) OVER (PARTITION BY flight, line) - e', 'flipped', 7)}
    FROM (SELECT *, mag_1_c - mag_1_uc AS e FROM samples)""", "samples"))
def _(spark, sf):
    df = stats.line_errors(src.samples(spark, sf), "mag_1_c", "mag_1_uc")
    df = stats.line_errors(df, "mag_1_c", "mag_1_uc", "flipped", flip=True)
    return df.select("rn", *rounded(7, err=F.col("err"), flipped=F.col("flipped")))

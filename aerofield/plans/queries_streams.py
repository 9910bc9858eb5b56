"""Registered queries: sources and sinks through files, and live flights."""
from pyspark.sql import functions as F

from aerofield.plans.queries_maps import _JOIN, blend, located, squares
from aerofield.plans.registry import query, r, rounded, sql
from aerofield.session import scratch
from aerofield.sources import adapters as src, ingest
from aerofield.streaming import live

HEADER = ["flight_no", "line", "tt", "rn", "mag_1_uc", "alt"]


def _text_files(spark, sf):
    """The samples as flight text, with stars for a missing altitude."""
    df = src.samples(spark, sf)
    value = lambda c: F.when((F.col(c) == 300.0) if c == "alt" else F.lit(False), F.lit("*")).otherwise(F.col(c).cast("string"))
    row = F.concat_ws("  ", *[value(c) for c in ("line", "line", "tt", "rn", "mag_1_uc", "alt")])
    path = scratch(spark, "text")
    df.select(F.concat(F.lit("  "), row).alias("value")).write.text(path)
    spark.createDataFrame([(" ".join(HEADER),)], "value string").coalesce(1).write.mode("append").text(path)
    return path


def _flight_files(spark, sf):
    """Two kinds of flight files with a header each, the columns in another order."""
    df = src.samples(spark, sf)
    text = {c: F.when(F.col(c) == 300.0, F.lit("*")).otherwise(F.col(c).cast("string")) if c == "alt" else F.col(c).cast("string")
            for c in ("line", "tt", "rn", "mag_1_uc", "alt")} | {"flight_no": F.col("line").cast("string")}
    path = scratch(spark, "flights")
    for odd, names in ((0, HEADER), (1, HEADER[::-1])):
        rows = df.filter(F.col("rn") % 2 == odd).select(*[text[c].alias(c) for c in names])
        rows.write.mode("append").option("header", True).option("sep", " ").csv(path)
    return path


_TEXT = f"SELECT CAST(line AS DOUBLE) AS line, CAST(rn AS DOUBLE) AS rn, {r('tt', 'tt')}, {r('mag_1_uc', 'mag_1_uc')}, CASE WHEN alt <> 300 THEN alt END AS alt FROM samples"


@query("s1_flight_text", "S1", sql=sql(_TEXT, "samples"))
def _(spark, sf):
    got = ingest.read_flight_text(spark, _flight_files(spark, sf))
    return got.select("line", "rn", *rounded(tt=F.col("tt"), mag_1_uc=F.col("mag_1_uc")), "alt")


@query("s2_delimited_text", "S2", sql=sql(f"SELECT line, rn, {r('tt', 'tt')}, {r('mag_1_uc', 'mag_1_uc')} FROM samples", "samples"))
def _(spark, sf):
    path = scratch(spark, "csv")
    cols = ["line", "rn", "tt", "mag_1_uc"]
    rows = src.samples(spark, sf).select(F.concat_ws(";  ", *[F.col(c).cast("string") for c in cols]).alias("value"))
    # every part file gets the header, as separate flight files have
    rows.select(*[F.get(F.split("value", ";"), F.lit(i)).alias(c) for i, c in enumerate(cols)]).write.option(
        "header", True).option("sep", ";").csv(path)
    got = ingest.read_delimited(spark, path, ";", "line bigint, rn bigint, tt double, mag_1_uc double")
    return got.select("line", "rn", *rounded(tt=F.col("tt"), mag_1_uc=F.col("mag_1_uc")))


@query("s6_written_samples", "S6", "S5", sql=sql(f"SELECT flight, line, rn, {r('mag_1_uc', 'mag_1_uc')} FROM samples", "samples"))
def _(spark, sf):
    path = scratch(spark, "samples")
    ingest.write_samples(src.samples(spark, sf).select("flight", "line", "rn", "tt", "mag_1_uc"), path)
    return spark.read.parquet(path).select("flight", "line", "rn", *rounded(mag_1_uc=F.col("mag_1_uc")))


@query("s7_saved_flight_table", "S7", sql=sql(f"SELECT flight, count(*) AS n, {r('sum(mag_1_uc)', 'total', 3)} FROM samples GROUP BY 1", "samples"))
def _(spark, sf):
    # a table location in shared scratch, so that no warehouse folder is needed
    path = scratch(spark, "flights")
    name = path.rpartition("/")[2].replace("-", "_")
    df = src.samples(spark, sf).select("flight", "line", "rn", "mag_1_uc")
    ingest.save_flight(df, name, path=path)
    ingest.save_flight(df.filter("rn % 2 = 0"), name, path=path)  # present: left alone
    saved = spark.read.schema(spark.table(name).schema).parquet(path)
    spark.sql(f"DROP TABLE {name}")  # the data stay at their location
    return saved.groupBy("flight").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mag_1_uc"), 3).alias("total"))


@query("e3_ingest", "S1", "S3", "S5", "S6", sql=sql(f"""SELECT CASE WHEN line // 100 % 2 = 0 THEN 'even' ELSE 'odd' END AS flight, count(*) AS n,
    count(*) AS ids, {r('sum(mag_1_uc)', 'total', 3)}, {r('min(tt)', 'first')}, {r('max(tt)', 'last')}, 0 AS shared FROM samples GROUP BY 1""", "samples"))
def _(spark, sf):
    out = scratch(spark, "ingested")
    df = src.samples(spark, sf).withColumn("odd", F.floor(F.col("line") / 100) % 2)
    paths = {}
    for odd, cols in ((0, ["line", "tt", "mag_1_uc"]), (1, ["mag_1_uc", "line", "tt"])):
        paths[odd] = scratch(spark, "flight-text")
        df.filter(F.col("odd") == odd).select(*cols).write.option("header", True).option("sep", " ").csv(paths[odd])
    ingest.ingest(spark, paths[0], out, "even", sort=False)
    ingest.ingest(spark, paths[1], out, "odd")
    ingest.ingest(spark, paths[0], out, "even")  # again: takes the place of the first
    rows = spark.read.parquet(f"{out}/samples")
    shared = rows.groupBy("rn").count().filter("count > 1").agg(F.count("*").cast("int").alias("shared"))
    return rows.groupBy("flight").agg(
        F.count("*").alias("n"), (F.max("rn") - F.min("rn") + 1).alias("ids"), F.round(F.sum("mag_1_uc"), 3).alias("total"),
        *rounded(first=F.min("tt"), last=F.max("tt"))).join(F.broadcast(shared))  # one row


_KEPT = """, ranges AS (SELECT line, t_start AS t0, t_end AS t1 FROM lines WHERE line % 3 = 0)"""


@query("r1_stream_ingest", "R1", "S1", "S4", sql=sql(_KEPT + f"""SELECT CAST(line AS DOUBLE) AS line, CAST(rn AS DOUBLE) AS rn, {r('tt', 'tt')} FROM samples s
    WHERE NOT EXISTS (SELECT 1 FROM ranges x WHERE x.line = s.line AND s.tt BETWEEN x.t0 AND x.t1)""", "lines"))
def _(spark, sf):
    ranges = src.lines(spark, sf).filter("line % 3 = 0").select(F.col("line").cast("double").alias("line"),
                                                              F.col("t_start").alias("t0"), F.col("t_end").alias("t1"))
    rows = live.stream_text(spark, _text_files(spark, sf), HEADER)
    got = live.run_available(live.live_ingest(rows, ranges, "exclude"))
    return got.select("line", "rn", *rounded(tt=F.col("tt")))


@query("r1_stream_decimated", "R1", "S3", sql=sql(f"""SELECT CAST(rn AS DOUBLE) AS rn FROM samples
    WHERE (tt + 1e-6) - floor((tt + 1e-6) / 0.1) * 0.1 < 1e-3""", "samples"))
def _(spark, sf):
    rows = live.stream_text(spark, _text_files(spark, sf), HEADER)
    return live.run_available(live.live_ingest(rows, decimated=True)).select("rn")


def _stream(spark, sf):
    df = src.samples(spark, sf, src.event_stream(spark, sf))
    return df.withColumn("ts", live.event_time(F.col("tt"))).withColumn("e", F.col("mag_1_uc") - F.col("mag_1_c"))


@query("r2_r3_step_and_variance", "R2", "R3", "W15", sql=sql(f"""SELECT flight, rn, {r('coalesce(tt - lag(tt) OVER w, 0.1)', 'step', 5)},
    {r('''CASE WHEN row_number() OVER w > 10 THEN least(greatest(avg(e * e) OVER (PARTITION BY flight ORDER BY tt, rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)
    - 0.25, 1.0), 400.0) ELSE 4.0 END''', 'variance', 9)} FROM (SELECT *, mag_1_uc - mag_1_c AS e FROM samples)
    WINDOW w AS (PARTITION BY flight ORDER BY tt, rn)""", "samples"))
def _(spark, sf):
    rows, end = live.closable(_stream(spark, sf).select("flight", "rn", "tt", "ts", F.col("e").alias("resid"), F.lit(0.25).alias("hph")))
    got = live.run_available(live.steps_and_variance(rows, 0.1, 4.0, 1.0, 400.0), end=end)
    return got.select("flight", "rn", *rounded(5, step=F.col("step")), *rounded(9, variance=F.col("variance")))


@query("r4_live_map_residual", "R4", "J3", sql=sql(squares("cells") + located("SELECT rn, mag_1_uc, xx AS x, yy AS y FROM samples")
    + f"SELECT rn, {r(blend(), 'map_val', 9)}, {r(f'mag_1_uc - {blend()}', 'residual', 9)} FROM pt {_JOIN}", "samples", "cells"))
def _(spark, sf):
    pts = _stream(spark, sf).select("rn", F.lit("parts").alias("map_id"), F.col("xx").alias("x"), F.col("yy").alias("y"), "mag_1_uc")
    got = live.run_available(live.live_map_residual(pts, src.map_cells(spark, sf), "mag_1_uc"))
    return got.select("rn", *rounded(9, map_val=F.col("map_val"), residual=F.col("residual")))


def _ended(spark, sf):
    cols = ["flight", "line", "rn", "tt", "ts", "e", "mag_1_uc"]
    return live.closable(_stream(spark, sf).select(*cols))


_BACK = ", ".join(f"coalesce(lag(mag_1_uc, {k}) OVER w, first_value(mag_1_uc) OVER w)" for k in range(4, 0, -1))


@query("r5_row_windows", "R5", "W10", sql=sql(f"""SELECT rn, list_transform([{_BACK}, mag_1_uc], lambda v: round(v, 6)) AS vals FROM samples
    WINDOW w AS (PARTITION BY flight, line ORDER BY tt, rn)""", "samples"))
def _(spark, sf):
    rows, end = live.closable(_stream(spark, sf).select("flight", "line", "rn", "tt", "ts", "mag_1_uc"))
    got = live.run_available(live.row_windows(rows, "mag_1_uc", 5), end=end)
    return got.select("rn", F.transform("values", lambda v: F.round(v, 6)).alias("vals"))


@query("r5_tumbling_errors", "R5", "A1", sql=sql(f""", s AS (SELECT flight, line, mag_1_uc - mag_1_c AS e, CAST(floor((tt + 1704067200) / 21600) AS BIGINT) * 21600 AS slot FROM samples)
    SELECT slot, flight, line, count(*) AS n, {r('sqrt(avg(e * e))', 'rmse', 9)}, {r('avg(abs(e))', 'mae', 9)}, {r('stddev_pop(e)', 'std', 9)} FROM s GROUP BY 1, 2, 3""", "samples"))
def _(spark, sf):
    rows, end = _ended(spark, sf)
    got = live.run_available(live.windowed_errors(rows, "e", "6 hours"), end=end)
    return got.select(F.unix_seconds("window.start").alias("slot"), "flight", "line", "n",
                      *rounded(9, rmse=F.col("rmse"), mae=F.col("mae"), std=F.col("std")))


@query("r5_sliding_errors", "R5", "A1", sql=sql(f""", s AS (SELECT flight, line, mag_1_uc - mag_1_c AS e, (CAST(floor((tt + 1704067200) / 10800) AS BIGINT) - back) * 10800 AS slot
    FROM samples, (VALUES (0), (1)) AS b(back)) SELECT slot, flight, line, count(*) AS n, {r('sqrt(avg(e * e))', 'rmse', 5)} FROM s GROUP BY 1, 2, 3""", "samples"))
def _(spark, sf):
    rows, end = _ended(spark, sf)
    got = live.run_available(live.windowed_errors(rows, "e", "6 hours", "3 hours"), end=end)
    return got.select(F.unix_seconds("window.start").alias("slot"), "flight", "line", "n", *rounded(5, rmse=F.col("rmse")))


@query("r5_window_chunks", "R5", "W11", sql=sql(f""", s AS (SELECT *, CAST(floor((tt + 1704067200) / 3600) AS BIGINT) * 3600 AS slot FROM samples)
    SELECT slot, flight, line, list(mag_1_uc ORDER BY tt, mag_1_uc) AS mag_1_uc FROM s GROUP BY 1, 2, 3""", "samples"))
def _(spark, sf):
    rows, end = _ended(spark, sf)
    got = live.run_available(live.windowed_chunks(rows, "mag_1_uc", "1 hour"), end=end)
    return got.select(F.unix_seconds("window.start").alias("slot"), "flight", "line", "mag_1_uc")


@query("r6_live_legs", "R6", "W5", sql=sql(f""", g AS (SELECT *, CASE WHEN tt - lag(tt) OVER w < 7200 THEN 0 ELSE 1 END AS fresh FROM samples WINDOW w AS (PARTITION BY flight, line ORDER BY tt)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY flight, line ORDER BY tt, rn ROWS UNBOUNDED PRECEDING) AS leg FROM g)
    SELECT flight, line, count(*) AS n, {r('min(tt)', 't_start')}, {r('max(tt)', 't_end')} FROM s GROUP BY flight, line, leg""", "samples"))
def _(spark, sf):
    rows, end = _ended(spark, sf)
    got = live.run_available(live.live_legs(rows, "2 hours"), end=end)
    return got.select("flight", "line", "n", *rounded(t_start=F.col("t_start"), t_end=F.col("t_end")))

"""The driver's parquet tables seen as survey tables.

Samples come from ``events`` (event order is time order), map cells from
``part``, truth and estimates from ``orders`` and ``lineitem``, map tiles from
``embeddings``.
"""
from pyspark.sql import DataFrame, SparkSession, functions as F

from aerofield.functions import attitude
from aerofield.functions.geodesy import magnitude

FLIGHT_ROWS = 2500
LEG_ROWS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    return (spark.readStream.schema(table(spark, sf_dir, "events").schema)
            .option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 64).parquet(sf_dir))


def samples(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Flights of 2500 samples; ten lines per flight flown in legs of 100 samples,
    so that a line returns in up to three contiguous legs."""
    e = F.col("event_id")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    z = (e % 97 + 1).cast("double")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    flight_no = F.floor(e / FLIGHT_ROWS)
    base = (table(spark, sf_dir, "events") if events is None else events).select(
        e.alias("rn"),
        F.concat(F.lit("F"), flight_no.cast("string")).alias("flight"),
        (flight_no * 100 + F.floor(e / LEG_ROWS) % 10).alias("line"),
        (micros / F.lit(1e6)).alias("tt"),
        F.year("ts").alias("year"), F.dayofyear("ts").alias("doy"),
        "user_id", "event_type",
        F.col("value").alias("mag_1_uc"),
        (F.col("value") * 0.9 + k / 100.0).alias("mag_1_c"),
        (F.col("value") * 1.1 + e % 5).alias("mag_2_uc"),
        (F.col("value") * 0.95).alias("mag_2_c"),
        ((e % 7) / 10.0).alias("diurnal"), ((e % 11) / 10.0 + 50.0).alias("igrf"),
        (k / 10.0).alias("cur_strb"), k.alias("k"), z.alias("z"),
        ((e * 37 % 4900) / 100.0 + 1.0).alias("xx"),
        ((e * 53 % 2400) / 100.0 + 1.0).alias("yy"),
        ((e % 61 - 30) / 100.0).alias("roll"), ((e % 41 - 20) / 100.0).alias("pitch"),
        ((e % 628) / 100.0 - 3.14).alias("yaw"),
        ((e % 97) * 1.0 + 300.0).alias("alt"), ((e % 19) * 1.0 - 9.0).alias("vn"),
        ((e % 23) * 1.0 - 11.0).alias("ve"), ((e % 3) * 1.0 - 1.0).alias("vd"))
    x, y = F.col("mag_1_uc"), F.col("k")
    return base.select(
        *[c for c in base.columns if c not in ("k", "z")],
        F.radians(F.col("yy") + 30.0).alias("lat"), F.radians(F.col("xx") - 100.0).alias("lon"),
        F.struct(x.alias("x"), y.alias("y"), F.col("z").alias("z"),
                 magnitude(x, y, F.col("z")).alias("t")).alias("flux_a"),
        attitude.from_euler(F.col("roll"), F.col("pitch"), F.col("yaw"), "body2nav").alias("cnb"),
    ).withColumn("ins_lat", F.col("lat") + (F.col("rn") % 13 - 6) * 1e-7
    ).withColumn("ins_lon", F.col("lon") + (F.col("rn") % 17 - 8) * 1e-7
    ).withColumn("ins_alt", F.col("alt") + F.col("rn") % 5 - 2.0)


def filter_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three filters' estimates and covariance diagonals for every sample; the
    last one has no eighteenth state."""
    rn = F.col("rn")
    states = lambda n, f: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)
    size = lambda i: F.when(i < 2, F.lit(1e-8)).otherwise(F.lit(0.1))
    est = lambda i: ((rn + F.col("f") * 3 + i * 5) % 11 - 5) * size(i)
    var = lambda i: F.pow(((rn + i) % 7 + 1) * size(i), F.lit(2.0))
    many = samples(spark, sf_dir).select("flight", "line", "rn", F.explode(F.array(*[
        F.struct(F.lit(i).alias("f"), F.lit(n).alias("filter")) for i, n in enumerate(("ekf", "mpf", "nekf"))])).alias("s")
        ).select("flight", "line", "rn", "s.*")
    both = lambda f: F.when(F.col("f") < 2, states(18, f)).otherwise(states(17, f))
    return many.select("filter", "flight", "line", "rn", both(est).alias("x"), both(var).alias("p_diag"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dimension: each line's time range, a fiftieth narrower at both ends."""
    span = samples(spark, sf_dir).groupBy("flight", "line").agg(
        F.min("tt").alias("a"), F.max("tt").alias("b"))
    cut = (F.col("b") - F.col("a")) * 0.02
    return span.select("flight", "line", (F.col("a") + cut).alias("t_start"),
                       (F.col("b") - cut).alias("t_end"), F.lit("parts").alias("map_name"))


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("flight").distinct().select(
        "flight", F.lit("XYZ1").alias("xyz_type"), F.lit(1).alias("xyz_set"),
        F.concat_ws("/", F.lit("data"), "flight").alias("xyz_file"))


def flight_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).filter(F.col("event_type") == "error")
    return s.select("flight", "tt", F.concat_ws(" ", F.lit("Error in leg"),
                                                F.col("line").cast("string")).alias("event"))


def map_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_cells(spark, sf_dir).select("map_id").distinct().select(
        F.col("map_id").alias("map_name"),
        F.concat(F.lit("maps/"), F.col("map_id")).alias("map_file"))


def map_cells(spark: SparkSession, sf_dir: str, split: str = "one") -> DataFrame:
    """Observed cells of price maps on a size by brand grid.

    ``one`` is a single map, ``parity`` one map per odd/even part key, ``type``
    one map per part type, ``levels`` a two-level map from the parity halves.
    Cells without parts are absent.
    """
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long")
    odd = F.col("p_partkey") % 2
    name = {"one": F.lit("parts"), "parity": F.when(odd == 1, F.lit("odd")).otherwise(F.lit("even")),
            "type": F.col("p_type"), "levels": F.lit("deep")}[split]
    level = odd if split == "levels" else F.lit(0)
    got = table(spark, sf_dir, "part").groupBy(
        name.alias("map_id"), level.cast("long").alias("iz"),
        brand.alias("iy"), F.col("p_size").cast("long").alias("ix")).agg(
        F.round(F.sum(F.col("p_retailprice").cast("decimal(18,4)")).cast("double")
                / F.count(F.lit(1)), 4).alias("val"))
    return got.select("map_id", "iz", "iy", "ix", F.col("ix").cast("double").alias("xx"),
                      F.col("iy").cast("double").alias("yy"),
                      (F.col("iz") * 100.0 + 300.0).alias("alt"), "val",
                      F.lit(True).alias("mask"))


def tiles(spark: SparkSession, sf_dir: str, nx: int = 8) -> DataFrame:
    """Small square-celled maps, one per embedding vector, in arrays: ``xx``,
    ``yy`` in degrees and ``val[iy][ix]``."""
    size = F.size("embedding")
    rows = F.transform(F.sequence(F.lit(0), F.floor(size / nx).cast("int") - 1),
                       lambda i: F.transform(F.slice("embedding", i * nx + 1, nx),
                                             lambda v: v.cast("double")))
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("map_id"),
        F.transform(F.sequence(F.lit(0), F.lit(nx - 1)), lambda i: i * 0.01 - 80.0).alias("xx"),
        F.transform(F.sequence(F.lit(0), F.floor(size / nx).cast("int") - 1),
                    lambda i: i * 0.01 + 45.0).alias("yy"),
        F.array(F.col("label") * 10.0 + 300.0, F.col("label") * 10.0 + 320.0).alias("alt"),
        rows.alias("val"))

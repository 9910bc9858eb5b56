"""Flight text files, ingest rules, and flight tables."""
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from aerofield.operators.intervals import in_ranges
from aerofield.operators.sequence import blockwise, exact_median, number_rows, range_ranked, unnumbered
from aerofield.session import materialized, small


def read_flight_text(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated flight text; the first line of each file names its columns.

    Every value becomes a number; ``*``, unreadable values and columns that a file
    lacks become null.
    """
    lines = spark.read.text(path).select(
        F.split(F.trim("value"), r"\s+").alias("v"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    heads = materialized(lines.filter((F.size("v") > 1) & (F.col("_block") == 0)).groupBy("_file").agg(
        F.min_by("v", "_id").alias("_head")), "headers")
    layouts = [r["_head"] for r in heads.select("_head").distinct().orderBy("_head").limit(1001).collect()]
    if not layouts:
        raise ValueError(f"no header in {path}")
    if len(layouts) > 1000:
        raise ValueError(f"more than 1000 layouts in {path}")
    if len(layouts) == 1:
        return parse_flight_text(lines.filter(F.col("v") != F.array(*[F.lit(h) for h in layouts[0]])), layouts[0])
    rows = lines.join(small(heads), "_file").filter((F.col("v") != F.col("_head")) & ((F.size("v") > 1) | (F.col("v")[0] != "")))
    names = list(dict.fromkeys(n for layout in layouts for n in layout))
    at = lambda n: F.array_position("_head", n).cast("int") - 1
    return rows.select(*[F.when(at(n) >= 0, F.get("v", F.greatest(at(n), F.lit(0)))).try_cast("double").alias(n) for n in names])


def parse_flight_text(rows: DataFrame, header: list[str]) -> DataFrame:
    """Numbers from rows of split text (``v``)."""
    return rows.filter((F.size("v") > 1) | (F.col("v")[0] != "")).select(
        *[F.get("v", F.lit(i)).try_cast("double").alias(h) for i, h in enumerate(header)])


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", schema=None) -> DataFrame:
    """Delimited flight file with a header, spaces after the delimiter skipped.
    Give the schema where it is known; inferring reads the file twice."""
    reader = spark.read.option("header", True).option("sep", delimiter).option(
        "ignoreLeadingWhiteSpace", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def decimate(df: DataFrame) -> DataFrame:
    """Keep the 10 Hz samples of faster recordings: time a multiple of 0.1 s."""
    return unnumbered(df.filter(_modulo(F.col("tt") + 1e-6, 0.1) < 1e-3))


def _modulo(x: Column, step: float) -> Column:
    return x - F.floor(x / step) * step


def filter_ranges(df: DataFrame, ranges: DataFrame, kind: str = "exclude") -> DataFrame:
    """Keep or drop samples inside closed (line, t0, t1) ranges.  Dropping keeps
    rows whose line or time is null; an unknown kind changes nothing."""
    if kind not in ("exclude", "include"):
        print(f"unknown line filter {kind!r}: no rows filtered")
        return df
    return unnumbered(in_ranges(df, ranges, ["line"], "tt", "t0", "t1", kind == "include"))


def sort_by_time(df: DataFrame) -> DataFrame:
    """Total order by time, nulls last: a range sort, not a single partition."""
    return df.orderBy(F.col("tt").asc_nulls_last(), "rn")


def time_places(df: DataFrame) -> DataFrame:
    """Place of each sample in its flight's time order (``pos``), nulls last and
    equal times by row id."""
    return range_ranked(df, [F.col("tt").asc_nulls_last(), "rn"], ["flight"])


def assign_rows(df: DataFrame) -> DataFrame:
    """Give ingested rows their permanent ids: dense per flight in time order, then
    offset by flight so that they are unique over the table.  ``df`` needs a
    provisional unique ``rn`` for equal times."""
    placed = time_places(df)
    sizes = df.groupBy("flight").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("flight", F.coalesce(F.sum("_n").over(
        Window.orderBy("flight").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return (placed.join(offsets, "flight").withColumn("rn", F.col("_o") + F.col("pos")).drop("pos", "_o"))


def flight_meta(df: DataFrame, default: float = 0.1) -> DataFrame:
    """Rows and time step per flight: the median difference, to nine digits."""
    sizes = df.groupBy("flight").agg(F.count(F.lit(1)).alias("n"))
    slim = number_rows(df.select("flight", "rn", "tt"), ["flight"])
    steps = blockwise(slim, lambda w: {"_d": F.round(F.col("tt") - F.lag("tt").over(w), 9)},
                      before=1, keys=["flight"])
    mid = exact_median(steps, ["flight"], "_d", "dt")
    return sizes.join(mid, "flight", "left").select(
        "flight", "n", F.round(F.coalesce("dt", F.lit(default)), 9).alias("dt"))


def write_samples(df: DataFrame, path: str, mode: str = "errorifexists") -> bool:
    """Write samples by flight, sorted by line and row inside each file; nothing
    for an empty frame.  A flight is spread over files by row blocks, so one big
    flight is written by many tasks.  ``overwrite`` replaces the frame's flights and
    leaves the others."""
    if df.isEmpty():
        return False
    block = F.floor(F.col("rn") / 4_000_000)
    (df.repartition("flight", block).sortWithinPartitions("flight", "line", "rn")
     .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("flight").parquet(path))
    return True


def _next_row(spark: SparkSession, path: str, flight: str) -> int:
    """The first row id after those of all other stored flights."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:  # nothing stored yet
        return 0
    last = stored.filter(F.col("flight") != flight).agg(F.max("rn")).first()[0]
    return 0 if last is None else last + 1


def ingest(spark: SparkSession, text: str, out: str, flight: str, ranges: DataFrame | None = None,
           kind: str = "exclude", decimated: bool = False, sort: bool = True) -> bool:
    """Text file to a flight's rows in the sample table, with its meta table.  Row ids
    are dense in the flight and unique over the table; a flight ingested again takes the
    place of its earlier rows."""
    df = read_flight_text(spark, text)
    if decimated and "tt" in df.columns:
        df = decimate(df)
    if ranges is not None and {"line", "tt"} <= set(df.columns):
        df = filter_ranges(df, ranges, kind)
    df = df.withColumn("flight", F.lit(flight)).withColumn("rn", F.monotonically_increasing_id())
    if sort and "tt" in df.columns:
        df = assign_rows(df)
    else:
        df = number_rows(df, ["flight"]).withColumn("rn", F.col("pos")).drop("pos", "n_line")
    df = df.withColumn("rn", F.col("rn") + _next_row(spark, f"{out}/samples", flight))
    if not write_samples(df, f"{out}/samples", "overwrite"):
        return False
    stored = spark.read.parquet(f"{out}/samples").filter(F.col("flight") == flight)
    flight_meta(stored).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("flight").parquet(f"{out}/flight_meta")
    return True


def save_flight(df: DataFrame, table: str, overwrite: bool = False, path: str | None = None) -> None:
    """Save a flight table (at ``path`` if given); an existing one is left alone unless
    overwriting."""
    options = {"path": path} if path else {}
    df.write.mode("overwrite" if overwrite else "ignore").format("parquet").saveAsTable(table, **options)


def data_set_name(project: str, kind: str) -> Column:
    return F.concat(F.lit(f"{project}_Flt"), F.col("flight"), F.lit("_L"),
                    F.col("line").cast("string"), F.lit(f".{kind}"))


def register_dimensions(**dims: DataFrame) -> None:
    """Temporary views ``dim_<name>`` of the dimension frames."""
    for name, df in dims.items():
        df.createOrReplaceTempView(f"dim_{name}")


def field_operation(df: DataFrame, action: str, field: str, value: Column | str | None = None) -> DataFrame:
    """Delete, write (new only), overwrite, rename, read or clear one field."""
    present = field in df.columns
    if action in ("delete", "overwrite", "rename", "read", "clear") and not present:
        raise ValueError(f"no field {field}")
    if action == "write" and present:
        raise ValueError(f"field {field} exists")
    if action == "delete":
        return df.drop(field)
    if action in ("write", "overwrite"):
        return df.withColumn(field, value)
    if action == "rename":
        return df.withColumnRenamed(field, value)
    if action == "clear":
        return df.withColumn(field, F.lit(None).cast(df.schema[field].dataType))
    if action == "read":
        return df.select(field)
    raise ValueError(f"unknown action {action!r}")


def differing_fields(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that differ per field; 1 for a field only one table has."""
    fa, fb = ([c for c in d.columns if c not in keys] for d in (a, b))
    both = [c for c in fa if c in fb]
    one_sided = [c for c in fa if c not in fb] + [c for c in fb if c not in fa]
    joined = a.select(*keys, *both).join(
        b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in both]), keys, "full_outer")
    row = joined.agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"_b_{c}"))).alias(c) for c in both])
    items = [F.struct(F.lit(c).alias("field"), F.col(c).alias("differing")) for c in both]
    items += [F.struct(F.lit(c).alias("field"), F.lit(1).cast("long").alias("differing")) for c in one_sided]
    return row.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def export_path(df: DataFrame, limit: int | None = None, units: str = "rad") -> DataFrame:
    """Positions of each flight in degrees: all of them, or every k-th so that a
    flight has at most ``limit`` (map viewers take 30,000 vertices or 1,000 points)."""
    if units not in ("rad", "deg"):
        raise ValueError(f"unsupported units {units!r}")
    deg = F.degrees if units == "rad" else F.col
    rows = number_rows(df.select("flight", "rn", "lat", "lon", "alt"), ["flight"])
    step = F.ceil(F.col("n_line") / limit) if limit else F.lit(1)
    return rows.filter(F.col("pos") % step == 0).select("flight", "rn", deg("lat").alias("lat"),
                                                        deg("lon").alias("lon"), "alt")


def write_path(df: DataFrame, path: str, limit: int | None = None) -> None:
    """Exported path as GeoJSON-like lines, one feature per position."""
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat", "alt").alias("coordinates")).alias("geometry"),
        F.struct("flight", "rn").alias("properties")))
    export_path(df, limit).select(feature.alias("value")).write.mode("overwrite").text(path)

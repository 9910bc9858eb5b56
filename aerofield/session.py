"""Session settings, scratch storage, size-checked broadcasts and the package for workers."""
import atexit
import os
import shutil
import tempfile
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: int | str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench, with a scratch folder of its own
    that goes when the process ends."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("aerofield")
             .config("spark.sql.shuffle.partitions", str(shuffle))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", _own_folder())
             .config("spark.driver.memory", memory)
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_folders: list[str] = []


def _own_folder() -> str:
    """One temporary folder of this process, removed at its end."""
    if not _folders:
        _folders.append(tempfile.mkdtemp(prefix="aerofield-"))
        atexit.register(shutil.rmtree, _folders[0], ignore_errors=True)
    return _folders[0]


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``, in one folder per
    application, which a cluster's clean-up can remove as a whole; only a local session
    without that setting uses a temporary folder, removed when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="zip-", dir=_own_folder())
        made = shutil.make_archive(os.path.join(folder, "aerofield"), "zip", os.path.dirname(here), "aerofield")
        context.addPyFile(made)


SMALL_BYTES = 64 << 20
_held: deque = deque()


def small(df: DataFrame, rows: int = 100_000, kept: int = 32) -> DataFrame:
    """Mark ``df`` for broadcast if it holds at most ``rows`` rows and SMALL_BYTES of
    text, else leave the join to the optimizer.  The rows counted are kept, so a
    dimension that is itself an aggregate is computed once; of such dimensions the
    last ``kept`` stay cached, an older one is computed again if it is still used."""
    held = df.persist()
    n, size = held.limit(rows + 1).agg(F.count("*"), F.sum(F.length(F.to_json(F.struct("*"))))).first() if df.columns else (0, 0)
    if n <= rows and (size or 0) <= SMALL_BYTES:
        _held.append(held)
        while len(_held) > kept:
            _held.popleft().unpersist()
        return F.broadcast(held)
    held.unpersist()
    return df


def materialized(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to shared scratch storage and read back: cuts the lineage of
    iterative work and survives the loss of executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """Like ``materialized``, in as many buckets of ``key`` as the session has shuffle
    partitions, a file each: a join by ``key`` shuffles only its other side.  Only tables
    can have buckets; its name goes again at once, which leaves the files."""
    spark, name = df.sparkSession, f"aerofield_{label}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.format("parquet").option("path", scratch(spark, label)).bucketBy(n, key).saveAsTable(name)
    out = spark.table(name)
    out.schema  # looked up while the name is there
    spark.sql(f"DROP TABLE {name}")
    return out


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a ``materialized`` for tables that are spent when the block ends: they are in
    a database of their own in scratch storage, which is dropped then."""
    base = f"aerofield_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {base} LOCATION '{scratch(spark, 'passing')}'")

    def stored(df: DataFrame, label: str) -> DataFrame:
        df.write.format("parquet").saveAsTable(f"{base}.{label}")
        return spark.table(f"{base}.{label}")

    try:
        yield stored
    finally:
        spark.sql(f"DROP DATABASE {base} CASCADE")

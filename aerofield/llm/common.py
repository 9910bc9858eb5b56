"""Words of raw texts, reserved column names, runs of equal keys and exact cuts."""
import gc
import re
import time
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = re.compile(rb"[ \t-\r]")
WORD = r"[^\x20\x09-\x0D]+"


BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def whole_texts(docs: DataFrame) -> DataFrame:
    """``docs``, whose whole texts go to Python workers: caps the session's rows per Arrow
    batch, as 10,000 texts of some hundred KB would not fit a worker.  A smaller setting
    of the session stays."""
    conf = docs.sparkSession.conf
    now = int(conf.get(BATCH_CONF))
    if not 0 < now <= BATCH_ROWS:
        conf.set(BATCH_CONF, str(BATCH_ROWS))
    return docs


def swept(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that have ended: it does so for plans that
    the driver's garbage collection finds unused, which may come late by itself."""
    for _ in range(2):  # the plan of the last job is let go only after the first
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_blocks(data: bytes, lower: bool = True, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in blocks of about ``size`` bytes, so
    that a very long text never becomes one list.  ``bytes.split`` breaks at exactly
    those six characters."""
    at, end = 0, len(data)
    while at < end:
        cut = end
        if end - at > size:
            found = _SPACE.search(data, at + size)
            cut = found.start() if found else end
        piece = data[at:cut]
        yield (piece.translate(LOWER) if lower else piece).split()
        at = cut


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, lengthened until no given column has it (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of a value as text, modulo n; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def uniform(seed: int, *cols: Column) -> Column:
    """A reproducible draw in (0, 1) for each row, from the md5 of seed and columns
    (nulls as a mark of their own)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def pack(a: np.ndarray) -> bytes:
    """Compressed byte planes of an array."""
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).reshape(-1)


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def crc32(data) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict, np.ndarray]]:
    """Whole groups of a partition sorted by ``keys``: column arrays and the bounds of
    the groups in them.  A group cut by a batch border waits for its rest."""
    held: dict[str, np.ndarray] | None = None

    def bounds(cols: dict) -> np.ndarray:
        n = len(cols[keys[0]])
        new = np.zeros(n, bool)
        new[:1] = True
        for k in keys:
            new[1:] |= cols[k][1:] != cols[k][:-1]
        return np.append(np.flatnonzero(new), n)

    for batch in batches:
        cols = {}
        for i, f in enumerate(batch.schema):
            c = batch.column(i)
            if pa.types.is_list(f.type):
                flat = c.flatten().to_numpy(zero_copy_only=False)
                cols[f.name] = flat.reshape(len(c), -1) if len(c) else flat.reshape(0, 0)
            else:
                cols[f.name] = c.to_numpy(zero_copy_only=False)
        if not batch.num_rows:
            continue
        if held is not None:
            cols = {k: np.concatenate([held[k], v]) for k, v in cols.items()}
        at = bounds(cols)
        cut = at[-2]
        held = {k: v[cut:] for k, v in cols.items()}
        if cut:
            yield {k: v[:cut] for k, v in cols.items()}, at[:-1]
    if held is not None:
        yield held, np.array([0, len(held[keys[0]])])

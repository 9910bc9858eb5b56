"""Quality selection by importance resampling of hashed n-gram models."""
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from aerofield.llm.common import uniform, whole_texts
from aerofield.llm.quality import Hashes, joined, word_hashes
from aerofield.session import materialized

BUCKETS = 1 << 16
PRIOR = 1_000.0  # n-grams of the raw distribution that the target's counts are mixed with
BINS, EXACT = 4096, 10_000


def buckets(data: bytes, hashes: Hashes) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbouring words."""
    h = word_hashes(data, hashes)
    pairs = joined(h[:-1], h[1:]) if len(h) > 1 else h[:0]
    return (np.concatenate([joined(h), pairs]) >> np.uint64(48)).astype(np.int64) if len(h) else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Ratio:
    """Log ratio of the target's to the raw text's probability of each bucket, and the
    share of good documents among the labelled ones."""
    logs: np.ndarray
    share: float


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", documents: int = 20_000) -> Ratio | None:
    """Raw text: all documents.  Target: those labelled good, of a bounded sample of
    ``labels(doc_id, good)`` (the ``documents`` smallest draws).  Each task adds up its
    buckets; BUCKETS sums come back.  None if no good document is there."""
    sample = materialized(labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min("good").alias("good"))
                          .orderBy(uniform(7, F.col("id"))).limit(documents), "labels")
    share = sample.agg(F.avg(F.col("good").cast("int"))).first()[0]
    if not share:
        return None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sums = Hashes(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for good, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = np.bincount(buckets(data or b"", hashes), minlength=BUCKETS)
                sums[0] += n
                if good:
                    sums[1] += n
        for kind in (0, 1):
            at = np.flatnonzero(sums[kind])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(sums[kind][at])],
                                             names=["kind", "bucket", "n"])

    texts = docs.select(F.col(doc_id).alias("own"), F.col(text).cast("binary").alias("text"))
    rows = texts.join(F.broadcast(sample), F.col("own") == F.col("id"), "left").select("good", "text")
    sums = np.zeros((2, BUCKETS))
    got = rows.mapInArrow(counted, "kind int, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    sums[got["kind"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    if not sums[1].any():
        return None
    raw = (sums[0] + 1.0) / (sums[0].sum() + BUCKETS)
    target = (sums[1] + PRIOR * raw) / (sums[1].sum() + PRIOR)
    return Ratio(np.log(target) - np.log(raw), float(share))


def threshold(keys: DataFrame, k: int) -> float | None:
    """The k-th largest ``key``: counts over bins of the range, then of the bin that
    holds it, until few rows or one value are left.  Null keys do not count."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not n or k <= 0:
        return None
    if k >= n:
        return low
    while n > EXACT and low < high:
        step = (high - low) / BINS
        at = F.least(F.floor((F.col("key") - low) / step), F.lit(BINS - 1)).cast("int")
        counts = (keys.where(F.col("key").between(low, high)).groupBy(at.alias("bin"))
                  .agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("bin")).collect())
        for r in counts:
            if r["n"] >= k:
                low, high, n = r["low"], r["high"], r["n"]
                break
            k -= r["n"]
    if low == high:
        return low
    rest = keys.where(F.col("key").between(low, high)).select("key").collect()  # at most EXACT
    return sorted((r["key"] for r in rest), reverse=True)[k - 1]


def resampled(docs: DataFrame, ratio: Ratio | None, share: float | None = None, doc_id: str = "doc_id", text: str = "text",
              seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, log_weight (the text's log
    importance), key (that plus Gumbel noise of the doc_id's draw) and kept.

    Kept are the k largest keys, where k is ``share`` (default: of the good among the
    labelled) of the documents with words; rows that tie with the last are kept too.
    Null texts and texts without words have no weight and are not kept.  Without a
    target nothing is judged: weights are 0 and every text with words is kept."""
    held = docs.sparkSession.sparkContext.broadcast(ratio.logs if ratio else None)
    kind = T.StructType([T.StructField("n_features", T.LongType()), T.StructField("log_weight", T.DoubleType())])

    @F.pandas_udf(kind)
    def weigh(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        logs, hashes = held.value, Hashes()
        for texts in parts:
            rows = []
            for data in texts:
                b = buckets(data or b"", hashes)
                rows.append((len(b), (float(logs[b].sum()) if logs is not None else 0.0) if len(b) else None))
            yield pd.DataFrame(rows, columns=kind.names).astype({"log_weight": "float64"})

    noise = -F.log(-F.log(uniform(seed, F.col(doc_id))))
    rows = materialized(whole_texts(docs).select(F.col(doc_id).alias("doc_id"), weigh(F.col(text).cast("binary")).alias("w"), noise.alias("noise"))
                        .select("doc_id", "w.*", (F.col("w.log_weight") + F.col("noise")).alias("key")), "weights")
    share = share if share is not None else ratio.share if ratio else 1.0
    n = rows.where("key IS NOT NULL").count()
    least = threshold(rows, math.floor(share * n + 0.5))
    kept = F.coalesce(F.col("key") >= F.lit(least), F.lit(False)) if least is not None else F.lit(False)
    return rows.withColumn("kept", kept)


def labelled(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.coalesce(F.expr("quality = 1"), F.lit(False)).alias("good"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return resampled(docs, train(docs, labelled(labels)))

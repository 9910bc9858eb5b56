"""Sharding by vector bin packing over bytes, tokens and rows."""
import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from aerofield.llm.mixing import words_in
from aerofield.session import materialized

BUNDLES = 4096  # items of small groups; a group above 1 / BUNDLES of any total is an item of its own
SLOT_ROWS = 50_000


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (a vector of shares of the totals).  Largest first, each
    goes where it fits and its dot product with the residual capacity is highest; if
    it fits nowhere, where it overfills least."""
    left = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -items.max(axis=1, initial=0.0))):
        after = left - items[i]
        fits = (after >= -1e-12).all(axis=1)
        at = int(np.where(fits, left @ items[i], -np.inf).argmax()) if fits.any() else int(after.min(axis=1).argmax())
        out[i] = at
        left[at] -= items[i]
    return level(items, out, left)


def level(items: np.ndarray, out: np.ndarray, left: np.ndarray, tolerance: float = 1e-4) -> np.ndarray:
    """Moves of single items from the fullest to the emptiest shard by the first measure
    (the law's), until their gap is small or no item halves it."""
    for _ in range(len(items)):
        low, high = int(left[:, 0].argmax()), int(left[:, 0].argmin())
        gap = left[low, 0] - left[high, 0]
        own = np.flatnonzero(out == high)
        own = own[(items[own, 0] < gap) & (items[own, 0] > 0)]
        if gap < tolerance or not len(own):
            break
        i = own[np.abs(items[own, 0] - gap / 2).argmin()]
        out[i] = low
        left[low] -= items[i]
        left[high] += items[i]
    return out


def sharded(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size (bytes plus 1), tokens, text_crc32, shard
    and slot (gapless from 0 in its shard).

    Rows of equal text are a group and go to one shard.  Only a group that exceeds a
    shard's capacity in bytes, tokens or rows is split, by row, into pieces of half a
    shard at most.  Groups (and pieces) above 1 / BUNDLES of a total are items, at most
    3 * BUNDLES of them; all others are dealt to BUNDLES items by their text's hash.  So
    the packing itself is of bounded size and all else is joins.  Null texts are empty
    texts of one group; repeated rows take slots of their own."""
    sha = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    rows = materialized(docs.select(
        F.col(doc_id).alias("doc_id"), sha.alias("sha"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        words_in(F.col(text)).alias("tokens"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32")), "rows")
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")]
    groups = materialized(rows.groupBy("sha").agg(*sums), "groups")
    total = groups.agg(*[F.sum(c).alias(c) for c in "btr"]).first()
    if not total["r"]:
        return rows.select("doc_id", "size", "tokens", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    largest = F.greatest(*[F.col(c) / max(total[c], 1) for c in "btr"])
    big = groups.withColumn("share", largest).where(F.col("share") > 1.0 / BUNDLES)
    # pieces of a group that no shard can hold
    pieces = F.when(F.col("share") > 1.0 / shards, F.ceil(F.col("share") * 2 * shards)).otherwise(1).cast("int")
    big = materialized(big.select("sha", pieces.alias("pieces")), "large")
    bundle = F.pmod(F.xxhash64("sha"), F.lit(BUNDLES)).cast("int")
    item = F.when(F.col("pieces").isNull(), bundle).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int"))
    keyed = materialized(rows.join(F.broadcast(big), "sha", "left").withColumn("item", item).withColumn(
        "own", F.when(F.col("pieces").isNotNull(), F.col("sha"))).drop("pieces"), "keyed")  # at most 3 * BUNDLES large groups
    items = keyed.groupBy("own", "item").agg(*sums).orderBy("own", "item").collect()
    at = place(np.array([[x[c] / max(total[c], 1) for c in "btr"] for x in items]), shards)
    schema = "own_sha binary, own_item int, shard int"
    table = docs.sparkSession.createDataFrame([(x["own"], x["item"], int(s)) for x, s in zip(items, at)], schema)
    put = materialized(keyed.join(F.broadcast(table), F.col("own").eqNullSafe(F.col("own_sha")) & (F.col("item") == F.col("own_item")))
                       .withColumn("block", F.pmod(F.xxhash64("doc_id", "sha"), F.lit(max(1, math.ceil(total["r"] / SLOT_ROWS)))))
                       .select("doc_id", "sha", "size", "tokens", "text_crc32", "shard", "block"), "put")
    starts = put.groupBy("shard", "block").agg(F.count("*").alias("n"))
    starts = starts.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).drop("n")
    slot = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "sha")) - 1
    return put.withColumn("rank", slot).join(materialized(starts, "starts"), ["shard", "block"]).select(
        "doc_id", "size", "tokens", "text_crc32", "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"))


def query(docs: DataFrame) -> DataFrame:
    return sharded(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                F.lit(None).cast("int").alias("grown_shard"), "tokens")

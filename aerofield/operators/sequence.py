"""Ordered-row building blocks that never put one line into one task.

A flight line may hold a large share of all samples, so nothing here windows
over a whole line.  Rows are numbered through blocks of ``rn``; lags, leads and
rolling frames run inside blocks of consecutive positions, each block carrying a
halo of its neighbours' rows.  A block never holds more than ``block + halo``
rows whatever the line length.
"""
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from aerofield.session import materialized, small

LINE = ("flight", "line")
BLOCK_CONF = "spark.aerofield.blockRows"
FAN = 4096  # blocks summed together


def block_rows(spark: SparkSession) -> int:
    """Rows per block of an ordered operator (session setting, default 65536)."""
    return int(spark.conf.get(BLOCK_CONF, "65536"))


def block_starts(sums: DataFrame, keys: Sequence[str], value: str, total: str | None = None) -> DataFrame:
    """``keys, _rb, _start``: the sum of ``value`` over the blocks of the key before each
    block, and the key's whole sum as ``total``.  ``sums`` has one row per key and block.

    Blocks are themselves summed in blocks of ``FAN``, so the one window over a whole key
    sees a row per ``FAN`` blocks, some 270 million rows of input."""
    def earlier(c: str, w) -> Column:
        zero = F.lit(0).cast(sums.schema[value].dataType)
        return F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), zero)

    up = F.floor(F.col("_rb") / FAN).alias("_up")
    whole = Window.partitionBy(*keys)
    top = sums.groupBy(*keys, up).agg(F.sum(value).alias("_all"))
    top = top.select(*keys, "_up", earlier("_all", whole.orderBy("_up")).alias("_base"),
                     *([F.sum("_all").over(whole).alias(total)] if total else []))
    low = sums.withColumn("_up", up).select(
        *keys, "_rb", "_up", earlier(value, Window.partitionBy(*keys, "_up").orderBy("_rb")).alias("_in"))
    return low.join(top, [*keys, "_up"]).select(
        *keys, "_rb", (F.col("_base") + F.col("_in")).alias("_start"), *([total] if total else []))


def number_rows(df: DataFrame, keys: Sequence[str] = LINE, order: str = "rn",
                pos: str = "pos", total: str = "n_line", size: int | None = None) -> DataFrame:
    """Add the 0-based position of each row among its key, and the key's row count.

    ``order`` must be a unique integer.  Positions come from per-block counts
    plus a row number inside each block, so a key with most of the rows is still
    numbered by many tasks.  ``size`` is the width of a block in units of
    ``order``.  Frames that this function numbered pass through; a frame that got
    the columns elsewhere is numbered anew.  An operator that drops rows drops both
    columns with them, and so must a filter of your own (``unnumbered``).
    """
    mark = {"numbered": ",".join([*keys, order])}
    if {pos, total} <= set(df.columns):
        if df.schema[pos].metadata.get("numbered") == mark["numbered"]:
            return df
        df = df.drop(pos, total)
    size = size or block_rows(df.sparkSession)
    keyed = df.withColumn("_rb", F.floor(F.col(order) / size))
    counts = keyed.groupBy(*keys, "_rb").agg(F.count(F.lit(1)).alias("_n"))
    starts = block_starts(counts, keys, "_n", total)
    inside = Window.partitionBy(*keys, "_rb").orderBy(order)
    return (keyed.join(starts, [*keys, "_rb"])
            .withColumn(pos, (F.col("_start") + F.row_number().over(inside) - 1).alias(pos, metadata=mark))
            .drop("_rb", "_start"))


def range_ranked(df: DataFrame, order: Sequence, keys: Sequence[str] = (), into: str = "pos") -> DataFrame:
    """0-based place of each row in its key by ``order`` (columns of any type).

    The rows are range-partitioned by key and order and stored, so neither a long key
    nor a stuck clock makes a large partition; each stored partition is ranked on its
    own and shifted by the counts of those before it.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    held = materialized(ranged, "ranked")
    part = [*keys, "_part"]
    counts = held.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    prior = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*part, F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_s"))
    inside = Window.partitionBy(*part).orderBy(*order)
    return (held.join(small(starts), part)  # one row per stored partition and key
            .withColumn(into, F.col("_s") + F.row_number().over(inside) - 1).drop("_part", "_s"))


def unnumbered(df: DataFrame) -> DataFrame:
    """``df`` without row positions, for after rows were dropped."""
    return df.drop("pos", "n_line")


def blockwise(df: DataFrame, build: Callable[[object], dict[str, Column]], before: int = 0,
              after: int = 0, keys: Sequence[str] = LINE, pos: str = "pos",
              total: str = "n_line") -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` ahead.

    ``build`` receives a window ordered by position within one block and returns
    named Columns.  ``df`` must carry ``pos`` and ``n_line`` of ``number_rows``.
    """
    spread, w = with_halo(df, before, after, keys, pos, total)
    cols = build(w)
    kept = [c for c in df.columns if c not in cols]
    out = spread.select(*kept, "_core", *[c.alias(n) for n, c in cols.items()])
    return out.filter("_core").drop("_core")


def with_halo(df: DataFrame, before: int, after: int, keys: Sequence[str] = LINE,
              pos: str = "pos", total: str = "n_line"):
    """Assign rows to position blocks, copying border rows to the neighbour that
    needs them.  Returns the frame (with ``_blk`` and ``_core``) and its window."""
    size = max(block_rows(df.sparkSession), before, after, 1)
    p = F.col(pos)
    home = F.floor(p / size)
    at = p - home * size
    blocks = [F.array(home)]
    if after:
        blocks.append(F.when((home > 0) & (at < after), F.array(home - 1)).otherwise(
            F.array().cast("array<bigint>")))
    if before:
        more = F.col(total) > (home + 1) * size
        blocks.append(F.when(more & (at >= size - before), F.array(home + 1)).otherwise(
            F.array().cast("array<bigint>")))
    if len(blocks) == 1:
        spread = df.withColumn("_blk", home).withColumn("_core", F.lit(True))
    else:
        spread = (df.withColumn("_blk", F.explode(F.concat(*blocks)))
                  .withColumn("_core", F.col("_blk") == home))
    return spread, Window.partitionBy(*keys, "_blk").orderBy(pos)


def running(df: DataFrame, value: str, into: str, keys: Sequence[str] = LINE,
            order: str = "rn") -> DataFrame:
    """Inclusive running sum of ``value`` by ``order``: block sums, then a sum
    inside each block."""
    size = block_rows(df.sparkSession)
    keyed = df.withColumn("_rb", F.floor(F.col(order) / size))
    sums = keyed.groupBy(*keys, "_rb").agg(F.sum(value).alias("_s"))
    starts = block_starts(sums, keys, "_s")
    inside = Window.partitionBy(*keys, "_rb").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (keyed.join(starts, [*keys, "_rb"])
            .withColumn(into, F.col("_start") + F.sum(value).over(inside))
            .drop("_rb", "_start"))


def with_group_stats(df: DataFrame, stats: dict[str, Column],
                     keys: Sequence[str] = LINE) -> DataFrame:
    """Attach aggregates of each key to its rows.

    The aggregate combines before its shuffle.  A bounded number of keys is kept
    and broadcast, so the rows themselves are not shuffled; beyond that the join is
    left to adaptive execution, which splits a hot key.  A window over the key
    could do neither.
    """
    agg = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(small(agg), list(keys))


@F.pandas_udf(T.LongType())
def _ordered(v: pd.Series) -> pd.Series:
    """64-bit integers in the order of the doubles; NaN comes last, both zeros are one."""
    bits = (v.to_numpy(dtype=float) + 0.0).view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & np.int64(2 ** 63 - 1)))


@F.pandas_udf(T.DoubleType())
def _double(v: pd.Series) -> pd.Series:
    bits = v.to_numpy(dtype=np.int64)
    return pd.Series((bits ^ ((bits >> 63) & np.int64(2 ** 63 - 1))).view(np.float64))


DIGIT = 16  # bits that a round of the selection settles


def exact_ranked(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """The exact values at some ranks (1-based, from the count ``_of_key``) of each key's
    non-null values.

    A radix selection: each round counts 16 more bits of the values whose upper bits are
    still open, and keeps those in which a rank lies.  Counts combine before their shuffle
    and have at most 65,536 rows per key and open prefix, however the values lie."""
    keys = list(keys)
    rows = materialized(df.filter(F.col(value).isNotNull()).select(*keys, _ordered(F.col(value).cast("double")).alias("_k")), "ordered")
    wants = F.explode(F.array(*[F.struct(F.lit(i).alias("w"), r.cast("long").alias("r")) for i, r in enumerate(ranks.values())]))
    state = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_of_key")).select(*keys, wants.alias("_w")).select(
        *keys, "_w.w", F.col("_w.r").alias("_rank"), F.lit(0).cast("long").alias("_prefix"))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys] + [a["_prefix"] == b["_prefix"]])
    for shift in range(64 - DIGIT, -1, -DIGIT):
        upper = F.shiftright("_k", shift + DIGIT) if shift + DIGIT < 64 else F.lit(0).cast("long")
        state = materialized(state, "ranks")
        seen = rows.select(*keys, upper.alias("_prefix"), F.shiftright("_k", shift).alias("_next"))
        if shift + DIGIT < 64:
            opened = small(state.select(*keys, "_prefix").distinct())
            seen = seen.join(opened, same(seen, opened), "left_semi")
        bins = seen.groupBy(*keys, "_prefix", "_next").agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*keys, "_prefix").orderBy("_next"))
        bins = bins.withColumn("_upto", upto)
        found = state.join(bins, same(state, bins)).where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_c")))
        state = found.select(*[state[k] for k in keys], "w", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"), F.col("_next").alias("_prefix"))
    return state.groupBy(*keys).agg(*[F.max(F.when(F.col("w") == i, F.col("_prefix"))).alias(f"_{i}") for i in range(len(ranks))]).select(
        *keys, *[_double(f"_{i}").alias(name) for i, name in enumerate(ranks)])


def exact_median(df: DataFrame, keys: Sequence[str], value: str, into: str = "median") -> DataFrame:
    """Exact median per key without gathering a key's values in one task."""
    n = F.col("_of_key")
    got = exact_ranked(df, keys, value, {"_low": F.floor((n + 1) / 2), "_high": F.floor((n + 2) / 2)})
    return got.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias(into))

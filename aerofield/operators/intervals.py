"""Rows met with time ranges, however many ranges a line has."""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerofield.session import small


def disjoint(ranges: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """Closed ranges of each key merged into disjoint ones by a sweep over their starts.
    A range without an end or a start, or that ends before it starts, holds nothing."""
    by_start = Window.partitionBy(*keys).orderBy(low, high)
    reached = F.max(high).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    runs = (ranges.filter(F.col(low) <= F.col(high)).select(*keys, low, high)
            .withColumn("_new", (reached.isNull() | (F.col(low) > reached)).cast("int"))
            .withColumn("_run", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, 0))))
    return runs.groupBy(*keys, "_run").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_run")


def _buckets(merged: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """As many buckets of time as a key has ranges, evenly over the time that these
    cover: disjoint ranges are cut into fewer than three parts each, on average."""
    def finite(c: str) -> Column:
        return F.when(F.abs(F.col(c)) < float("inf"), F.col(c))

    ends = merged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(finite(low)).alias("_a"), F.max(finite(high)).alias("_b"))
    width = F.greatest((F.col("_b") - F.col("_a")) / F.col("_n"), F.lit(1e-9))
    return ends.select(*keys, "_n", F.coalesce("_a", "_b", F.lit(0.0)).alias("_origin"), F.coalesce(width, F.lit(1.0)).alias("_width"))


def _bucket(time: Column) -> Column:
    """Never falls as time rises; times off the buckets belong to the first or last."""
    place = (time - F.col("_origin")) / F.col("_width")
    return F.floor(F.least(F.greatest(place, F.lit(0.0)), F.col("_n") - F.lit(1.0))).cast("long")


def in_ranges(df: DataFrame, ranges: DataFrame, keys: Sequence[str], time: str, low: str, high: str,
              keep: bool = True) -> DataFrame:
    """Rows of ``df`` whose time lies in a closed range of their key, or with ``keep``
    False all other rows, those with a null key or time among them.

    Ranges are merged, cut at the borders of time buckets and met by an equality of key
    and bucket, so a row is compared with the few ranges of its bucket and a line with
    many ranges is spread over its buckets."""
    own = [f"_key{i}" for i in range(len(keys))]
    named = ranges.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col(low).alias("_low"), F.col(high).alias("_high"))
    merged = small(disjoint(named, own, "_low", "_high"))
    buckets = small(_buckets(merged, own, "_low", "_high"))
    parts = merged.join(buckets, own).select(
        *[F.col(o).alias(f"_of{o}") for o in own], "_low", "_high",
        F.explode(F.sequence(_bucket(F.col("_low")), _bucket(F.col("_high")))).alias("_part"))
    there = [df[k] == buckets[o] for k, o in zip(keys, own)]
    rows = df.join(buckets, there, "left").withColumn("_bucket", F.when(F.col(time).isNotNull(), _bucket(F.col(time))))
    met = [F.col("_bucket") == F.col("_part"), *[F.col(o) == F.col(f"_of{o}") for o in own],
           F.col(time).between(F.col("_low"), F.col("_high"))]
    return rows.join(small(parts), met, "left_semi" if keep else "left_anti").select(*[df[c] for c in df.columns])

"""Bucket members met in bounded blocks: every pair of a bucket's rows comes together
in exactly one small group, however large the bucket is."""
from pyspark.sql import DataFrame, functions as F

from aerofield.session import materialized


def met(rows: DataFrame, keys: list[str], member: str, size: int = 1024, payload: DataFrame | None = None) -> DataFrame:
    """``rows(keys, member)`` of buckets with two or more members, with ``part``, ``lo``
    and ``hi``, and the columns of ``payload(member, ...)`` (one row per member).

    A bucket of n rows is dealt to ceil(n / size) parts by ``member``; the row of part
    p is sent to the groups (min(p, q), max(p, q)) of every part q.  A group holds one
    part (lo = hi) or two.  The result is dealt by (keys, lo, hi) and sorted so; a
    payload travels only then."""
    counts = materialized(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    parts = F.ceil(F.col("n") / F.lit(size)).cast("int")
    out = (rows.join(counts, keys)
           .withColumn("parts", parts)
           .withColumn("part", F.pmod(F.xxhash64(member), F.col("parts")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
           .withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
           .drop("n", "parts", "other"))
    if payload is not None:
        out = out.join(payload, member)
    return out.repartition(*keys, "lo", "hi").sortWithinPartitions(*keys, "lo", "hi")

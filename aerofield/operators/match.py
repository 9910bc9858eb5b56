"""Nearest samples in time and systematic resampling."""
from pyspark.sql import DataFrame, Window, functions as F

from aerofield.operators.sequence import LINE, blockwise, number_rows, running
from aerofield.session import small


def nearest_in_time(samples: DataFrame, times: DataFrame, keys=("flight",),
                    tick: float = 4096.0, row: str = "rn") -> DataFrame:
    """For each distinct (key, ``t``) the row id of the sample nearest in time, the
    earlier one on a tie.

    Samples and query times meet in blocks of ``tick`` seconds; a small table of
    each block's first and last sample supplies the neighbours across empty
    blocks.  What follows a row is read in descending order, as a frame that ends
    with its partition is summed up anew for every row.
    """
    asked = times.select(*keys, "t").distinct()
    hit = lambda on: F.struct(F.col("tt" if on else "t").alias("t"), F.col(row).alias("r") if on
                              else F.lit(None).cast("long").alias("r"))
    a = samples.select(*keys, F.floor(F.col("tt") / tick).alias("_b"), F.col("tt").alias("_t"),
                       F.lit(0).alias("_q"), hit(True).alias("_s"))
    # one sample per instant is enough: the first by row
    a = a.groupBy(*keys, "_b", "_t", "_q").agg(F.min("_s").alias("_s"))
    b = asked.select(*keys, F.floor(F.col("t") / tick).alias("_b"), F.col("t").alias("_t"),
                     F.lit(1).alias("_q"), F.lit(None).cast("struct<t:double,r:bigint>").alias("_s"))
    both = a.unionByName(b)
    ends = both.groupBy(*keys, "_b").agg(F.min("_s").alias("_first"), F.max("_s").alias("_last"))
    earlier = lambda w, upto: w.rowsBetween(Window.unboundedPreceding, upto)
    blocks, inside = Window.partitionBy(*keys), Window.partitionBy(*keys, "_b")
    carry = ends.select(
        *keys, "_b",
        F.last("_last", True).over(earlier(blocks.orderBy("_b"), -1)).alias("_left"),
        F.last("_first", True).over(earlier(blocks.orderBy(F.desc("_b")), -1)).alias("_right"))
    found = (both.withColumns({
        "_before": F.last("_s", True).over(earlier(inside.orderBy("_t", "_q"), 0)),
        "_after": F.last("_s", True).over(earlier(inside.orderBy(F.desc("_t"), F.desc("_q")), 0))})
        .filter("_q = 1").join(carry, [*keys, "_b"]))
    lo, hi = F.coalesce("_before", "_left"), F.coalesce("_after", "_right")
    dlo, dhi = F.col("_t") - lo["t"], hi["t"] - F.col("_t")
    best = F.when(lo.isNull(), hi).when(hi.isNull() | (dlo <= dhi), lo).otherwise(hi)
    return found.select(*keys, F.col("_t").alias("t"), best["r"].alias(row), best["t"].alias("tt"))


def systematic_resample(df: DataFrame, weight: str, offset: float, keys=LINE, order: str = "rn",
                        piece: int = 65536) -> DataFrame:
    """Resample each key's rows by weight: draw j of n sits at (j - offset)/n and
    takes the row whose cumulative share interval holds it.

    The draws of a row are an arithmetic range, so no range join is needed; long
    ranges are cut into pieces first, so that one heavy row is copied by many tasks.
    """
    placed = number_rows(df, keys, order)
    summed = running(placed, weight, "_cum", keys, order)
    total = df.groupBy(*keys).agg(F.sum(weight).alias("_sum"))
    n = F.col("n_line")
    hi = F.when(F.col("pos") == n - 1, F.lit(1.0)).otherwise(F.col("_cum") / F.col("_sum"))
    shares = summed.join(small(total), list(keys)).withColumn("_hi", hi)
    # each interval starts exactly where the one before ends
    shares = blockwise(shares, lambda w: {"_lo": F.when(F.col("pos") == 0, F.lit(0.0)).otherwise(
        F.lag("_hi").over(w))}, before=1, keys=keys)
    at = lambda j: (j - offset) / n
    # candidate draws, one wider on both sides; exact bounds are tested below
    first = F.greatest(F.floor(F.col("_lo") * n + offset), F.lit(1))
    last = F.least(F.ceil(F.col("_hi") * n + offset), n)
    ranged = shares.filter("_hi > _lo").withColumns({"_j0": first, "_j1": last}).filter("_j0 <= _j1")
    pieces = ranged.withColumn("_p", F.explode(F.sequence(F.floor(F.col("_j0") / piece), F.floor(F.col("_j1") / piece))))
    spread = pieces.repartition(*keys, "_p")
    draws = spread.withColumn("draw", F.explode(F.sequence(
        F.greatest(F.col("_j0"), F.col("_p") * piece),
        F.least(F.col("_j1"), F.col("_p") * piece + piece - 1))))
    u = at(F.col("draw"))
    # the last row also takes a draw at exactly 1
    top = (F.col("pos") == n - 1) & (u >= 1.0)
    return draws.filter(((u >= F.col("_lo")) & (u < F.col("_hi"))) | top).drop(
        "_cum", "_sum", "_lo", "_hi", "_j0", "_j1", "_p")

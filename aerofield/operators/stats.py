"""Error statistics and aggregates; every one combines before its shuffle."""
from pyspark.sql import Column, DataFrame, functions as F

from aerofield.operators.sequence import LINE, with_group_stats


def rmse(e: Column) -> Column:
    return F.sqrt(F.avg(e * e))


def mae(e: Column) -> Column:
    return F.avg(F.abs(e))


def spread(e: Column) -> Column:
    """Population standard deviation (unchanged by removing the mean)."""
    return F.stddev_pop(e)


def column_stats(df: DataFrame, columns: list[str], digits: int = 2, name: str = "feature") -> DataFrame:
    """mean, std, min, max, rmse, mae of each column without missing values; an
    empty frame gives no rows, an all-missing column gives nulls."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    kinds = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "rmse": rmse, "mae": mae}
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.round(f(clean(c)), digits).alias(f"{k}_{i}")
                   for i, c in enumerate(columns) for k, f in kinds.items()])
    structs = [F.struct(F.lit(c).alias(name), *[F.col(f"{k}_{i}").alias(k) for k in kinds])
               for i, c in enumerate(columns)]
    return (row.filter("_rows > 0").select(F.explode(F.array(*structs)).alias("s")).select("s.*"))


def line_lengths(df: DataFrame) -> DataFrame:
    return df.groupBy("line").agg(F.count(F.lit(1)).alias("n")).orderBy("line")


def line_errors(df: DataFrame, predicted: str, actual: str, into: str = "err",
                flip: bool = False, keys=LINE) -> DataFrame:
    """Error with each line's mean removed: predicted - actual, or the other way
    round if ``flip``."""
    e = F.col(actual) - F.col(predicted) if flip else F.col(predicted) - F.col(actual)
    return (with_group_stats(df.withColumn("_e", e), {"_m": F.avg("_e")}, keys)
            .withColumn(into, F.col("_e") - F.col("_m")).drop("_e", "_m"))


def drms(north: Column, east: Column) -> Column:
    """Distance root mean square, to whole metres (half to even)."""
    return F.bround(F.sqrt(F.avg(north * north + east * east))).cast("long")


def paired_offsets(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Mean and spread of uncompensated minus compensated, per magnetometer."""
    return (df.select(F.explode(F.array(*[
                F.struct(F.lit(n).alias("mag"), (F.col(u) - F.col(c)).alias("d"))
                for n, (u, c) in pairs.items()])).alias("s")).select("s.*")
            .groupBy("mag").agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std")))


def correlation(df: DataFrame, x: str, y: str, keys=LINE, limit: float = 0.0) -> DataFrame:
    """Pearson correlation and regression line per key, where the correlation's
    size exceeds the limit; keys with fewer than two rows give none."""
    return (df.groupBy(*keys).agg(F.corr(x, y).alias("corr"),
                                  F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                                  F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
                                  F.count(F.lit(1)).alias("n"))
            .filter((F.col("n") >= 2) & (F.abs("corr") > limit)))


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Correlations of two or more features, one row per pair."""
    if len(features) < 2:
        raise ValueError("at least two features")
    pairs = [(a, b) for i, a in enumerate(features) for b in features[:i + 1]]
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.col(f"c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Density histogram over the column's range, the last bin closed; empty bins
    are there with a count of 0.  NaN counts as missing."""
    df = df.select(F.nanvl(F.col(column).cast("double"), F.lit(None)).alias(column))
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n:
        return df.sparkSession.createDataFrame([], "bin long, count long, density double")
    width = (hi - lo) / bins or 1.0 / bins
    idx = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1))
    counts = df.filter(F.col(column).isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return (df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(counts), "bin", "left")  # one row a bin
            .select("bin", F.coalesce("n", F.lit(0)).alias("count"))
            .withColumn("density", F.col("count") / F.lit(float(n)) / F.lit(width)))


def normalization(df: DataFrame, columns: list[str], kind: str = "standardize",
                  exempt: list[str] = ()) -> dict[str, tuple[float, float]]:
    """Bias and scale per column from one aggregate; scales up to 1e-9 become 1."""
    if kind not in ("standardize", "normalize", "scale", "none"):
        raise ValueError(f"normalization {kind!r} not defined")
    live = [c for c in columns if c not in exempt and kind != "none"]
    out = {c: (0.0, 1.0) for c in columns}
    if live:
        pick = {"standardize": lambda c: (F.avg(c), F.stddev_pop(c)),
                "normalize": lambda c: (F.min(c), F.max(c) - F.min(c)),
                "scale": lambda c: (F.lit(0.0), F.max(F.abs(c)))}[kind]
        row = df.agg(*[e.cast("double").alias(f"{i}_{j}") for i, c in enumerate(live)
                       for j, e in enumerate(pick(F.col(c)))]).first()
        for i, c in enumerate(live):
            bias, scale = row[f"{i}_0"], row[f"{i}_1"]
            if bias is not None:
                out[c] = (bias, scale if scale is not None and scale > 1e-9 else 1.0)
    return out


def weighted_moments(df: DataFrame, states: list[str], weight: str, keys=LINE,
                     extra: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """Weighted mean, covariance (plus an additive term) and effective sample size
    of row vectors; weights are normalized per key.  Two passes, so that the
    covariance is taken about the mean."""
    q = F.col(weight)
    means = {f"mean_{s}": F.sum(q * F.col(s)) / F.sum(q) for s in states}
    centred = with_group_stats(df, {**means, "_w": F.sum(q)}, keys)
    u = q / F.col("_w")
    d = lambda s: F.col(s) - F.col(f"mean_{s}")
    extra = extra or {}
    covs = {f"cov_{a}_{b}": F.sum(u * d(a) * d(b)) + F.lit(float(extra.get((a, b), 0.0)))
            for i, a in enumerate(states) for b in states[i:]}
    return centred.groupBy(*keys).agg(
        *[F.max(m).alias(m) for m in means], *[c.alias(n) for n, c in covs.items()],
        (F.lit(1.0) / F.sum(u * u)).alias("n_eff"))


def best_run(df: DataFrame, score: str = "err_std", idx: str = "idx") -> DataFrame:
    """The run with the smallest score, the first one on a tie."""
    return df.orderBy(F.col(score).asc_nulls_last(), idx).limit(1)

"""Segments, selections, windows and splits of ordered samples."""
import math

from pyspark.sql import Column, DataFrame, functions as F

from aerofield.operators.select import every, select_lines, whole_windows
from aerofield.operators.sequence import (LINE, block_rows, blockwise, number_rows, unnumbered,
                                          with_group_stats)


def with_legs(df: DataFrame, keys=LINE) -> DataFrame:
    """Add the contiguous leg of each row: its first row id (``leg``), the row's
    place in it (``leg_pos``) and its length (``leg_n``).  Inside a line, rows of
    one leg share ``rn - pos``."""
    rows = number_rows(df, keys).withColumn("_island", F.col("rn") - F.col("pos"))
    out = with_group_stats(rows, {"leg": F.min("rn"), "leg_n": F.count(F.lit(1))},
                           [*keys, "_island"])
    return out.withColumn("leg_pos", F.col("rn") - F.col("leg")).drop("_island")


def segments(df: DataFrame, lines="all", n_min: int = 3, buffer: int = 0) -> DataFrame:
    """Rows of contiguous legs at least ``n_min + 2 * buffer`` long, less the
    buffer rows at both ends."""
    legs = with_legs(select_lines(df, lines))
    kept = legs.filter((F.col("leg_n") >= n_min + 2 * buffer)
                       & (F.col("leg_pos") >= buffer)
                       & (F.col("leg_pos") < F.col("leg_n") - buffer))
    return unnumbered(kept).drop("leg_pos", "leg_n")


def select_rows(df: DataFrame, lines="all", leg_min: int = 3, buffer: int = 0, modulus: int = 1,
                remainders=0, n_max: int = -1, n_min: int = 3) -> DataFrame:
    """Row selection by lines, leg length, leg buffer, modulo of the global
    position, a largest number of rows (even steps) and a least number (else
    nothing)."""
    legs = with_legs(select_lines(df, lines)).filter(F.col("leg_n") >= leg_min)
    if buffer:
        legs = legs.filter((F.col("leg_n") > 2 * buffer) & (F.col("leg_pos") >= buffer)
                           & (F.col("leg_pos") < F.col("leg_n") - buffer))
    picked = every(legs, modulus, remainders).drop("pos", "n_line", "leg", "leg_n", "leg_pos")
    return thin(picked, n_max, n_min)


def thin(df: DataFrame, n_max: int, n_min: int = 0, keys=()) -> DataFrame:
    """At most ``n_max`` rows by an even step from the first; nothing if fewer
    than ``n_min`` rows are left."""
    rows = number_rows(df, keys, "rn", "_at", "_of")
    if n_max > 0:
        step = F.ceil(F.col("_of") / n_max)
        rows = rows.filter(F.col("_at") % F.greatest(step, F.lit(1)) == 0)
        kept = F.ceil(F.col("_of") / F.greatest(step, F.lit(1)))
    else:
        kept = F.col("_of")
    return unnumbered(rows.filter(kept >= n_min) if n_min else rows).drop("_at", "_of")


def downsample(df: DataFrame, n_max: int = 1000) -> DataFrame:
    return thin(df, n_max)


def trim_lines(df: DataFrame, trim: int) -> DataFrame:
    """Drop ``trim`` rows at both ends of each line; lines of up to twice that go."""
    rows = number_rows(df)
    n = F.col("n_line")
    return unnumbered(rows.filter((n > 2 * trim) & F.col("pos").between(F.lit(trim), n - trim - 1)))


def sliding_windows(df: DataFrame, columns: list[str], width: int) -> DataFrame:
    """For each row the last ``width`` values up to it, left-padded with the
    window's first value; windows never cross lines."""
    def build(w):
        frame = w.rowsBetween(-(width - 1), 0)
        out = {}
        for c in columns:
            got = F.collect_list(c).over(frame)
            out[f"{c}_window"] = F.concat(F.array_repeat(got[0], F.lit(width) - F.size(got)), got)
        return out
    return blockwise(number_rows(df), build, before=width - 1)


def chunks(df: DataFrame, columns: list[str], width: int) -> DataFrame:
    """Non-overlapping chunks of ``width`` rows per line, the remainder dropped;
    ``end`` is the position after the chunk's last row."""
    rows = number_rows(df)
    rows = rows.filter(F.col("pos") < F.col("n_line") - F.col("n_line") % width)
    item = F.struct("pos", *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])
    got = rows.groupBy(*LINE, F.floor(F.col("pos") / width).alias("chunk")).agg(
        F.array_sort(F.collect_list(item)).alias("_r"))
    return got.select(*LINE, "chunk", ((F.col("chunk") + 1) * width).alias("end"),
                      *[F.col(f"_r._{i}").alias(c) for i, c in enumerate(columns)])


def shuffle_key(row: Column, seed: int) -> Column:
    """60 pseudo-random bits of a row id, the same on every run and engine."""
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string")))
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("long")


def split_rows(df: DataFrame, fraction: float, kind: str = "none", width: int = 0,
               seed: int = 0) -> DataFrame:
    """Training and validation flags (``in_train``, ``in_valid``).

    ``none`` takes a random ``floor(N * fraction)`` rows, ``sliding`` the first
    ones with validation starting ``width - 1`` rows later so that windows do not
    overlap, ``contiguous`` random blocks of ``width`` rows.  A fraction of 1 puts
    every row in both.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction is between 0 and 1")
    if kind not in ("none", "sliding", "contiguous"):
        raise ValueError(f"invalid split {kind!r}")
    if kind == "contiguous" and width <= 0:
        raise ValueError("contiguous blocks need a width")
    if fraction == 1:
        return df.withColumns({"in_train": F.lit(True), "in_valid": F.lit(True)})
    n = df.count()
    if kind != "none" and 0 < n <= width:
        raise ValueError(f"window length {width} is too large for {n} samples")
    if kind == "sliding":
        cut = math.floor(n * fraction)
        return (number_rows(df, (), "rn", "_at", "_of")
                .withColumns({"in_train": F.col("_at") < cut,
                              "in_valid": F.col("_at") >= cut + width - 1}).drop("_at", "_of"))
    if kind == "none":
        return _random_part(df, "rn", math.floor(n * fraction), n, seed)
    placed = (number_rows(df, (), "rn", "_at", "_of")
              .withColumn("_b", F.floor(F.col("_at") / width)).drop("_at", "_of"))
    total = math.ceil(n / width)
    ids = _random_part(placed.select("_b").distinct(), "_b", math.floor(total * fraction), total, seed)
    return placed.join(ids, "_b").drop("_b")


def _random_part(df: DataFrame, row: str, take: int, n: int, seed: int) -> DataFrame:
    width = 2 ** 60 // (n // block_rows(df.sparkSession) + 1) + 1
    keyed = df.withColumn("_key", shuffle_key(F.col(row), seed))
    return (number_rows(keyed, (), "_key", "_at", "_of", width)
            .withColumns({"in_train": F.col("_at") < take, "in_valid": F.col("_at") >= take})
            .drop("_key", "_at", "_of"))


def split_fractions(df: DataFrame, fractions: tuple[float, ...], keys=LINE) -> DataFrame:
    """Number (``part``) the consecutive shares of each key, up to three of them."""
    if not 1 <= len(fractions) <= 3 or abs(sum(fractions) - 1) > 1e-9:
        raise ValueError("one to three fractions that add to 1")
    rows = number_rows(df, keys)
    cuts, total = [], 0.0
    for f in fractions[:-1]:
        total += f
        cuts.append(F.round(F.col("n_line") * round(total, 9)))
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col("pos") >= c).cast("int")
    return rows.withColumn("part", part)


def curriculum(df: DataFrame, column: str, n_sigma: float = 1.0) -> DataFrame:
    """Flag rows within ``n_sigma`` standard deviations of the mean."""
    mean, std = df.agg(F.avg(column), F.stddev_pop(column)).first()
    near = F.abs(F.col(column) - F.lit(mean)) <= F.lit((std or 0.0) * n_sigma)
    return df.withColumns({"in_curriculum": near, "in_network": ~near})


def adaptive_variance(df: DataFrame, resid: str, hph: str, start: float, low: float,
                      high: float, depth: int = 10) -> DataFrame:
    """Measurement variance from the previous ``depth`` residuals: their mean
    square less the supplied projection of the state covariance, clipped.  The
    first ``depth`` rows keep the starting value."""
    rows = number_rows(df)

    def build(w):
        past = F.avg(F.col(resid) * F.col(resid)).over(w.rowsBetween(-depth, -1))
        clipped = F.least(F.greatest(past - F.col(hph), F.lit(low)), F.lit(high))
        return {"variance": F.when(F.col("pos") >= depth, clipped).otherwise(F.lit(start))}
    return blockwise(rows, build, before=depth)


def smoothing_weights(kind: str, width: int) -> list[float]:
    m = width - 1
    c = lambda k, i: math.cos(2 * math.pi * k * i / m)
    shape = {"flat": lambda i: 1.0, "hanning": lambda i: 0.5 - 0.5 * c(1, i),
             "hamming": lambda i: 0.54 - 0.46 * c(1, i),
             "bartlett": lambda i: 1 - abs(2 * i / m - 1),
             "blackman": lambda i: 0.42 - 0.5 * c(1, i) + 0.08 * c(2, i)}
    if kind not in shape:
        raise ValueError(f"unknown smoothing window {kind!r}")
    raw = [shape[kind](i) for i in range(width)]
    return [x / sum(raw) for x in raw]


def smooth(df: DataFrame, column: str, width: int = 11, kind: str = "flat",
           into: str = "smooth") -> DataFrame:
    """Weighted moving average with the line reflected about both ends; lines
    shorter than the window keep their values."""
    weights = smoothing_weights(kind, width) if width >= 3 else [1.0]
    rows = number_rows(df)
    if width < 3:
        return rows.withColumn(into, F.col(column))
    ahead = (width - 1) // 2
    behind = width - 1 - ahead
    p, n = F.col("pos"), F.col("n_line")
    none = F.array().cast("array<bigint>")
    mirrored = F.concat(
        F.array(p), F.when((p >= 1) & (p <= behind), F.array(-p)).otherwise(none),
        F.when((p <= n - 2) & (p >= n - 1 - ahead), F.array((n - 1) * 2 - p)).otherwise(none))
    # positions of the reflected line start at 0 again
    long = (rows.withColumn("_at", F.explode(mirrored))
            .withColumns({"_own": F.col("_at") == p, "_at": F.col("_at") + behind,
                          "_len": n + behind + ahead}))

    def build(w):
        total = F.lit(0.0)
        for k, weight in zip(range(-behind, ahead + 1), weights):
            v = F.lag(column, -k).over(w) if k < 0 else F.lead(column, k).over(w) if k else F.col(column)
            total = total + v * weight
        return {into: F.when(n < width, F.col(column)).otherwise(total)}
    out = blockwise(long, build, behind, ahead, pos="_at", total="_len")
    return out.filter("_own").drop("_own", "_at", "_len")

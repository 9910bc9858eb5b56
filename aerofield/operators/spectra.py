"""Spectra along lines.

Segments of a fixed length are gathered as arrays and transformed in batches.
The transform of a whole line that is longer than a block is split into two
rounds of short transforms with a phase factor between them, so that no task
holds more than about the square root of the line.
"""
import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from aerofield.functions.fourier import power_spectrum, transform_placed
from aerofield.operators.sequence import LINE, block_rows, exact_median, number_rows, with_group_stats
from aerofield.session import materialized, small


def _gathered(df: DataFrame, keys: list[str], order: str, **values: Column) -> DataFrame:
    """Arrays of values in order; the groups here are short by construction."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *[c.alias(n) for n, c in values.items()])))
    return df.groupBy(*keys).agg(items.alias("_r")).select(*keys, *[F.col(f"_r.{n}").alias(n) for n in values])


def line_transform(df: DataFrame, column: str, keys=LINE, pos: str = "pos", total: str = "n_line") -> DataFrame:
    """Discrete Fourier transform of each line: rows (keys, k, re, im, n).  ``total``
    may exceed the rows present; the rest counts as zeros.

    Lines of one block are transformed as one array, longer ones in two rounds.
    A long line without balanced factors is turned into a convolution with a chirp
    of the next power of two, which has them.
    """
    size = block_rows(df.sparkSession)
    rows = df.select(*keys, F.col(pos).alias("_t"), F.col(total).cast("long").alias("n"),
                     F.col(column).cast("double").alias("re"), F.lit(0.0).alias("im"))
    longest = rows.agg(F.max("n")).first()[0]
    if longest is None or longest <= size:
        whole = _gathered(rows, [*keys, "n"], "_t", at=F.col("_t"), re=F.col("re"), im=F.col("im"))
        return _bins(whole.withColumn("_f", transform_placed("at", "re", "im", "n")), [*keys, "n"], "k")
    split = F.udf(lambda n: _factor(n, size), T.LongType())
    plan = rows.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("_c")).withColumn("_q", split("n")).drop("_c")
    plan = materialized(plan, "lengths")
    rows = rows.join(plan, [*keys, "n"])
    direct = _two_rounds(rows.filter("_q > 0"), keys)
    return direct.unionByName(_by_chirp(rows.filter("_q = 0").drop("_q"), plan.filter("_q = 0").drop("_q"), keys))


def _factor(n: int, size: int) -> int:
    """Second-round length of a line: 1 if it fits in a block, else its divisor
    nearest to the square root; 0 if that is far from it."""
    if n <= size:
        return 1
    root = math.isqrt(n)
    for q in range(root, root // 16, -1):
        if n % q == 0:
            return q
    return 0


def _bins(df: DataFrame, keys: list[str], into: str) -> DataFrame:
    return df.select(*keys, F.posexplode(F.arrays_zip("_f.re", "_f.im")).alias(into, "_z")).select(
        *keys, F.col(into).cast("long").alias(into), F.col("_z.re").alias("re"), F.col("_z.im").alias("im"))


def _turned(df: DataFrame, angle: Column) -> DataFrame:
    """Values multiplied by exp(i angle)."""
    re, im, c, s = F.col("re"), F.col("im"), F.cos(angle), F.sin(angle)
    return df.withColumns({"re": re * c - im * s, "im": re * s + im * c})


def _two_rounds(rows: DataFrame, keys) -> DataFrame:
    """Transform of (keys, n, _q, _t, re, im).  With n = p q, sample t = q a + b and
    bin k = c + p d: transform over a for each b, turn by exp(-2 pi i b c / n),
    transform over b for each c."""
    meta = [*keys, "n", "_q", "_p"]
    placed = rows.withColumns({"_p": (F.col("n") / F.col("_q")).cast("long"), "_b": F.col("_t") % F.col("_q")})
    first = _gathered(placed, [*meta, "_b"], "_t", at=F.floor(F.col("_t") / F.col("_q")), re=F.col("re"), im=F.col("im"))
    bins = _bins(first.withColumn("_f", transform_placed("at", "re", "im", "_p")), [*meta, "_b"], "_c")
    bins = _turned(bins, F.lit(-2 * math.pi) * (F.col("_b") * F.col("_c") % F.col("n")) / F.col("n"))
    second = _gathered(bins, [*meta, "_c"], "_b", at=F.col("_b"), re=F.col("re"), im=F.col("im"))
    out = _bins(second.withColumn("_f", transform_placed("at", "re", "im", "_q")), [*meta, "_c"], "_d")
    return out.select(*keys, "n", (F.col("_c") + F.col("_p") * F.col("_d")).alias("k"), "re", "im")


def _chirp(t: Column, n: Column, sign: float) -> Column:
    """sign * pi t^2 / n, reduced exactly before it becomes a double."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(sign * math.pi) * ((wide(t) * wide(t)) % (wide(n) * 2)).cast("double") / n


def _by_chirp(rows: DataFrame, plan: DataFrame, keys) -> DataFrame:
    """Transform of any length as a convolution: k t = (k^2 + t^2 - (k - t)^2) / 2."""
    n, t, m = F.col("n"), F.col("_t"), F.col("_m")
    power = F.pow(F.lit(2.0), F.ceil(F.log2(n * 2 - 1))).cast("long")
    half = F.pow(F.lit(2.0), F.floor(F.log2("_m") / 2)).cast("long")
    sized = lambda d: d.withColumn("_m", power).withColumn("_q", half)
    lengths = sized(plan)
    signal = _turned(sized(rows), _chirp(t, n, -1.0))
    # the chirp's table is generated in pieces spread over tasks
    piece = 65536
    starts = lengths.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), m - 1, F.lit(piece).cast("long"))))
    chirp = starts.repartition(*keys, "_s").withColumn("_t", F.explode(F.sequence(
        F.col("_s"), F.least(F.col("_s") + piece, m) - 1))).drop("_s")
    lag = F.least(t, m - t)
    chirp = _turned(chirp.filter(lag < n).withColumns({"re": F.lit(1.0), "im": F.lit(0.0)}), _chirp(F.least(t, m - t), n, 1.0))
    whole = lambda d: _two_rounds(d.withColumnsRenamed({"n": "_n0"}).withColumn("n", m), [*keys, "_n0"]).drop("n")
    a, b = whole(signal), whole(chirp).withColumnsRenamed({"re": "_br", "im": "_bi"})
    both = a.join(b, [*keys, "_n0", "k"])
    re, im, br, bi = (F.col(c) for c in ("re", "im", "_br", "_bi"))
    # the conjugate makes the second forward transform an inverse one
    spec = both.select(*keys, F.col("_n0").alias("n"), F.col("k").alias("_t"),
                       (re * br - im * bi).alias("re"), (-(re * bi + im * br)).alias("im"))
    back = whole(sized(spec)).withColumnsRenamed({"_n0": "n"}).filter(F.col("k") < n)
    size = power.cast("double")
    out = back.withColumns({"re": F.col("re") / size, "im": -F.col("im") / size})
    return _turned(out, _chirp(F.col("k"), n, -1.0)).select(*keys, "n", "k", "re", "im")


def _prepared(df: DataFrame, column: str, window: str, detrend: str | None, nfft: int | None, keys) -> DataFrame:
    """Detrended and windowed values, zero-padded or cut to ``nfft`` rows."""
    rows = number_rows(df, keys).select(*keys, "pos", "n_line", F.col(column).cast("double").alias("_x"))
    if nfft:
        rows = rows.filter(F.col("pos") < nfft).withColumn("n_line", F.least("n_line", F.lit(nfft)))
    p = F.col("pos").cast("double")
    if detrend == "constant":
        rows = with_group_stats(rows, {"_m": F.avg("_x")}, keys).withColumn("_x", F.col("_x") - F.col("_m"))
    elif detrend == "linear":
        rows = with_group_stats(rows, {"_a": F.regr_intercept("_x", p), "_s": F.regr_slope("_x", p)}, keys).withColumn(
            "_x", F.col("_x") - F.coalesce(F.col("_a") + F.col("_s") * p, F.col("_x")))
    t = F.lit(2 * math.pi) * p / F.col("n_line")
    shape = {"boxcar": F.lit(1.0), "hann": F.lit(0.5) - F.cos(t) * 0.5, "hamming": F.lit(0.54) - F.cos(t) * 0.46,
             "blackman": F.lit(0.42) - F.cos(t) * 0.5 + F.cos(t * 2) * 0.08}
    if window not in shape:
        raise ValueError(f"unknown spectral window {window!r}")
    w = F.when(F.col("n_line") == 1, F.lit(1.0)).otherwise(shape[window])
    rows = rows.withColumns({"_w": w, "_x": F.col("_x") * w})
    # rows missing up to the transform length count as zeros
    if nfft:
        rows = rows.withColumn("n_line", F.lit(nfft).cast("long"))
    return rows


def _frequencies(k: Column, n: Column, fs: float) -> Column:
    return F.when(k <= F.floor((n - 1) / 2), k).otherwise(k - n) * fs / n


def periodogram(df: DataFrame, column: str, fs: float = 1.0, window: str = "hann", nfft: int | None = None,
                detrend: str | None = "constant", onesided: bool = True, scaling: str = "density",
                keys=LINE) -> DataFrame:
    """Power per frequency of each whole line."""
    rows = _prepared(df, column, window, detrend, nfft, keys)
    norm = rows.groupBy(*keys).agg(F.sum("_w").alias("_w1"), F.sum(F.col("_w") * F.col("_w")).alias("_w2"))
    spec = line_transform(rows, "_x", keys).join(small(norm), list(keys))
    k, n = F.col("k"), F.col("n")
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    power = power / (F.col("_w2") * fs) if scaling == "density" else power / (F.col("_w1") * F.col("_w1"))
    freq = _frequencies(k, n, fs)
    if onesided:
        spec = spec.filter(k <= F.floor(n / 2))
        edge = (k == 0) | ((n % 2 == 0) & (k == n / 2))
        power, freq = F.when(edge, power).otherwise(power * 2), k * fs / n
    return spec.select(*keys, "k", freq.alias("freq"), power.alias("power"))


def spectral_amplitude(df: DataFrame, column: str, fs: float = 1.0, nfft: int | None = None,
                       onesided: bool = True, keys=LINE) -> DataFrame:
    """Magnitude of the plain transform of each line."""
    spec = line_transform(_prepared(df, column, "boxcar", None, nfft, keys), "_x", keys)
    k, n = F.col("k"), F.col("n")
    if onesided:
        spec = spec.filter(k <= F.floor(n / 2))
    return spec.select(*keys, "k", _frequencies(k, n, fs).alias("freq"),
                       F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("amp"))


def _segments(df: DataFrame, column: str, nperseg: int, overlap: int, keys) -> DataFrame:
    """Overlapping segments as arrays; a line shorter than a segment is one."""
    rows = number_rows(df, keys)
    pos, n = F.col("pos"), F.col("n_line")
    size = F.least(F.lit(nperseg), n)
    # short lines keep the share of the overlap
    step = F.greatest(size - F.floor(size * overlap / nperseg), F.lit(1))
    last = F.floor((n - size) / step)
    first_seg = F.greatest(F.ceil((pos - size + 1) / step), F.lit(0))
    last_seg = F.least(F.floor(pos / step), last)
    spread = rows.filter(first_seg <= last_seg).withColumn("seg", F.explode(F.sequence(first_seg, last_seg)))
    return _gathered(spread.withColumns({"_size": size, "_step": step}), [*keys, "seg", "_size", "_step"], "pos",
                     values=F.col(column).cast("double"))


def spectrogram(df: DataFrame, column: str, fs: float = 10.0, window: str = "hamming", nperseg: int = 256,
                overlap: int | None = None, detrend: str | None = "constant", scaling: str = "density",
                keys=LINE) -> DataFrame:
    """Power per segment and frequency, with the segment's mid time and decibels."""
    segs = _segments(df, column, nperseg, nperseg // 8 if overlap is None else overlap, keys)
    udf = power_spectrum(fs, window, None, detrend, True, scaling)
    out = segs.withColumn("_p", udf("values")).select(*keys, "seg", "_size", "_step", F.posexplode("_p").alias("k", "power"))
    return out.select(*keys, "seg", "k", ((F.col("seg") * F.col("_step") + F.col("_size") / 2) / fs).alias("time"),
                      (F.col("k") * fs / F.col("_size")).alias("freq"), "power",
                      (F.lit(10.0) * F.log10(F.when(F.col("power") > 0, F.col("power")))).alias("db"))


def welch(df: DataFrame, column: str, fs: float = 1.0, window: str = "hann", nperseg: int = 256,
          overlap: int | None = None, nfft: int | None = None, detrend: str | None = "constant",
          onesided: bool = True, scaling: str = "density", average: str = "mean", keys=LINE) -> DataFrame:
    """Averaged power of overlapping segments; the median average is corrected for
    its bias."""
    segs = _segments(df, column, nperseg, nperseg // 2 if overlap is None else overlap, keys)
    udf = power_spectrum(fs, window, nfft, detrend, onesided, scaling)
    size = F.lit(nfft) if nfft else F.col("_size")
    rows = segs.withColumn("_p", udf("values")).select(*keys, size.alias("_n"), F.posexplode("_p").alias("k", "_p"))
    group = [*keys, "_n", "k"]
    if average == "mean":
        got = rows.groupBy(*group).agg(F.avg("_p").alias("power"))
    elif average == "median":
        mid = exact_median(rows, group, "_p", "_mid")
        count = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_c"))
        # 1 + sum over even m < count of 1/(m + 1) - 1/m
        evens = F.sequence(F.lit(2), F.greatest(F.col("_c") - 1, F.lit(2)).cast("int"), F.lit(2))
        bias = F.when(F.col("_c") < 3, F.lit(1.0)).otherwise(F.aggregate(
            evens, F.lit(1.0), lambda acc, m: acc + F.lit(1.0) / (m + 1) - F.lit(1.0) / m))
        got = mid.join(count, group).withColumn("power", F.col("_mid") / bias)
    else:
        raise ValueError(f"unknown average {average!r}")
    freq = F.col("k") * fs / F.col("_n") if onesided else _frequencies(F.col("k"), F.col("_n"), fs)
    return got.select(*keys, "k", freq.alias("freq"), "power",
                      (F.lit(10.0) * F.log10(F.when(F.col("power") > 0, F.col("power")))).alias("db"))

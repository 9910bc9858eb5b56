"""Registered queries: windows, splits, resampling, evaluation, correlations."""
from pyspark.sql import functions as F

from aerofield.operators import evaluate, match, segments, sequence, stats
from aerofield.plans.queries_lines import numbered
from aerofield.plans.registry import query, r, rounded, sql
from aerofield.sources import adapters as src


@query("w10_sliding_windows", "W10", sql=sql("""SELECT rn, list_transform(list_concat(list_transform(range(0, 5 - len(v)), lambda i: v[1]), v),
    lambda x: round(x, 6)) AS mag_window FROM (SELECT rn, list(mag_1_uc) OVER (PARTITION BY flight, line ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v FROM samples)""", "samples"))
def _(spark, sf):
    got = segments.sliding_windows(src.samples(spark, sf), ["mag_1_uc"], 5)
    return got.select("rn", F.transform("mag_1_uc_window", lambda v: F.round(v, 6)).alias("mag_window"))


@query("w11_chunks", "W11", sql=sql("""SELECT flight, line, pos // 8 AS chunk, (pos // 8 + 1) * 8 AS "end", list(mag_1_uc ORDER BY pos) AS mag_1_uc
    FROM numbered GROUP BY flight, line, pos // 8 HAVING count(*) = 8""", "numbered"))
def _(spark, sf):
    return segments.chunks(src.samples(spark, sf), ["mag_1_uc"], 8)


_KEY = lambda row, seed: f"CAST('0x' || substr(md5('{seed}:' || CAST({row} AS VARCHAR)), 1, 15) AS BIGINT)"


@query("w12_random_split", "W12", sql=sql(f"""SELECT rn, p < floor(n * 0.7) AS in_train, p >= floor(n * 0.7) AS in_valid FROM
    (SELECT rn, row_number() OVER (ORDER BY {_KEY('rn', 5)}) - 1 AS p, count(*) OVER () AS n FROM samples)""", "samples"))
def _(spark, sf):
    return segments.split_rows(src.samples(spark, sf), 0.7, seed=5).select("rn", "in_train", "in_valid")


@query("w12_sliding_split", "W12", sql=sql("""SELECT rn, p < floor(n * 0.6) AS in_train, p >= floor(n * 0.6) + 19 AS in_valid FROM
    (SELECT rn, row_number() OVER (ORDER BY rn) - 1 AS p, count(*) OVER () AS n FROM samples)""", "samples"))
def _(spark, sf):
    return segments.split_rows(src.samples(spark, sf), 0.6, "sliding", 20).select("rn", "in_train", "in_valid")


@query("w12_contiguous_split", "W12", sql=sql(f""", b AS (SELECT rn, (row_number() OVER (ORDER BY rn) - 1) // 30 AS b FROM samples),
    o AS (SELECT b, row_number() OVER (ORDER BY {_KEY('b', 5)}) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT b FROM b))
    SELECT rn, p < floor(n * 0.8) AS in_train, p >= floor(n * 0.8) AS in_valid FROM b JOIN o ON b.b = o.b""", "samples"))
def _(spark, sf):
    return segments.split_rows(src.samples(spark, sf), 0.8, "contiguous", 30, 5).select("rn", "in_train", "in_valid")


@query("w13_fraction_split", "W13", sql=sql("""SELECT rn, CASE WHEN pos >= round(n_line * 0.9) THEN 2 WHEN pos >= round(n_line * 0.7) THEN 1 ELSE 0 END AS part FROM numbered""", "numbered"))
def _(spark, sf):
    return segments.split_fractions(src.samples(spark, sf), (0.7, 0.2, 0.1)).select("rn", "part")


@query("w14_curriculum", "W14", sql=sql("""SELECT rn, abs(d - m) <= 1.5 * s AS in_curriculum, abs(d - m) > 1.5 * s AS in_network FROM
    (SELECT rn, mag_1_uc - mag_1_c AS d, avg(mag_1_uc - mag_1_c) OVER () AS m, stddev_pop(mag_1_uc - mag_1_c) OVER () AS s FROM samples)""", "samples"))
def _(spark, sf):
    df = src.samples(spark, sf).withColumn("d", F.col("mag_1_uc") - F.col("mag_1_c"))
    return segments.curriculum(df, "d", 1.5).select("rn", "in_curriculum", "in_network")


@query("w15_adaptive_variance", "W15", sql=sql(f"""SELECT rn, {r('''CASE WHEN pos >= 10 THEN least(greatest(avg(e * e) OVER
    (PARTITION BY flight, line ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) - h, 1.0), 500.0) ELSE 4.0 END''', 'variance', 9)}
    FROM (SELECT *, mag_1_uc - mag_1_c AS e, 0.25 + rn % 4 / 8.0 AS h FROM numbered)""", "numbered"))
def _(spark, sf):
    df = src.samples(spark, sf).withColumns({"e": F.col("mag_1_uc") - F.col("mag_1_c"), "h": F.col("rn") % 4 / 8.0 + 0.25})
    return segments.adaptive_variance(df, "e", "h", 4.0, 1.0, 500.0).select("rn", *rounded(9, variance=F.col("variance")))


def _smooth_sql(width: int, kind: str, name: str) -> str:
    ahead = (width - 1) // 2
    w = segments.smoothing_weights(kind, width)
    table = ", ".join(f"({o}, {v!r}::DOUBLE)" for o, v in zip(range(ahead - width + 1, ahead + 1), w))
    return f"""{name} AS (SELECT a.rn, sum(b.mag_1_uc * k.w) AS {name} FROM numbered a, (VALUES {table}) AS k(o, w), numbered b
    WHERE a.flight = b.flight AND a.line = b.line AND b.pos = CASE WHEN a.pos + o < 0 THEN -(a.pos + o)
    WHEN a.pos + o >= a.n_line THEN 2 * (a.n_line - 1) - (a.pos + o) ELSE a.pos + o END GROUP BY a.rn)"""


_SMOOTH = {"flat": (11, "flat"), "hann": (9, "hanning"), "hamm": (8, "hamming"), "bart": (7, "bartlett"), "black": (5, "blackman")}


@query("w16_smoothed", "W16", sql=sql(", " + ", ".join(_smooth_sql(w, k, n) for n, (w, k) in _SMOOTH.items()) + " SELECT flat.rn, "
    + ", ".join(r(n, f"s_{n}", 7) for n in _SMOOTH) + " FROM flat " + " ".join(f"JOIN {n} USING (rn)" for n in list(_SMOOTH)[1:]), "numbered"))
def _(spark, sf):
    df = numbered(spark, sf)
    for n, (w, k) in _SMOOTH.items():
        df = segments.smooth(df, "mag_1_uc", w, k, f"s_{n}")
    return df.select("rn", *rounded(7, **{f"s_{n}": F.col(f"s_{n}") for n in _SMOOTH}))


@query("j8_nearest_in_time", "J8", sql=sql("""SELECT DISTINCT t.flight, t.t, (SELECT arg_min(s.rn, (abs(s.tt - t.t), s.tt)) FROM samples s WHERE s.flight = t.flight) AS rn
    FROM (SELECT flight, CAST(tt AS BIGINT) * 1.0::DOUBLE AS t FROM samples WHERE event_type = 'error'
    UNION ALL SELECT flight, -5.0::DOUBLE FROM samples) t""", "samples"))
def _(spark, sf):
    s = src.samples(spark, sf)
    times = s.filter("event_type = 'error'").select("flight", F.round("tt").alias("t"))
    times = times.unionByName(s.select("flight", F.lit(-5.0).alias("t")))
    return match.nearest_in_time(s, times).select("flight", "t", "rn")


@query("j13_systematic_resample", "J13", sql=sql("""SELECT c.flight, c.line, u.j AS draw, c.rn FROM (SELECT flight, line, rn, n_line, coalesce(sum(w) OVER
    (PARTITION BY flight, line ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(w) OVER (PARTITION BY flight, line ORDER BY rn) AS hi,
    sum(w) OVER (PARTITION BY flight, line) AS total FROM (SELECT *, CAST(rn * 31 % 17 AS BIGINT) AS w FROM numbered)) c,
    LATERAL (SELECT unnest(generate_series(1, c.n_line)) AS j) u
    WHERE (u.j - 0.37) / c.n_line >= lo / CAST(total AS DOUBLE) AND (u.j - 0.37) / c.n_line < hi / CAST(total AS DOUBLE)""", "numbered"))
def _(spark, sf):
    df = src.samples(spark, sf).withColumn("w", F.col("rn") * 31 % 17)
    return match.systematic_resample(df, "w", 0.37).select("flight", "line", "draw", "rn")


_E2, _A = "0.0818191908426", "6378137.0"
_FLAT = lambda lat: f"sqrt(1.0 - ({_E2} * sin({lat})) * ({_E2} * sin({lat})))"
_N = lambda d, lat: f"({d}) / {_FLAT(lat)} * {_A}"
_EAST = lambda d, lat: f"({d}) / {_FLAT(lat)} * {_A} * cos({lat})"
_SIZE = lambda i: "1e-8" if i < 2 else "0.1"
_X = lambda i: f"((rn + f * 3 + {i} * 5) % 11 - 5) * {_SIZE(i)}"
_P = lambda i: f"((rn + {i}) % 7 + 1) * {_SIZE(i)}"
_NAV = """, nav AS (SELECT *, lat + (rn % 13 - 6) * 1e-7 AS ins_lat, lon + (rn % 17 - 8) * 1e-7 AS ins_lon, alt + rn % 5 - 2.0 AS ins_alt FROM samples),
    fo AS (SELECT nav.*, f, filter FROM nav, (VALUES (0, 'ekf'), (1, 'mpf'), (2, 'nekf')) AS k(f, filter))"""
_FILT = _NAV + f""", fe AS (SELECT *, {_N(f'ins_lat + {_X(0)} - lat', f'(ins_lat + {_X(0)})')} AS n_err, {_EAST(f'ins_lon + {_X(1)} - lon', f'(ins_lat + {_X(0)})')} AS e_err,
    {_N(_P(0), f'(ins_lat + {_X(0)})')} AS n_std, {_EAST(_P(1), f'(ins_lat + {_X(0)})')} AS e_std,
    ins_alt + {_X(2)} - alt AS alt_err, {_X(8)} AS td_err, {_P(9)} AS ha_std, CASE WHEN f < 2 THEN {_P(17)} ELSE 0 END AS fogm_std,
    CASE WHEN f < 2 THEN {_X(17)} ELSE 0 END AS est_fogm FROM fo) """


def _truth(spark, sf):
    s = src.samples(spark, sf)
    still = {f"ins_{v}": F.col(v) for v in ("vn", "ve", "vd")}
    return s.withColumns({**still, "ins_cnb": F.col("cnb")})


@query("a4_position_drms", "A4", sql=sql(_FILT + f"""SELECT 'ins' AS what, CAST(round_even(sqrt(avg(n * n + e * e)), 0) AS BIGINT) AS drms FROM
    (SELECT {_N('(rn % 13 - 6) * 1e-7', 'ins_lat')} AS n, {_EAST('(rn % 17 - 8) * 1e-7', 'ins_lat')} AS e FROM nav)
    UNION ALL SELECT 'bound', CAST(round_even(sqrt(avg(n * n + e * e)), 0) AS BIGINT) FROM (SELECT {_N(_P(0), 'lat')} AS n, {_EAST(_P(1), 'lat')} AS e FROM samples)
    UNION ALL SELECT filter, CAST(round_even(sqrt(avg(n_err * n_err + e_err * e_err)), 0) AS BIGINT) FROM fe GROUP BY filter""", "samples"))
def _(spark, sf):
    truth, got = _truth(spark, sf), src.filter_results(spark, sf)
    ins = evaluate.drms_by(evaluate.ins_errors(truth).withColumn("what", F.lit("ins")), ["what"])
    bound = evaluate.bound_deviations(truth, got.filter("filter = 'ekf'").select("flight", "line", "rn", "p_diag"))
    bound = evaluate.drms_by(bound.withColumn("what", F.lit("bound")), ["what"], "n_std", "e_std")
    filt = evaluate.drms_by(evaluate.filter_errors(truth, got), ["filter"]).withColumnRenamed("filter", "what")
    return ins.unionByName(bound).unionByName(filt)


_COLS = ["n_err", "e_err", "n_std", "e_std", "alt_err", "td_err", "ha_std", "fogm_std", "est_fogm"]


@query("a5_filter_errors", "A5", sql=sql(_FILT + "SELECT filter, rn, " + ", ".join(r(c, c, 4) for c in _COLS) + " FROM fe", "samples"))
def _(spark, sf):
    got = evaluate.filter_errors(_truth(spark, sf), src.filter_results(spark, sf))
    return got.select("filter", "rn", *rounded(4, **{c: F.col(c) for c in _COLS}))


@query("a6_filters_by_flight", "A6", "A4", sql=sql(_FILT + """SELECT flight, filter, CAST(round_even(sqrt(avg(n_err * n_err + e_err * e_err)), 0) AS BIGINT) AS drms FROM fe GROUP BY 1, 2""", "samples"))
def _(spark, sf):
    return evaluate.drms_by(evaluate.filter_errors(_truth(spark, sf), src.filter_results(spark, sf)), ["flight", "filter"])


@query("a7_paired_offsets", "A7", sql=sql(" UNION ALL ".join(f"SELECT 'mag_{i}' AS mag, {r(f'avg(mag_{i}_uc - mag_{i}_c)', 'mean', 5)}, {r(f'stddev_pop(mag_{i}_uc - mag_{i}_c)', 'std', 5)} FROM samples" for i in (1, 2)), "samples"))
def _(spark, sf):
    got = stats.paired_offsets(src.samples(spark, sf), {f"mag_{i}": (f"mag_{i}_uc", f"mag_{i}_c") for i in (1, 2)})
    return got.select("mag", *rounded(5, mean=F.col("mean"), std=F.col("std")))


@query("a8_correlation", "A8", sql=sql(f"""SELECT flight, line, {r('corr(alt, cur_strb)', 'corr')}, {r('regr_slope(cur_strb, alt)', 'slope')},
    {r('regr_intercept(cur_strb, alt)', 'intercept', 4)}, count(*) AS n FROM samples GROUP BY 1, 2 HAVING abs(corr(alt, cur_strb)) > 0.05""", "samples"))
def _(spark, sf):
    got = stats.correlation(src.samples(spark, sf), "alt", "cur_strb", limit=0.05)
    return got.select("flight", "line", *rounded(corr=F.col("corr"), slope=F.col("slope")), *rounded(4, intercept=F.col("intercept")), "n")


_F4 = ["mag_1_uc", "mag_2_c", "alt", "cur_strb"]


@query("a9_correlation_matrix", "A9", sql=sql(" UNION ALL ".join(f"""SELECT '{a}' AS "row", '{b}' AS col, {r(f'corr({a}, {b})', 'corr')} FROM samples""" for i, a in enumerate(_F4) for b in _F4[:i + 1]), "samples"))
def _(spark, sf):
    return stats.correlation_matrix(src.samples(spark, sf), _F4).select("row", "col", *rounded(corr=F.col("corr")))


@query("a10_density_histogram", "A10", sql=sql(f""", l AS (SELECT min(mag_1_uc) AS lo, max(mag_1_uc) AS hi, count(*) AS n FROM samples)
    SELECT b.bin, count(s.bin) AS count, {r('count(s.bin) / CAST(any_value(n) AS DOUBLE) / any_value((hi - lo) / 40)', 'density')}
    FROM (SELECT range AS bin FROM range(40)) b CROSS JOIN l LEFT JOIN
    (SELECT CAST(least(floor((mag_1_uc - lo) / ((hi - lo) / 40)), 39) AS BIGINT) AS bin FROM samples, l) s USING (bin) GROUP BY 1""", "samples"))
def _(spark, sf):
    return stats.histogram(src.samples(spark, sf), "mag_1_uc", 40).select("bin", "count", *rounded(density=F.col("density")))


@query("a17_weighted_moments", "A17", sql=sql(f""", w AS (SELECT flight, line, mag_1_uc AS a, alt AS b, (rn * 31 % 17 + 1) / 10.0 AS q FROM samples),
    m AS (SELECT flight, line, sum(q * a) / sum(q) AS ma, sum(q * b) / sum(q) AS mb, sum(q) AS s FROM w GROUP BY 1, 2)
    SELECT flight, line, {r('any_value(ma)', 'mean_a', 5)}, {r('any_value(mb)', 'mean_b', 5)}, {r('sum(q / s * (a - ma) * (a - ma)) + 2.5', 'cov_a_a', 4)},
    {r('sum(q / s * (a - ma) * (b - mb))', 'cov_a_b', 4)}, {r('sum(q / s * (b - mb) * (b - mb))', 'cov_b_b', 4)}, {r('1.0 / sum(q / s * q / s)', 'n_eff', 4)}
    FROM w JOIN m USING (flight, line) GROUP BY 1, 2""", "samples"))
def _(spark, sf):
    df = src.samples(spark, sf).select("flight", "line", F.col("mag_1_uc").alias("a"), F.col("alt").alias("b"), ((F.col("rn") * 31 % 17 + 1) / 10.0).alias("q"))
    got = stats.weighted_moments(df, ["a", "b"], "q", extra={("a", "a"): 2.5})
    return got.select("flight", "line", *rounded(5, mean_a=F.col("mean_a"), mean_b=F.col("mean_b")),
                      *rounded(4, **{c: F.col(c) for c in ("cov_a_a", "cov_a_b", "cov_b_b", "n_eff")}))


@query("t1_sorted_altitudes", "T1", sql="SELECT alt, place FROM (SELECT alt, row_number() OVER (ORDER BY alt) - 1 AS place FROM (SELECT DISTINCT CAST(event_id % 97 + 300 AS DOUBLE) AS alt FROM events))")
def _(spark, sf):
    alts = src.samples(spark, sf).select("alt").distinct()
    return sequence.range_ranked(alts, ["alt"], into="place")

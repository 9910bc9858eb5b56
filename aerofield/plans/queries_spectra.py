"""Registered queries: spectra of lines and of maps."""
import math

from pyspark.sql import functions as F

from aerofield.operators import maps, mapspectra, spectra
from aerofield.plans.queries_lines import numbered
from aerofield.plans.registry import query, r, rounded, sql
from aerofield.sources import adapters as src

_PI2 = "6.283185307179586"


def _spec_sql(v: str, keys: str = "flight, line") -> str:
    """Transform of arrays xs (list) per key: rows with k and the two sums."""
    return f"""SELECT {keys}, k, n, any_value(w1) AS w1, any_value(w2) AS w2,
        sum(x * cos({_PI2} * ((pos * k) % n) / n)) AS re, -sum(x * sin({_PI2} * ((pos * k) % n) / n)) AS im
        FROM {v}, LATERAL (SELECT unnest(generate_series(0, n // 2)) AS k) GROUP BY {keys}, k, n"""


_WINDOWED = f""", d AS (SELECT flight, line, pos, n_line AS n, mag_1_uc - avg(mag_1_uc) OVER (PARTITION BY flight, line) AS v,
    0.5 - 0.5 * cos({_PI2} * pos / n_line) AS w FROM numbered),
    x AS (SELECT *, v * w AS x, sum(w) OVER (PARTITION BY flight, line) AS w1, sum(w * w) OVER (PARTITION BY flight, line) AS w2 FROM d),
    f AS ({_spec_sql('x')}) """


@query("w21_periodogram", "W21", sql=sql(_WINDOWED + f"""SELECT flight, line, k, {r('k * 10.0 / n', 'freq')},
    {r('(re * re + im * im) / (w2 * 10.0) * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END', 'power', 4)} FROM f""", "numbered"))
def _(spark, sf):
    got = spectra.periodogram(numbered(spark, sf), "mag_1_uc", 10.0)
    return got.select("flight", "line", "k", *rounded(freq=F.col("freq")), *rounded(4, power=F.col("power")))


_PLAIN = f""", x AS (SELECT flight, line, pos, n_line AS n, mag_1_uc AS x, 1.0 AS w1, 1.0 AS w2 FROM numbered), f AS ({_spec_sql('x')}) """


@query("w21_spectral_amplitude", "W21", sql=sql(_PLAIN + f"SELECT flight, line, k, {r('sqrt(re * re + im * im)', 'amp', 4)} FROM f", "numbered"))
def _(spark, sf):
    return spectra.spectral_amplitude(numbered(spark, sf), "mag_1_uc", 10.0).select("flight", "line", "k", *rounded(4, amp=F.col("amp")))


def _segment_sql(size: int, step: int, window: str) -> str:
    w = {"hann": f"0.5 - 0.5 * cos({_PI2} * p / {size})", "hamming": f"0.54 - 0.46 * cos({_PI2} * p / {size})"}[window]
    return f""", s AS (SELECT flight, line, seg, pos - seg * {step} AS p, mag_1_uc AS v FROM numbered, LATERAL (SELECT unnest(
    generate_series(0, (n_line - {size}) // {step})) AS seg) WHERE pos BETWEEN seg * {step} AND seg * {step} + {size - 1}),
    d AS (SELECT flight, line, seg, p AS pos, {size} AS n, (v - avg(v) OVER (PARTITION BY flight, line, seg)) AS v, {w} AS w FROM s),
    x AS (SELECT *, v * w AS x, sum(w) OVER (PARTITION BY flight, line, seg) AS w1, sum(w * w) OVER (PARTITION BY flight, line, seg) AS w2 FROM d),
    f AS ({_spec_sql('x', 'flight, line, seg')}),
    g AS (SELECT *, (re * re + im * im) / (w2 * 10.0) * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS power FROM f) """


@query("w22_welch_mean", "W22", sql=sql(_segment_sql(64, 32, "hann") + f"""SELECT flight, line, k, {r('any_value(k * 10.0 / n)', 'freq')},
    {r('avg(power)', 'power', 4)}, {r('10 * log10(avg(power))', 'db', 4)} FROM g GROUP BY 1, 2, 3""", "numbered"))
def _(spark, sf):
    got = spectra.welch(numbered(spark, sf), "mag_1_uc", 10.0, nperseg=64)
    return got.select("flight", "line", F.col("k").cast("long").alias("k"), *rounded(freq=F.col("freq")), *rounded(4, power=F.col("power"), db=F.col("db")))


@query("w22_welch_median", "W22", sql=sql(_segment_sql(64, 32, "hann") + f"""SELECT flight, line, k, {r('''median(power) / (1 + CASE WHEN count(*) < 3 THEN 0
    ELSE list_sum(list_transform(range(2, count(*), 2), lambda m: 1.0 / (m + 1) - 1.0 / m)) END)''', 'power', 4)} FROM g GROUP BY 1, 2, 3""", "numbered"))
def _(spark, sf):
    got = spectra.welch(numbered(spark, sf), "mag_1_uc", 10.0, nperseg=64, average="median")
    return got.select("flight", "line", F.col("k").cast("long").alias("k"), *rounded(4, power=F.col("power")))


@query("w22_spectrogram", "W22", sql=sql(_segment_sql(64, 56, "hamming") + f"""SELECT flight, line, seg, k, {r('(seg * 56 + 32) / 10.0', 'time')},
    {r('power', 'power', 4)}, {r('10 * log10(power)', 'db', 4)} FROM g""", "numbered"))
def _(spark, sf):
    got = spectra.spectrogram(numbered(spark, sf), "mag_1_uc", 10.0, nperseg=64)
    return got.select("flight", "line", "seg", F.col("k").cast("long").alias("k"), *rounded(time=F.col("time")), *rounded(4, power=F.col("power"), db=F.col("db")))


def tile_cells(spark, sf):
    """Embedding tiles as maps with unit steps, values scaled up."""
    return maps.cells_of_arrays(src.tiles(spark, sf)).select(
        "map_id", "iz", "iy", "ix", F.col("ix").cast("double").alias("xx"), F.col("iy").cast("double").alias("yy"),
        F.lit(300.0).alias("alt"), (F.col("val") * 100.0).alias("val"), ((F.col("ix") + F.col("iy")) % 5 != 0).alias("mask"))


def _axis(n: int) -> str:
    return f"(SELECT unnest(generate_series(0, {n - 1})))"


# spectrum of n x n tiles t: first over x, then over y; kx and ky with unit steps
def _forward(n: int = 8) -> str:
    wave = lambda j: f"(CASE WHEN {j} <= {(n - 1) // 2} THEN {j} ELSE {j} - {n} END) * {_PI2} / {n}"
    turn = lambda i, j: f"({_PI2} * (({i} * {j}) % {n}) / {n})"
    return f""", fx AS (SELECT map_id, iy, jx, sum(v * cos{turn('ix', 'jx')}) AS re, -sum(v * sin{turn('ix', 'jx')}) AS im
    FROM t, {_axis(n)} AS a(jx) GROUP BY 1, 2, 3),
    fw AS (SELECT map_id, jx, jy, sum(re * cos{turn('iy', 'jy')} + im * sin{turn('iy', 'jy')}) AS re,
    sum(im * cos{turn('iy', 'jy')} - re * sin{turn('iy', 'jy')}) AS im, {wave('jx')} AS kx, {wave('jy')} AS ky
    FROM fx, {_axis(n)} AS b(jy) GROUP BY map_id, jx, jy), sp AS (SELECT *, sqrt(kx * kx + ky * ky) AS k FROM fw) """


_TILE = ", t AS (SELECT map_id, iy, ix, CASE WHEN (ix + iy) % 5 <> 0 THEN val * 100.0 ELSE 0 END AS v FROM tiles)"
_FORWARD = _TILE + _forward()


def _back(spec: str, keys: str = "", n: int = 8) -> str:
    """Inverse of a spectrum (re, im), real part, in two steps."""
    g = f"map_id{keys}"
    turn = lambda i, j: f"({_PI2} * (({i} * {j}) % {n}) / {n})"
    return f""", iy1 AS (SELECT {g}, jx, iy, sum(re * cos{turn('iy', 'jy')} - im * sin{turn('iy', 'jy')}) / {n} AS re,
    sum(re * sin{turn('iy', 'jy')} + im * cos{turn('iy', 'jy')}) / {n} AS im FROM {spec}, {_axis(n)} AS c(iy) GROUP BY {g}, jx, iy),
    bw AS (SELECT {g}, iy, ix, sum(re * cos{turn('ix', 'jx')} - im * sin{turn('ix', 'jx')}) / {n} AS val
    FROM iy1, {_axis(n)} AS d(ix) GROUP BY {g}, iy, ix) """


@query("f1_wavenumbers", "F1", sql=f"""SELECT map_id, iy, ix, {r(f"(CASE WHEN ix <= (nx - 1) // 2 THEN ix ELSE ix - nx END) * {_PI2} / (nx * 2.0)", 'kx')},
    {r(f"(CASE WHEN iy <= (ny - 1) // 2 THEN iy ELSE iy - ny END) * {_PI2} / (ny * 3.0)", 'ky')} FROM
    (SELECT p_type AS map_id, max(p_size) AS nx, count(DISTINCT p_brand) AS ny FROM part GROUP BY 1),
    LATERAL (SELECT unnest(generate_series(0, ny - 1)) AS iy), LATERAL (SELECT unnest(generate_series(0, CAST(nx AS BIGINT) - 1)) AS ix)""")
def _(spark, sf):
    sizes = src.table(spark, sf, "part").groupBy(F.col("p_type").alias("map_id")).agg(
        F.max("p_size").cast("long").alias("nx"), F.count_distinct("p_brand").alias("ny")).withColumns({"dx": F.lit(2.0), "dy": F.lit(3.0)})
    return mapspectra.wavenumbers(sizes).select("map_id", "iy", "ix", *rounded(kx=F.col("kx"), ky=F.col("ky")))


@query("f2_map_power", "F2", sql=sql(_FORWARD + f"SELECT map_id, jx, jy, {r('re * re + im * im', 'psd', 4)} FROM sp", "tiles"))
def _(spark, sf):
    return mapspectra.power(tile_cells(spark, sf)).select("map_id", "jx", "jy", *rounded(4, psd=F.col("psd")))


@query("f2_price_map_power", "F2", sql=sql(f""", g AS (SELECT y.iy, x.ix, coalesce(c.val, 0) AS v FROM (SELECT DISTINCT iy FROM cells) y CROSS JOIN
    (SELECT DISTINCT ix FROM cells) x LEFT JOIN cells c ON c.iy = y.iy AND c.ix = x.ix),
    fx AS (SELECT iy, jx, sum(v * cos({_PI2} * (((ix - 1) * jx) % 50) / 50)) AS re, -sum(v * sin({_PI2} * (((ix - 1) * jx) % 50) / 50)) AS im
    FROM g, {_axis(50)} AS a(jx) GROUP BY 1, 2),
    fw AS (SELECT jx, jy, sum(re * cos({_PI2} * (((iy - 1) * jy) % 25) / 25) + im * sin({_PI2} * (((iy - 1) * jy) % 25) / 25)) AS re,
    sum(im * cos({_PI2} * (((iy - 1) * jy) % 25) / 25) - re * sin({_PI2} * (((iy - 1) * jy) % 25) / 25)) AS im FROM fx, {_axis(25)} AS b(jy) GROUP BY 1, 2)
    SELECT jx, jy, {r('(re * re + im * im) / 1562500.0', 'psd', 4)} FROM fw""", "cells"))
def _(spark, sf):
    cells = maps.full_grid(src.map_cells(spark, sf))
    return mapspectra.power(cells).select("jx", "jy", *rounded(4, psd=F.col("psd") / 1562500.0))


@query("f3_upward_continuation", "F3", sql=sql(_FORWARD + """, h AS (SELECT map_id, level AS iz, jx, jy, re * exp(-k * dz) AS re, im * exp(-k * dz) AS im
    FROM sp, (VALUES (0::BIGINT, 0.5), (1::BIGINT, 2.0)) AS l(level, dz))""" + _back("h", ", iz") + f"SELECT map_id, iz, iy, ix, {r('val', 'val', 5)} FROM bw", "tiles"))
def _(spark, sf):
    return mapspectra.continued(tile_cells(spark, sf), [302.0, 300.5]).select("map_id", "iz", "iy", "ix", *rounded(5, val=F.col("val")))


# tiles led around the ring by three cells on every side: rows first, then columns
_RING = "CASE WHEN r <= 3 THEN 7 + r ELSE r - 7 END"
_PADDED = f""", t0 AS (SELECT map_id, iy, ix, CASE WHEN (ix + iy) % 5 <> 0 THEN val * 100.0 ELSE 0 END AS v FROM tiles),
    tx AS (SELECT map_id, iy, ix, v FROM t0 UNION ALL SELECT a.map_id, a.iy, {_RING}, b.v + (a.v - b.v) * r / 7.0
    FROM t0 a JOIN t0 b ON a.map_id = b.map_id AND a.iy = b.iy AND a.ix = 0 AND b.ix = 7, generate_series(1, 6) AS s(r)),
    ty AS (SELECT map_id, iy, ix, v FROM tx UNION ALL SELECT a.map_id, {_RING}, a.ix, b.v + (a.v - b.v) * r / 7.0
    FROM tx a JOIN tx b ON a.map_id = b.map_id AND a.ix = b.ix AND a.iy = 0 AND b.iy = 7, generate_series(1, 6) AS s(r)),
    t AS (SELECT map_id, iy + 3 AS iy, ix + 3 AS ix, v FROM ty)"""


@query("f3_padded", "F3", sql=sql(_PADDED + _forward(14) + ", h AS (SELECT map_id, jx, jy, re * exp(-k) AS re, im * exp(-k) AS im FROM sp)"
    + _back("h", "", 14) + f"SELECT map_id, iy - 3 AS iy, ix - 3 AS ix, {r('val', 'val', 5)} FROM bw WHERE iy BETWEEN 3 AND 10 AND ix BETWEEN 3 AND 10", "tiles"))
def _(spark, sf):
    return mapspectra.continued(tile_cells(spark, sf), [301.0], pad=3).select("map_id", "iy", "ix", *rounded(5, val=F.col("val")))


@query("f3_downward_continuation", "F3", sql=sql(_FORWARD + """, u AS (SELECT *, exp(k * 0.5) AS g FROM sp),
    h AS (SELECT map_id, jx, jy, re * g / (1 + 0.1 * k * k * g) AS re, im * g / (1 + 0.1 * k * k * g) AS im FROM u)""" + _back("h") + f"SELECT map_id, iy, ix, {r('val', 'val', 5)} FROM bw", "tiles"))
def _(spark, sf):
    return mapspectra.continued(tile_cells(spark, sf), [299.5], 0.1).select("map_id", "iy", "ix", *rounded(5, val=F.col("val")))


_GAUSS = lambda length: f"exp(-k * k / (2 * ({_PI2} / {length}) * ({_PI2} / {length})))"
_PASSES = {"lowpass": (_GAUSS("5.0"), None), "highpass": (f"(1 - {_GAUSS('4.0')})", 4.0),
           "bandpass": (f"({_GAUSS('3.0')} - {_GAUSS('6.0')})", (3.0, 6.0))}


def _register_pass(kind: str, h: str, length):
    @query(f"f4_map_{kind}", "F4", sql=sql(_FORWARD + f", h AS (SELECT map_id, jx, jy, re * {h} AS re, im * {h} AS im FROM sp)"
           + _back("h") + f"SELECT map_id, iy, ix, {r('val', 'val', 5)} FROM bw", "tiles"))
    def _(spark, sf):
        return mapspectra.smoothed(tile_cells(spark, sf), kind, length).select("map_id", "iy", "ix", *rounded(5, val=F.col("val")))


for _kind, (_h, _length) in _PASSES.items():
    _register_pass(_kind, _h, _length)


@query("f5_spectral_gradient", "F5", sql=sql(_FORWARD + """, h AS (SELECT map_id, axis, jx, jy, -w * im AS re, w * re AS im FROM
    (SELECT *, CASE WHEN axis = 'x' THEN kx ELSE ky END AS w FROM sp, (VALUES ('x'), ('y')) AS a(axis)))""" + _back("h", ", axis") + f"SELECT map_id, axis, iy, ix, {r('val', 'grad', 5)} FROM bw", "tiles"))
def _(spark, sf):
    return mapspectra.spectral_gradient(tile_cells(spark, sf)).select("map_id", "axis", "iy", "ix", *rounded(5, grad=F.col("grad")))


_D, _I = 0.2, 1.1
_L, _M, _N = (repr(v) for v in (math.cos(_I) * math.cos(_D), math.cos(_I) * math.sin(_D), math.sin(_I)))


@query("f6_vector_components", "F6", sql=sql(_FORWARD + f""", q AS (SELECT *, k * {_N}::DOUBLE AS p, kx * {_L}::DOUBLE + ky * {_M}::DOUBLE AS q FROM sp, (VALUES ('x'), ('y'), ('z')) AS a(part)),
    g AS (SELECT *, CASE WHEN jx = 0 AND jy = 0 THEN 1 WHEN part = 'z' THEN k * p / (p * p + q * q) WHEN part = 'x' THEN kx * q / (p * p + q * q) ELSE ky * q / (p * p + q * q) END AS hr,
    CASE WHEN jx = 0 AND jy = 0 THEN 0 WHEN part = 'z' THEN -k * q / (p * p + q * q) WHEN part = 'x' THEN kx * p / (p * p + q * q) ELSE ky * p / (p * p + q * q) END AS hi FROM q),
    h AS (SELECT map_id, part, jx, jy, re * hr - im * hi AS re, re * hi + im * hr AS im FROM g)""" + _back("h", ", part") + f"SELECT map_id, part, iy, ix, {r('val', 'field', 5)} FROM bw", "tiles"))
def _(spark, sf):
    return mapspectra.vector_components(tile_cells(spark, sf), _D, _I).select("map_id", "part", "iy", "ix", *rounded(5, field=F.col("field")))


@query("f7_regularization_curve", "F7", sql=sql(_FORWARD + """, u AS (SELECT *, exp(k * 1.0) AS g FROM sp, (VALUES (0, 0.01), (1, 0.1), (2, 1.0), (3, 10.0)) AS a(step, alpha)),
    h AS (SELECT map_id, step, jx, jy, re * g / (1 + alpha * k * k * g) AS re, im * g / (1 + alpha * k * k * g) AS im FROM u)""" + _back("h", ", step")
    + f""", c AS (SELECT map_id, step, abs(val - lag(val) OVER (PARTITION BY map_id, iy, ix ORDER BY step)) AS d FROM bw WHERE (ix + iy) % 5 <> 0)
    SELECT map_id, step, {r('max(d)', 'norm', 5)} FROM c WHERE step > 0 GROUP BY 1, 2""", "tiles"))
def _(spark, sf):
    got = mapspectra.regularization_curve(tile_cells(spark, sf), -1.0, [0.01, 0.1, 1.0, 10.0])
    return got.select("map_id", "step", *rounded(5, norm=F.col("norm")))

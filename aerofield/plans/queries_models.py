"""Registered queries: differences, attitude, design columns, normalization, fits."""
from pyspark.sql import functions as F

from aerofield.functions import attitude, compensation as comp
from aerofield.functions.filters import butterworth
from aerofield.operators import differences, filtering, leastsquares, models, segments, select, stats
from aerofield.operators.sequence import BLOCK_CONF, number_rows
from aerofield.plans.queries_lines import numbered
from aerofield.plans.registry import least_squares, query, r, rounded, sql
from aerofield.session import materialized
from aerofield.sources import adapters as src

_W = "WINDOW w AS (PARTITION BY flight, line ORDER BY rn)"
_SCHEMES = ["backward", "forward", "central", "backward2", "forward2", "fourth"]


def _unit(v: str, scheme: str) -> str:
    """SQL of a unit-step difference; x(k) is the value k rows on."""
    x = lambda k: f"lead({v}, {k}) OVER w" if k > 0 else f"lag({v}, {-k}) OVER w" if k else v
    on, back = f"({x(1)} - {v})", f"({v} - {x(-1)})"
    first, last = f"WHEN pos = 0 THEN {on}", f"WHEN pos = n_line - 1 THEN {back}"
    return {
        "backward": f"CASE WHEN n_line < 2 THEN 0 {first} ELSE {back} END",
        "forward": f"CASE WHEN n_line < 2 THEN 0 {last} ELSE {on} END",
        "central": f"CASE WHEN n_line < 3 THEN 0 {first} {last} ELSE ({x(1)} - {x(-1)}) / 2.0 END",
        "backward2": f"CASE WHEN n_line < 4 THEN 0 {first} WHEN pos = 1 THEN {back} "
                     f"ELSE ({v} * 3.0 - {x(-1)} * 4.0 + {x(-2)}) / 2.0 END",
        "forward2": f"CASE WHEN n_line < 4 THEN 0 WHEN pos >= n_line - 2 THEN {back} "
                    f"ELSE ({x(1)} * 4.0 - {x(2)} - {v} * 3.0) / 2.0 END",
        "fourth": f"CASE WHEN n_line < 5 OR pos < 2 OR pos >= n_line - 2 THEN 0 "
                  f"ELSE ({x(-2)} - {x(-1)} * 4.0 + {v} * 6.0 - {x(1)} * 4.0 + {x(2)}) / 16.0 END",
    }[scheme]


@query("w1_unit_differences", "W1", sql=sql("SELECT rn, " + ", ".join(
    r(_unit("mag_1_uc", s), s) for s in _SCHEMES) + f", 0.0::DOUBLE AS other FROM numbered {_W}", "numbered"))
def _(spark, sf):
    got = differences.add_differences(numbered(spark, sf), ["mag_1_uc"], [*_SCHEMES, "other"])
    return got.select("rn", *rounded(**{s: F.col(f"mag_1_uc_{s}") for s in [*_SCHEMES, "other"]}))


def _deriv(v: str, d: str, scheme: str) -> str:
    x = lambda k: f"lead({v}, {k}) OVER w" if k > 0 else f"lag({v}, {-k}) OVER w" if k else v
    dd = lambda k: f"lead({d}, {k}) OVER w" if k > 0 else f"lag({d}, {-k}) OVER w" if k else d
    first, last = f"WHEN pos = 0 THEN ({x(1)} - {v}) / {d}", f"WHEN pos = n_line - 1 THEN ({v} - {x(-1)}) / {d}"
    return {
        "central": f"CASE {first} {last} ELSE ({x(1)} - {x(-1)}) / ({dd(1)} + {dd(-1)}) END",
        "forward": f"CASE {last} ELSE ({x(1)} - {v}) / {d} END",
        "backward": f"CASE {first} ELSE ({v} - {x(-1)}) / {dd(-1)} END",
        "fourth": f"CASE {first} {last} WHEN pos = 1 OR pos = n_line - 2 THEN ({x(1)} - {x(-1)}) / ({d} + {dd(-1)}) "
                  f"ELSE ({x(-2)} - {x(-1)} * 8.0 + {x(1)} * 8.0 - {x(2)}) / ({d} * 12.0) END",
    }[scheme]


_DERIVS = ["central", "forward", "backward", "fourth"]


@query("w2_derivatives", "W2", sql=sql(", t AS (SELECT *, 0.1 + rn % 3 / 100.0 AS dt FROM numbered) SELECT rn, " + ", ".join(
    r(_deriv("mag_1_uc", "dt", s), s) for s in _DERIVS) + f" FROM t {_W}", "numbered"))
def _(spark, sf):
    df = numbered(spark, sf).withColumn("dt", F.lit(0.1) + F.col("rn") % 3 / 100.0)
    got = differences.add_derivatives(df, {"m": F.col("mag_1_uc")}, F.col("dt"), {s: s for s in _DERIVS})
    return got.select("rn", *rounded(**{s: F.col(f"m_{s}") for s in _DERIVS}))


_FDM = {"mag_1_uc_dot": ("mag_1_uc", "central"), "mag_1_uc_dot4": ("mag_1_uc", "fourth"),
        **{f"{a}_fdm": (a, "central") for a in ("roll", "pitch", "yaw")},
        **{f"{a}_{f}_fdm": (f"{a}_{f}", "central") for a in ("roll", "pitch", "yaw") for f in ("sin", "cos")}}


@query("w4_derivative_features", "W4", sql=sql(", t AS (SELECT *, 0.1::DOUBLE AS dt, " + ", ".join(
    f"{f}({a}) AS {a}_{f}" for a in ("roll", "pitch", "yaw") for f in ("sin", "cos")) + " FROM numbered) SELECT rn, "
    + ", ".join(r(_deriv(v, "dt", s), n, 5) for n, (v, s) in _FDM.items()) + f" FROM t {_W}", "numbered"))
def _(spark, sf):
    got = differences.derivative_features(numbered(spark, sf), ["mag_1_uc"], F.lit(0.1))
    return got.select("rn", *rounded(5, **{n: F.col(n) for n in _FDM}))


# body-to-navigation matrix of the samples' angles, row-major
_DCM = """, dcm AS (SELECT *, cos(yaw)*cos(pitch) AS c0, cos(yaw)*sin(pitch)*sin(roll) - sin(yaw)*cos(roll) AS c1,
    cos(yaw)*sin(pitch)*cos(roll) + sin(yaw)*sin(roll) AS c2, sin(yaw)*cos(pitch) AS c3,
    sin(yaw)*sin(pitch)*sin(roll) + cos(yaw)*cos(roll) AS c4, sin(yaw)*sin(pitch)*cos(roll) - cos(yaw)*sin(roll) AS c5,
    -sin(pitch) AS c6, cos(pitch)*sin(roll) AS c7, cos(pitch)*cos(roll) AS c8 FROM samples) """


@query("p10_attitude_angles", "P10", sql=sql(_DCM + f"""SELECT rn, {r('roll', 'roll')}, {r('pitch', 'pitch')},
    {r('yaw', 'yaw')}, {r('atan2(c5, c8)', 'roll_t')}, {r('-asin(c2)', 'pitch_t')}, {r('atan2(c1, c0)', 'yaw_t')} FROM dcm""", "samples"))
def _(spark, sf):
    own = attitude.to_euler(F.col("cnb"), "body2nav")
    turned = attitude.to_euler(F.col("cnb"), "nav2body")
    return src.samples(spark, sf).select("rn", *rounded(**own, **{f"{n}_t": c for n, c in turned.items()}))


@query("p11_attitude_matrices", "P11", sql=sql(_DCM + f"""SELECT rn, {', '.join(r(f'c{i}', f'c{i}') for i in range(9))},
    {r('cos(pitch)*cos(yaw)', 'x0')}, {r('-cos(pitch)*sin(yaw)', 'x1')}, {r('sin(pitch)', 'x2')},
    {r('cos(roll)*sin(yaw) + sin(roll)*sin(pitch)*cos(yaw)', 'x3')}, {r('-sin(roll)*cos(pitch)', 'x5')},
    {r('sin(roll)*sin(yaw) - cos(roll)*sin(pitch)*cos(yaw)', 'x6')}, {r('cos(roll)*cos(pitch)', 'x8')} FROM dcm""", "samples"))
def _(spark, sf):
    m, x = F.col("cnb"), F.col("_x")
    df = src.samples(spark, sf).withColumn("_x", attitude.from_euler(F.col("roll"), F.col("pitch"), F.col("yaw"), "xyz"))
    return df.select("rn", *rounded(**{f"c{i}": m[i] for i in range(9)}, **{f"x{i}": x[i] for i in (0, 1, 2, 3, 5, 6, 8)}))


def _tilt_sql(sign: str) -> str:
    s = ["0", "-tz", "ty", "tz", "0", "-tx", "-ty", "tx", "0"]
    sq = ["-(ty*ty + tz*tz)", "tx*ty", "tx*tz", "tx*ty", "-(tx*tx + tz*tz)", "ty*tz", "tx*tz", "ty*tz", "-(tx*tx + ty*ty)"]
    b = [f"({1 if i % 4 == 0 else 0} - a * ({s[i]}) {sign} b * ({sq[i]}))" for i in range(9)]
    return [f"{b[3 * i]} * c{j} + {b[3 * i + 1]} * c{3 + j} + {b[3 * i + 2]} * c{6 + j}" for i in range(3) for j in range(3)]


@query("p12_tilt_correction", "P12", sql=sql(_DCM + """, t AS (SELECT *, (rn % 9 - 4) / 10.0 AS tx, (rn % 5 - 2) / 10.0 AS ty,
    (rn % 3 - 1) / 10.0 AS tz FROM dcm), u AS (SELECT *, sqrt(tx*tx + ty*ty + tz*tz) AS m FROM t),
    v AS (SELECT *, CASE WHEN m <= 1e-8 THEN 0 ELSE sin(m) / m END AS a,
    CASE WHEN m <= 1e-8 THEN 0 ELSE (1 - cos(m)) / (m * m) END AS b FROM u) SELECT rn, """
    + ", ".join(r(e, f"d{i}") for i, e in enumerate(_tilt_sql("-"))) + ", "
    + ", ".join(r(e, f"r{i}") for i, e in enumerate(_tilt_sql("+"))) + " FROM v", "samples"))
def _(spark, sf):
    tilt = [(F.col("rn") % k - k // 2) / 10.0 for k in (9, 5, 3)]
    df = src.samples(spark, sf).select("rn", attitude.tilt_corrected(F.col("cnb"), *tilt).alias("d"),
                                       attitude.tilt_corrected(F.col("cnb"), *tilt, True).alias("r"))
    return df.select("rn", *rounded(**{f"{k}{i}": F.col(k)[i] for k in "dr" for i in range(9)}))


def _product_sql(name: str) -> str:
    fn, ang = {"c": "cos", "s": "sin"}, {"r": "roll", "p": "pitch", "y": "yaw"}
    return " * ".join(f"{fn[f]}({ang[a]})" for f, a in zip(name[::2], name[1::2]))


@query("p13_attitude_features", "P13", sql=sql(_DCM + "SELECT rn, " + ", ".join(
    [r(f"c{3 * j + i}", f"dcm_{3 * j + i + 1}") for j in range(3) for i in range(3)]
    + [r(_product_sql(n), n) for n in attitude.ANGLE_PRODUCTS]
    + [r(f"{f}({a})", f"{a}_{f}") for a in ("roll", "pitch", "yaw") for f in ("sin", "cos")]) + " FROM dcm", "samples"))
def _(spark, sf):
    feats = attitude.angle_features(F.col("roll"), F.col("pitch"), F.col("yaw"))
    return src.samples(spark, sf).select("rn", *rounded(**feats))


_ALL_TERMS = ["p", "i6", "i5", "i3", "e9", "e8", "e3", "f3", "b"]


def _design_sql(terms) -> dict[str, str]:
    out = {}
    for name in comp.term_names(terms):
        word, _, axes = name.partition("_")
        if word == "perm":
            out[name] = f"f{axes} / bt"
        elif word == "rate":
            out[name] = f"d{axes}"
        elif word == "bias":
            out[name] = "1.0"
        else:
            out[name] = f"f{axes[0]} / bt * {'f' if word[0] == 'i' else 'd'}{axes[1]} / 50000.0"
    return out


def design_view(total: str = "ft") -> str:
    rates = ", ".join(f"{_unit('f' + a, 'central')} AS d{a}" for a in "xyz")
    return f""", rates AS (SELECT *, {rates}, CASE WHEN {total} = 0 THEN 2.220446049250313e-16 ELSE {total} END AS bt
    FROM numbered {_W}), design AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _design_sql(_ALL_TERMS).items())} FROM rates) """


@query("p14_design_matrix", "P14", sql=sql(design_view() + "SELECT rn, " + ", ".join(
    r(n if not n.startswith(("ind", "eddy")) else f"{n} * 1e3", n) for n in comp.term_names(_ALL_TERMS)) + " FROM design", "numbered"))
def _(spark, sf):
    df, names = select.with_design(numbered(spark, sf), terms=_ALL_TERMS)
    big = lambda n: F.col(n) * 1e3 if n.startswith(("ind", "eddy")) else F.col(n)
    return df.select("rn", *rounded(**{n: big(n) for n in names}))


@query("p14_design_scalar_total", "P14", sql=sql(design_view("mag_2_c") + "SELECT rn, " + ", ".join(
    r(n if n.startswith("perm") else f"{n} * 1e3", n) for n in comp.term_names()) + " FROM design", "numbered"))
def _(spark, sf):
    df, names = select.with_design(numbered(spark, sf), total="mag_2_c")
    return df.select("rn", *rounded(**{n: F.col(n) if n.startswith("perm") else F.col(n) * 1e3 for n in names}))


_COEF = [round(0.5 + ((i * 7) % 11) / 4 - 1, 4) for i in range(18)]
_COEF_SQL = ", ".join(f"({i}, {v}::DOUBLE)" for i, v in enumerate(_COEF))


@query("p15_coefficient_matrices", "P15", sql=f"""WITH c AS (SELECT user_id, {", ".join(f"coalesce(max(CASE WHEN event_id % 18 = {i} THEN value END), 0) AS c{i}" for i in range(18))}
    FROM events GROUP BY user_id) SELECT user_id, {r('c0', 'p0', 4)}, {r('c3 / 50000.0 * 1e4', 'i0', 4)}, {r('c4 / 50000.0 / 2 * 1e4', 'i1', 4)},
    {r('c14 / 50000.0 * 1e4', 'e5', 4)}, {r('c4', 'back4', 4)}, 18 AS width FROM c""")
def _(spark, sf):
    # a coefficient table with one model per user
    at = lambda i: F.coalesce(F.max(F.when(F.col("event_id") % 18 == i, F.col("value"))), F.lit(0.0))
    models_ = src.table(spark, sf, "events").groupBy("user_id").agg(F.array(*[at(i) for i in range(18)]).alias("coef"))
    mats = comp.coefficient_matrices([F.col("coef")[i] for i in range(18)], comp.DEFAULT_TERMS)
    back = comp.coefficient_vector(*mats.values(), comp.DEFAULT_TERMS)
    return models_.select("user_id", *rounded(4, p0=mats["permanent"][0], i0=mats["induced"][0] * 1e4, i1=mats["induced"][1] * 1e4,
                                              e5=mats["eddy"][5] * 1e4, back4=back[4]), F.lit(len(back)).alias("width"))


def _field_sql() -> str:
    m = comp.coefficient_matrices(_COEF, comp.DEFAULT_TERMS)
    rows = []
    for i, a in enumerate("xyz"):
        ind = " + ".join(f"f{b} * {m['induced'][3 * i + j]!r}::DOUBLE" for j, b in enumerate("xyz"))
        edd = " + ".join(f"d{b} * {m['eddy'][3 * i + j]!r}::DOUBLE" for j, b in enumerate("xyz"))
        rows += [r(f"{m['permanent'][i]!r}::DOUBLE + ({ind}) + ({edd})", f"field_{a}", 9), r(f"({edd}) * 1e3", f"eddy_{a}")]
    return ", ".join(rows)


@query("p16_aircraft_field", "P16", sql=sql(design_view() + f"SELECT rn, {_field_sql()} FROM design", "numbered"))
def _(spark, sf):
    df, _ = select.with_design(numbered(spark, sf), keep_rates=True)
    rate = {a: F.col(f"_rate_{a}") for a in "xyz"}
    out = comp.aircraft_field(select.field_of(), rate, comp.coefficient_matrices(_COEF, comp.DEFAULT_TERMS))
    return df.select("rn", *rounded(9, **{f"field_{a}": out[a] for a in "xyz"}),
                     *rounded(**{f"eddy_{a}": out[f"eddy_{a}"] * 1e3 for a in "xyz"}))


@query("p17_vector_total", "P17", sql=sql(f"SELECT rn, {r('ft', 'total')} FROM samples", "samples"))
def _(spark, sf):
    from aerofield.functions.geodesy import magnitude
    return src.samples(spark, sf).select("rn", *rounded(total=magnitude(*select.field_of().values())))


_DOT = " + ".join(f"{n} * {v!r}::DOUBLE" for n, v in zip(comp.term_names(), _COEF))


@query("p18_imputed_earth_field", "P18", sql=sql(design_view() + f"SELECT rn, {r(f'mag_1_uc - ({_DOT})', 'earth')} FROM design", "numbered"))
def _(spark, sf):
    df, names = select.with_design(numbered(spark, sf))
    return df.select("rn", *rounded(earth=F.col("mag_1_uc") - comp.weighted_sum([F.col(n) for n in names], _COEF)))


_NORMS = {"standardize": ("avg({c})", "stddev_pop({c})"), "normalize": ("min({c})", "max({c}) - min({c})"),
          "scale": ("0.0", "max(abs({c}))"), "none": ("0.0", "1.0")}


def _norm_sql() -> str:
    parts = []
    for kind, (b, s) in _NORMS.items():
        for c in ("mag_1_uc", "roll"):
            parts.append(f"SELECT '{kind}' AS kind, '{c}' AS feature, {r(b.format(c=c), 'bias', 5)}, {r(s.format(c=c), 'scale', 5)} FROM {'samples' if kind != 'none' else '(SELECT 1)'}")
        parts.append(f"SELECT '{kind}', 'alt', 0.0, 1.0 FROM (SELECT 1)")
    return " UNION ALL ".join(parts)


@query("a16_normalization", "A16", sql=sql(_norm_sql(), "samples"))
def _(spark, sf):
    df, rows = src.samples(spark, sf), []
    for kind in _NORMS:
        got = stats.normalization(df, ["mag_1_uc", "roll", "alt"], kind, ["alt"])
        rows += [(kind, c, float(b), float(s)) for c, (b, s) in got.items()]
    return spark.createDataFrame(rows, "kind string, feature string, bias double, scale double").select(
        "kind", "feature", *rounded(5, bias=F.col("bias"), scale=F.col("scale")))


@query("p22_normalized_columns", "P22", sql=sql(f"""SELECT rn, {r('(mag_1_uc - (SELECT avg(mag_1_uc) FROM samples)) / (SELECT stddev_pop(mag_1_uc) FROM samples)', 'z', 5)},
    {r('mag_1_uc', 'back', 4)}, alt FROM samples""", "samples"))
def _(spark, sf):
    df = src.samples(spark, sf)
    norm = stats.normalization(df, ["mag_1_uc"], "standardize")
    there = select.normalized(df, norm).withColumn("z", F.col("mag_1_uc"))
    return select.normalized(there, norm, undo=True).select("rn", *rounded(5, z=F.col("z")), *rounded(4, back=F.col("mag_1_uc")), "alt")


@query("w9_detrended", "W9", sql=sql(f"""SELECT rn, {r('mag_1_uc - avg(mag_1_uc) OVER l', 'mean_free', 7)},
    {r('mag_1_uc - regr_intercept(mag_1_uc, pos) OVER l - regr_slope(mag_1_uc, pos) OVER l * pos', 'line_free', 5)}
    FROM numbered WINDOW l AS (PARTITION BY flight, line)""", "numbered"))
def _(spark, sf):
    df = models.detrend(numbered(spark, sf), "mag_1_uc", "mean", into="mean_free")
    df = models.detrend(df, "mag_1_uc", "line", into="line_free")
    return df.select("rn", *rounded(7, mean_free=F.col("mean_free")), *rounded(5, line_free=F.col("line_free")))


@query("w9_regression_residual", "W9", sql=sql(f"""SELECT rn,
    {r('mag_1_uc - regr_intercept(mag_1_uc, alt) OVER l - regr_slope(mag_1_uc, alt) OVER l * alt', 'free', 4)}
    FROM numbered WINDOW l AS (PARTITION BY flight, line)""", "numbered"))
def _(spark, sf):
    df = models.detrend(numbered(spark, sf), "mag_1_uc", "columns", ["alt"], into="free")
    return df.select("rn", *rounded(4, free=F.col("free")))


@query("w20_trimmed_lines", "W20", sql=sql("SELECT rn FROM numbered WHERE n_line > 220 AND pos BETWEEN 110 AND n_line - 111", "numbered"))
def _(spark, sf):
    return segments.trim_lines(src.samples(spark, sf), 110).select("rn")


_TERMS = comp.term_names()
_PAIRS = [(a, b) for i, a in enumerate([*_TERMS, "mag_1_uc"]) for b in [*_TERMS, "mag_1_uc"][i:]]


@query("m1_gram_per_line", "M1", sql=sql(design_view() + "SELECT flight, line, count(*) AS n, " + ", ".join(
    r(f"sum({a} * {b})", f"g{i}", 4) for i, (a, b) in enumerate(_PAIRS)) + " FROM design GROUP BY 1, 2", "numbered"))
def _(spark, sf):
    df, names = select.with_design(numbered(spark, sf))
    g = models.gram(df, [*names, "mag_1_uc"], ("flight", "line"))
    return g.select("flight", "line", "n", *rounded(4, **{f"g{i}": F.col("gram")[19 + i] for i in range(len(_PAIRS))}))


@query("m1_two_feature_fit", "M1", sql=sql(f""", s AS (SELECT sum(ft * ft) + 0.025 AS a, sum(ft * alt) AS b, sum(alt * alt) + 0.025 AS c,
    sum(ft * mag_1_uc) AS p, sum(alt * mag_1_uc) AS q FROM samples)
    SELECT 'ft' AS term, {r('(p * c - q * b) / (a * c - b * b)', 'coef')} FROM s
    UNION ALL SELECT 'alt', {r('(a * q - b * p) / (a * c - b * b)')} FROM s""", "samples"))
def _(spark, sf):
    df = src.samples(spark, sf).withColumn("ft", F.col("flux_a.t"))
    b, _ = models.ridge_fit(df, ["ft", "alt"], "mag_1_uc", 0.025)
    return spark.createDataFrame([("ft", float(b[0])), ("alt", float(b[1]))], "term string, coef double").select(
        "term", *rounded(coef=F.col("coef")))


@query("m2_linear_fit_errors", "M2", "M3", sql=sql(f""", t AS (SELECT * FROM numbered WHERE n_line > 40 AND pos BETWEEN 20 AND n_line - 21),
    s AS (SELECT avg(ft) AS bx, stddev_pop(ft) AS sx, avg(mag_1_uc) AS yb, stddev_pop(mag_1_uc) AS ys FROM samples),
    k AS (SELECT sum((ft - bx) / sx * (mag_1_uc - yb) / ys) / sum(((ft - bx) / sx) * ((ft - bx) / sx)) AS coef FROM t, s),
    e AS (SELECT flight, line, rn, coef * (ft - bx) / sx * ys + yb - mag_1_uc AS e FROM samples, s, k)
    SELECT rn, {r('e - avg(e) OVER (PARTITION BY flight, line)', 'err', 5)} FROM e""", "numbered"))
def _(spark, sf):
    df = numbered(spark, sf).withColumn("ft", F.col("flux_a.t"))
    model = models.linear_fit(df, ["ft"], "mag_1_uc", 20, 0.0, "standardize", "standardize")
    return models.score(df, model, "mag_1_uc").select("rn", *rounded(5, err=F.col("err")))


def flagship(spark, sf):
    """Aircraft-field model over all lines: residual spread per line."""
    df, names = select.with_design(numbered(spark, sf).withColumn("y", F.col("mag_1_uc") - F.col("mag_1_c")))
    model = models.linear_fit(df, names, "y", ridge=0.025)
    scored = models.score(df, model, "y")
    return scored.groupBy("flight", "line").agg(F.count(F.lit(1)).alias("n"),
                                                F.round(F.stddev_pop("err"), 4).alias("err_std")).orderBy("flight", "line")


def _predicted(terms) -> str:
    """SQL of a linear model's value from the coefficient table ``b`` with one row."""
    return " + ".join(f"fit.{t} * b.{t}" for t in terms)


def _wide(terms) -> str:
    """The table ``coef`` as one row."""
    return "b AS (SELECT " + ", ".join(f"max(CASE WHEN term = '{t}' THEN value END) AS {t}" for t in terms) + " FROM coef)"


query("m3_line_error_spread", "M1", "M3", sql=sql(
    design_view() + ", fit AS (SELECT *, mag_1_uc - mag_1_c AS y FROM design)" + least_squares("fit", comp.term_names(), "y", 0.025)
    + f""", {_wide(comp.term_names())}, e AS (SELECT flight, line, {_predicted(comp.term_names())} - y AS e FROM fit, b)
    SELECT flight, line, count(*) AS n, {r("stddev_pop(e)", "err_std", 4)} FROM e GROUP BY 1, 2""", "numbered"))(flagship)


_FAR = 50_000.0  # nT: the Earth's field that a survey sits on


@query("m1_offset_fit", "M1", "M2", sql=sql(
    design_view() + f", fit AS (SELECT *, mag_1_uc + {_FAR} AS y FROM design)" + least_squares("fit", [*comp.term_names()[:6], "bias"], "y")
    + f"SELECT term, {r('value', 'value', 4)} FROM coef", "numbered"))
def _(spark, sf):
    df, names = select.with_design(numbered(spark, sf).withColumn("y", F.col("mag_1_uc") + _FAR), terms=_ALL_TERMS)
    xs = [*comp.term_names()[:6], "bias"]
    b, _, _ = leastsquares.fit(df, xs, ["y"])
    return spark.createDataFrame([(t, float(v)) for t, v in zip(xs, b[:, 0])], "term string, value double").select(
        "term", *rounded(4, value=F.col("value")))


@query("m1_orthogonal_residuals", "M1", sql=f"""SELECT term, 0.0::DOUBLE AS cosine, 19 AS rank
    FROM (VALUES {", ".join(f"('{t}')" for t in [*comp.term_names(), "bias", "again"])}) AS t(term)""")
def _(spark, sf):
    """The cosine of the residual with each column of the design, two of them collinear."""
    df, names = select.with_design(numbered(spark, sf).withColumn("y", F.col("mag_1_uc") + _FAR), terms=_ALL_TERMS)
    xs = [*comp.term_names(), "bias", "again"]
    rows = df.withColumn("again", 2 * F.col(xs[0])).select(*xs, "y")
    b, _, rank = leastsquares.fit(rows, xs, ["y"])
    e = F.col("y") - comp.weighted_sum([F.col(x) for x in xs], b[:, 0].tolist())
    sums = rows.select(*xs, e.alias("e")).agg(*[F.struct(F.lit(x).alias("term"), (
        F.sum(F.col(x) * F.col("e")) / F.sqrt(F.sum(F.col(x) * F.col(x)) * F.sum(F.col("e") * F.col("e")))).alias("c")).alias(f"s{i}") for i, x in enumerate(xs)])
    return sums.select(F.explode(F.array(*sums.columns)).alias("s")).select(
        "s.term", (F.round("s.c", 6) + 0.0).alias("cosine"), F.lit(rank).alias("rank"))


@query("m1_collinear_fit", "M1", sql=sql(f"""SELECT {r('a - t', 'c0', 4)}, {r('b - 2 * t', 'c1', 4)}, {r('t', 'c2', 4)}, 2 AS rank
    FROM (SELECT a, b, (a + 2 * b) / 6 AS t FROM (SELECT regr_intercept(mag_1_uc + {_FAR}, mag_2_uc) AS a, regr_slope(mag_1_uc + {_FAR}, mag_2_uc) AS b FROM samples))""", "samples"))
def _(spark, sf):
    """Of all solutions over (1, x, 1 + 2 x) the one of least norm."""
    x = F.col("mag_2_uc")
    df = src.samples(spark, sf).select(F.lit(1.0).alias("c0"), x.alias("c1"), (1 + 2 * x).alias("c2"), (F.col("mag_1_uc") + _FAR).alias("y"))
    b, _, rank = leastsquares.fit(df, ["c0", "c1", "c2"], ["y"])
    return spark.createDataFrame([(*map(float, b[:, 0]), rank)], "c0 double, c1 double, c2 double, rank int").select(
        *rounded(4, **{c: F.col(c) for c in ("c0", "c1", "c2")}), "rank")


def _taps(sections, n: int) -> str:
    """Impulse response values of a filter as SQL rows (j, h)."""
    import numpy as np
    x = np.zeros(n)
    x[0] = 1.0
    return ", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(sections.recurse(x)[0].tolist()))


def _filtered(sections, columns: list[str], view: str = "numbered", taps: int = 420) -> str:
    """CTEs up to ``z(line, pos, ...)``: direct convolution of the odd-extended lines of a
    view, forward and backward; a column that is constant on a line stays."""
    pad, gain = sections.pad, f"{sections.gain!r}::DOUBLE"
    ends = "OVER (PARTITION BY line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    m = range(len(columns))
    each = lambda text: ", ".join(text.replace("@", str(i)) for i in m)
    passed = lambda rows, on, lag: f"""SELECT a.line, a.n_line, a.pos, {each(f"{gain} * any_value(a.w@) + sum(h * (b.v@ - b.w@)) AS v@")}
    FROM {rows} a JOIN {rows} b ON a.line = b.line AND {on} JOIN taps ON j = {lag}"""
    return f""", taps(j, h) AS (VALUES {_taps(sections, taps)}),
    x AS (SELECT line, n_line, pos, {", ".join(f"CAST({c} AS DOUBLE) AS v{i}, first_value({c}) {ends} AS f{i}, last_value({c}) {ends} AS l{i}" for i, c in enumerate(columns))} FROM {view}),
    e AS (SELECT line, n_line, pos, {each("v@")} FROM x UNION ALL SELECT line, n_line, -pos, {each("2 * f@ - v@")} FROM x WHERE pos BETWEEN 1 AND {pad}
    UNION ALL SELECT line, n_line, 2 * (n_line - 1) - pos, {each("2 * l@ - v@")} FROM x WHERE pos BETWEEN n_line - 1 - {pad} AND n_line - 2),
    d AS (SELECT *, {each("first_value(v@) OVER (PARTITION BY line ORDER BY pos) AS w@")} FROM e),
    f AS ({passed("d", "b.pos <= a.pos", "a.pos - b.pos")} GROUP BY 1, 2, 3),
    g AS (SELECT *, {each("first_value(v@) OVER (PARTITION BY line ORDER BY pos DESC) AS w@")} FROM f),
    still AS (SELECT line, {each("CASE WHEN min(v@) = max(v@) THEN min(v@) END AS s@")} FROM x GROUP BY line),
    z AS (SELECT line, n_line, pos, {", ".join(f"coalesce(s{i}, v{i}) AS {c}" for i, c in enumerate(columns))} FROM ({passed("g", "b.pos >= a.pos", "b.pos - a.pos")}
    WHERE a.pos BETWEEN 0 AND a.n_line - 1 GROUP BY 1, 2, 3) JOIN still USING (line))"""


def _zero_phase_sql(sections, column: str, into: str | None = None, taps: int = 420) -> str:
    return f"""{_filtered(sections, [column], taps=taps)}
    SELECT rn, """ + r(f"z.{column}", into or column, 5) + " FROM z JOIN numbered n ON n.line = z.line AND n.pos = z.pos"


_BAND, _LOW = butterworth(0.1, 0.9, 10.0), butterworth(0.0, 0.2, 10.0)


@query("w17_band_passed_mag", "W17", sql=sql(_zero_phase_sql(_BAND, "mag_1_uc"), "numbered"))
def _(spark, sf):
    got = filtering.zero_phase(numbered(spark, sf), ["mag_1_uc"], _BAND, keep=["rn"])
    return got.select("rn", *rounded(5, mag_1_uc=F.col("mag_1_uc")))


@query("w17_low_passed_currents", "W17", sql=sql(_zero_phase_sql(_LOW, "cur_strb", "lpf_cur_strb"), "numbered"))
def _(spark, sf):
    got = filtering.low_pass_currents(numbered(spark, sf), ["cur_strb"], 10.0, ["rn"])
    return got.select("rn", *rounded(5, lpf_cur_strb=F.col("lpf_cur_strb")))


_SLOW = butterworth(0.01, 0.0, 160.0)  # remembers far more rows than a flight has


@query("w17_long_memory", "W17", sql=sql(""", whole AS (SELECT * EXCLUDE (line, pos, n_line), flight AS line,
    row_number() OVER (PARTITION BY flight ORDER BY rn) - 1 AS pos, count(*) OVER (PARTITION BY flight) AS n_line FROM numbered)"""
    + _filtered(_SLOW, ["mag_1_uc"], "whole", 2600) + f" SELECT rn, {r('z.mag_1_uc', 'mag_1_uc', 2)} FROM z JOIN whole n ON n.line = z.line AND n.pos = z.pos", "numbered"))
def _(spark, sf):
    """Whole flights in blocks of 512 rows."""
    held = spark.conf.get(BLOCK_CONF, None)
    spark.conf.set(BLOCK_CONF, "512")
    try:
        rows = src.samples(spark, sf).select("flight", "rn", "mag_1_uc")
        got = filtering.zero_phase(rows, ["mag_1_uc"], _SLOW, ["rn"], ("flight",))
    finally:
        spark.conf.unset(BLOCK_CONF) if held is None else spark.conf.set(BLOCK_CONF, held)
    return got.select("rn", *rounded(2, mag_1_uc=F.col("mag_1_uc")))


@query("w18_causal_filter", "W18", sql=sql(f""", taps(j, h) AS (VALUES {_taps(butterworth(0.0, 0.9, 10.0), 320)})
    SELECT a.rn, {r('sum(h * b.mag_1_uc)', 'mag_1_uc', 5)} FROM numbered a JOIN numbered b ON a.line = b.line AND b.pos <= a.pos
    JOIN taps ON j = a.pos - b.pos GROUP BY a.rn""", "numbered"))
def _(spark, sf):
    got = filtering.causal(numbered(spark, sf), ["mag_1_uc"], butterworth(0.0, 0.9, 10.0), keep=["rn"])
    return got.select("rn", *rounded(5, mag_1_uc=F.col("mag_1_uc")))


def _state_taps(f, size: int) -> str:
    """(lag, component, weight): each section's two delays after an impulse and ``lag`` zeros."""
    delays, out = [[0.0, 0.0] for _ in f.rows], []
    for lag in range(size):
        x = 1.0 if lag == 0 else 0.0
        for (b0, b1, b2, _, a1, a2), d in zip(f.rows, delays):
            y = b0 * x + d[0]
            d[0], d[1], x = b1 * x - a1 * y + d[1], b2 * x - a2 * y, y
        out += [f"({lag}, {c}, {v!r}::DOUBLE)" for c, v in enumerate(v for d in delays for v in d)]
    return ", ".join(out)


@query("w18_closing_state", "W18", sql=sql(f""", taps(lag, c, h) AS (VALUES {_state_taps(butterworth(0.0, 0.9, 10.0), 320)}),
    s AS (SELECT flight, line, c, {r('sum(h * mag_1_uc)', 'v', 5)} FROM numbered JOIN taps ON lag = n_line - 1 - pos GROUP BY 1, 2, 3)
    SELECT flight, line, list(v ORDER BY c) AS state FROM s GROUP BY 1, 2""", "numbered"))
def _(spark, sf):
    return filtering.closing_state(numbered(spark, sf), "mag_1_uc", butterworth(0.0, 0.9, 10.0)).select(
        "flight", "line", F.transform("state", lambda s: F.round(s, 5)).alias("state"))


def coef_frame(spark, names, coef):
    return spark.createDataFrame([(i, n, float(v)) for i, (n, v) in enumerate(zip(names, coef))],
                                 "idx int, term string, value double")


_TERMS = comp.term_names()


@query("m4_compensation_coefficients", "M4", sql=sql(
    design_view() + _filtered(_BAND, [*_TERMS, "mag_1_uc"], "design") + ", fit AS (SELECT * FROM z WHERE pos >= 20 AND pos < n_line - 20)"
    + least_squares("fit", _TERMS, "mag_1_uc", 0.025) + f""", {_wide(_TERMS)}
    SELECT CAST(idx AS INTEGER) AS idx, term, {r('value', 'value', 4)} FROM coef UNION ALL
    SELECT {len(_TERMS)}, 'residual_variance', {r(f'var_pop(mag_1_uc - ({_predicted(_TERMS)}))', 'value', 4)} FROM fit, b""", "numbered"))
def _(spark, sf):
    coef, var = models.compensation_fit(src.samples(spark, sf), "mag_1_uc", ridge=0.025)
    return coef_frame(spark, [*_TERMS, "residual_variance"], [*coef, var]).select("idx", "term", *rounded(4, value=F.col("value")))


_FEATS = ["mag_2_uc", "alt", "cur_strb", "igrf"]


# statistics of two features a, b and the target y over a selection, standardized products included
def _two(where: str = "TRUE", a: str = "mag_2_uc", b: str = "alt", y: str = "mag_1_uc") -> str:
    return f"""SELECT avg({a}) AS ma, stddev_pop({a}) AS sa, avg({b}) AS mb, stddev_pop({b}) AS sb, avg({y}) AS my, stddev_pop({y}) AS sy,
    corr({a}, {b}) AS c, corr({a}, {y}) AS ca, corr({b}, {y}) AS cb, count(*) AS n FROM fit WHERE {where}"""


# first PLS component: direction (ca, cb), score variance 1 +- c, regression on it
_PLS = """, k AS (SELECT *, ca / sqrt(ca * ca + cb * cb) AS wa, cb / sqrt(ca * ca + cb * cb) AS wb FROM t),
    q AS (SELECT *, (ca * wa + cb * wb) / (1 + 2 * wa * wb * c) AS q FROM k)"""
_PLS_HAT = "((mag_2_uc - ma) / sa * wa + (alt - mb) / sb * wb) * q * sy + my"
_AB = ["mag_2_uc", "alt"]


@query("m5_partial_least_squares", "M5", "M3", sql=sql(f""", fit AS (SELECT * FROM samples), t AS ({_two()}){_PLS}
    SELECT rn, {r(_PLS_HAT, 'y_hat', 5)} FROM samples, q""", "samples"))
def _(spark, sf):
    df = src.samples(spark, sf)
    model = models.pls_fit(df, _AB, "mag_1_uc", 1)
    return models.score(df, model, "mag_1_uc").select("rn", *rounded(5, y_hat=F.col("y_hat")))


@query("m5_all_components", "M5")
def _(spark, sf):
    df = src.samples(spark, sf)
    sets = models.pls_fit(df, _FEATS, "mag_1_uc", 4, every_k=True)
    rows = [(k + 1, n, float(v)) for k, b in enumerate(sets) for n, v in zip(_FEATS, b)]
    return spark.createDataFrame(rows, "components int, term string, value double")


# one standardized feature: soft threshold of the correlation, then shrinkage
@query("m6_elastic_net", "M6", sql=sql(f"""SELECT 'mag_2_uc' AS term, {r('sign(c) * greatest(abs(c) - 0.1 * 0.5, 0) / (1 + 0.1 * 0.5)', 'value', 5)}
    FROM (SELECT corr(mag_2_uc, mag_1_uc) AS c FROM samples)""", "samples"))
def _(spark, sf):
    model = models.elastic_net_fit(src.samples(spark, sf), ["mag_2_uc"], "mag_1_uc", 0.1, 0.5)
    return coef_frame(spark, model.names, model.coef).select("term", *rounded(5, value=F.col("value")))


@query("m7_elastic_net_cv", "M7")
def _(spark, sf):
    model = models.elastic_net_cv(src.samples(spark, sf), _FEATS, "mag_1_uc", 0.5)
    return coef_frame(spark, [*model.names, "intercept"], [*model.coef, model.bias])


@query("m8_model_kinds", "M8")
def _(spark, sf):
    df = src.samples(spark, sf).withColumn("map_val", F.col("mag_1_c") * 0.5)
    df = materialized(number_rows(df.select("flight", "line", "rn", "mag_1_uc", "mag_1_c", "flux_a", "map_val", *_FEATS)), "numbered")  # for all kinds
    out = None
    for kind in models.KINDS:
        m = models.train(df, kind, _FEATS, map_val="map_val")
        part = models.score_on(df, m, _FEATS if kind in ("elasticnet", "plsr") else ()).agg(
            F.lit(kind).alias("kind"), F.round(F.stddev_pop("err"), 4).alias("err_std"))
        out = part if out is None else out.unionByName(part)
    return out


@query("m10_train_and_test_lines", "M10", "J1", "M8", sql=sql(f""", picked AS (SELECT s.* FROM samples s JOIN lines l ON s.flight = l.flight
    AND s.line = l.line AND s.tt BETWEEN l.t_start AND l.t_end), fit AS (SELECT *, mag_1_uc - mag_1_c AS d FROM picked),
    t AS ({_two('line % 2 = 0', y='d')}){_PLS}, e AS (SELECT flight, line, {_PLS_HAT} - d AS e FROM fit, q WHERE line % 2 = 1)
    SELECT flight, line, count(*) AS n, {r('stddev_pop(e)', 'err_std', 5)} FROM e GROUP BY 1, 2""", "lines"))
def _(spark, sf):
    lines = src.lines(spark, sf)
    every_line = [x["line"] for x in lines.select("line").collect()]
    part = lambda odd: [n for n in every_line if n % 2 == odd]
    _, scored = models.train_and_test(src.samples(spark, sf), lines, src.flights(spark, sf),
                                      part(0), part(1), "plsr", xs=_AB, k=1)
    return scored.groupBy("flight", "line").agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_pop("err"), 5).alias("err_std"))


@query("m9_whitened_features", "M9", "T3")
def _(spark, sf):
    df = src.samples(spark, sf)
    axes, norm = models.whitening(df, _FEATS, 2)
    return models.project(df, _FEATS, axes, norm).select("rn", *rounded(5, pc_0=F.col("pc_0"), pc_1=F.col("pc_1")))


# two standardized features with positive correlation c: first axis (1, 1)/sqrt(2), variance (1 + c) n/(n - 1)
@query("t3_first_axis", "T3", "M9", sql=sql(f""", s AS (SELECT avg(mag_1_uc) AS ma, stddev_pop(mag_1_uc) AS sa,
    avg(mag_2_uc) AS mb, stddev_pop(mag_2_uc) AS sb, corr(mag_1_uc, mag_2_uc) AS c, count(*) AS n FROM samples)
    SELECT rn, {r('((mag_1_uc - ma) / sa + (mag_2_uc - mb) / sb) / sqrt(2.0) / sqrt((1 + c) * n / (n - 1.0))', 'pc_0', 5)}
    FROM samples, s""", "samples"))
def _(spark, sf):
    df = src.samples(spark, sf)
    axes, norm = models.whitening(df, ["mag_1_uc", "mag_2_uc"], 1)
    return models.project(df, ["mag_1_uc", "mag_2_uc"], axes, norm).select("rn", *rounded(5, pc_0=F.col("pc_0")))


_SHUFFLE = "CAST('0x' || substr(md5('7:' || CAST(rn AS VARCHAR)), 1, 15) AS BIGINT)"
# two standardized features: coefficients from the correlations
_IMPORTANCE = f""", fit AS (SELECT * FROM samples), t AS ({_two()}),
    b AS (SELECT *, (ca - cb * c) / (1 - c * c) * sy / sa AS ba, (cb - ca * c) / (1 - c * c) * sy / sb AS bb FROM t),
    o AS (SELECT flight, line, mag_1_uc, mag_2_uc, alt, row_number() OVER (ORDER BY rn) AS p FROM samples),
    d AS (SELECT mag_2_uc AS pa, alt AS pb, row_number() OVER (ORDER BY {_SHUFFLE}) AS p FROM samples),
    e AS (SELECT flight, line, ba * (pa - ma) + bb * (alt - mb) + my - mag_1_uc AS e0, ba * (mag_2_uc - ma) + bb * (pb - mb) + my - mag_1_uc AS e1
    FROM o JOIN d USING (p), b),
    v AS (SELECT e0 - avg(e0) OVER (PARTITION BY flight, line) AS e0, e1 - avg(e1) OVER (PARTITION BY flight, line) AS e1 FROM e),
    imp AS (SELECT 0 AS idx, 'mag_2_uc' AS feature, sqrt(avg(e0 * e0)) AS err_std FROM v UNION ALL SELECT 1, 'alt', sqrt(avg(e1 * e1)) FROM v) """


def _importance(spark, sf):
    df = src.samples(spark, sf)
    model = models.linear_fit(df, _AB, "mag_1_uc", kind_x="standardize", kind_y="standardize")
    return models.permutation_importance(df, model, "mag_1_uc", 7)


@query("m11_permutation_importance", "M11", "T2", sql=sql(_IMPORTANCE + f"SELECT idx, feature, {r('err_std', 'err_std', 5)} FROM imp", "samples"))
def _(spark, sf):
    return _importance(spark, sf).select("idx", "feature", *rounded(5, err_std=F.col("err_std")))


def _dropped_sql(i: int, gone: str, left: str) -> str:
    return f"""SELECT {i} AS idx, '{gone}' AS feature, {r('sqrt(avg(e * e))', 'err_std', 5)} FROM (SELECT b * {left} - mag_1_uc
    - avg(b * {left} - mag_1_uc) OVER (PARTITION BY flight, line) AS e FROM samples,
    (SELECT sum({left} * mag_1_uc) / (sum({left} * {left}) + 0.025) AS b FROM samples))"""


@query("m12_drop_importance", "M12", sql=sql(_dropped_sql(0, "mag_2_uc", "alt") + " UNION ALL " + _dropped_sql(1, "alt", "mag_2_uc"), "samples"))
def _(spark, sf):
    rows = models.drop_importance(src.samples(spark, sf), _AB, "mag_1_uc", 0.025)
    return spark.createDataFrame(rows, "idx int, feature string, err_std double").select("idx", "feature", *rounded(5, err_std=F.col("err_std")))


@query("m13_rolling_refit", "M13", sql=sql(f""", o AS (SELECT row_number() OVER (ORDER BY rn) - 1 AS p, count(*) OVER () AS n, mag_2_uc AS x, mag_1_uc AS y FROM samples),
    c AS (SELECT w, sum(x * y) / (sum(x * x) + 0.025) AS b FROM o, LATERAL (SELECT unnest(generate_series(0, 49)) AS w) WHERE p >= w AND p < w + n - 49 GROUP BY w),
    a AS (SELECT sum(x * y) / (sum(x * x) + 0.025) AS b, sum(x * x) AS xx FROM o)
    SELECT 'mag_2_uc' AS term, {r('(SELECT stddev_pop(b) FROM c) * 1e6', 'sigma', 3)}, {r('avg((y - b * x) * (y - b * x)) / any_value(xx) * 1e6', 'p0', 5)} FROM o, a""", "samples"))
def _(spark, sf):
    sigma, p0, _ = models.rolling_fit(src.samples(spark, sf), ["mag_2_uc"], "mag_1_uc", 50, 0.025)
    return spark.createDataFrame([("mag_2_uc", float(sigma[0]) * 1e6, float(p0[0, 0]) * 1e6)], "term string, sigma double, p0 double").select(
        "term", *rounded(3, sigma=F.col("sigma")), *rounded(5, p0=F.col("p0")))


@query("m14_saved_model", "M14", sql=sql(f"SELECT rn, {r('(mag_2_uc - ma) / sa * b', 'y_hat', 5)} FROM samples, (SELECT avg(mag_2_uc) AS ma, stddev_pop(mag_2_uc) AS sa, corr(mag_2_uc, mag_1_uc) * stddev_pop(mag_1_uc) AS b FROM samples)", "samples"))
def _(spark, sf):
    from aerofield.session import scratch
    path = scratch(spark, "model")
    df = src.samples(spark, sf)
    models.save_model(spark, models.linear_fit(df, ["mag_2_uc"], "mag_1_uc", kind_x="standardize"), "demo", path)
    model = models.load_model(spark, "demo", path)
    return models.score(df, model, "mag_1_uc").select("rn", *rounded(5, y_hat=F.col("y_hat")))


@query("t2_best_importance_run", "T2", "M11", sql=sql(_IMPORTANCE + "SELECT idx, feature FROM imp ORDER BY err_std, idx LIMIT 1", "samples"))
def _(spark, sf):
    return stats.best_run(_importance(spark, sf)).select("idx", "feature")


def _solve3(y: str, view: str, name: str, ridge: str = "0.025") -> str:
    """Permanent-term coefficients by Cramer's rule."""
    x = ["perm_x", "perm_y", "perm_z"]
    sums = ", ".join([f"sum({x[i]} * {x[j]}){' + ' + ridge if i == j else ''} AS g{i}{j}" for i in range(3) for j in range(3)]
                     + [f"sum({x[i]} * {y}) AS h{i}" for i in range(3)])
    def det(col):
        m = [[f"h{i}" if j == col else f"g{i}{j}" for j in range(3)] for i in range(3)]
        return (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"
                f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")
    return f"{name} AS (SELECT {', '.join(f'{det(c)} / {det(None)} AS b{c}' for c in range(3))} FROM (SELECT {sums} FROM {view}))"


_NOISE = "(perm_x * b0 + perm_y * b1 + perm_z * b2)"


@query("m4_unfiltered_coefficients", "M4", sql=sql(design_view() + ", " + _solve3("mag_1_uc", "design", "co") + f""" SELECT 'perm_x' AS term, {r('b0', 'value', 4)} FROM co
    UNION ALL SELECT 'perm_y', {r('b1', digits=4)} FROM co UNION ALL SELECT 'perm_z', {r('b2', digits=4)} FROM co
    UNION ALL SELECT 'residual_variance', {r(f'var_pop(mag_1_uc - {_NOISE})', digits=4)} FROM design, co""", "numbered"))
def _(spark, sf):
    coef, var = models.compensation_fit(src.samples(spark, sf), "mag_1_uc", terms=["permanent"], ridge=0.025, pass1=0.0, pass2=0.0)
    return coef_frame(spark, [*comp.term_names(["permanent"]), "residual_variance"], [*coef, var]).select("term", *rounded(4, value=F.col("value")))


@query("a19_compensated_mags", "A19", sql=sql(design_view() + ", " + _solve3("mag_1_uc", "(SELECT * FROM design WHERE flight = 'F0')", "co") + f""",
    c AS (SELECT rn, line, pos, mag_1_uc - ({_NOISE} - avg({_NOISE}) OVER ()) AS comp FROM design, co)
    SELECT rn, {r('comp', 'comp', 5)}, {r('comp - regr_intercept(comp, pos) OVER l - regr_slope(comp, pos) OVER l * pos', 'flat', 5)}
    FROM c WINDOW l AS (PARTITION BY line)""", "numbered"))
def _(spark, sf):
    df = src.samples(spark, sf)
    rows, _ = models.compensate_all(df, df.filter(F.col("flight") == "F0"), ["mag_1_uc", "mag_2_uc"], terms=["permanent"],
                                    ridge=0.025, pass1=0.0, pass2=0.0)
    return rows.select("rn", *rounded(5, comp=F.col("mag_1_uc_comp"), flat=F.col("mag_1_uc_flat")))


@query("a19_mean_offsets", "A19", sql=sql(" UNION ALL ".join(f"SELECT 'mag_{i}_uc' AS mag, {r(f'avg(mag_{i}_uc - mag_1_c)', 'mean_diff', 4)} FROM samples" for i in (1, 2)), "samples"))
def _(spark, sf):
    df = src.samples(spark, sf)
    _, offsets = models.compensate_all(df, df.filter(F.col("flight") == "F0"), ["mag_1_uc", "mag_2_uc"], ridge=0.025)
    return offsets.select("mag", *rounded(4, mean_diff=F.col("mean_diff")))


# Samples of the lines' time ranges, less eight rows at both ends of each contiguous leg.
_LEGS_OF_LINES = """, picked AS (SELECT s.*, s.mag_1_c * 0.5 AS map_val FROM samples s JOIN lines l ON s.flight = l.flight AND s.line = l.line
    AND s.tt BETWEEN l.t_start AND l.t_end),
    islands AS (SELECT *, rn - row_number() OVER (PARTITION BY flight, line ORDER BY rn) AS island FROM picked),
    legs AS (SELECT *, row_number() OVER v - 1 AS leg_pos, count(*) OVER (PARTITION BY flight, line, island) AS leg_n FROM islands
    WINDOW v AS (PARTITION BY flight, line, island ORDER BY rn)),
    numbered AS (SELECT * EXCLUDE (island, leg_pos, leg_n), row_number() OVER (PARTITION BY flight, line ORDER BY rn) - 1 AS pos,
    count(*) OVER (PARTITION BY flight, line) AS n_line FROM legs WHERE leg_n >= 19 AND leg_pos >= 8 AND leg_pos < leg_n - 8)"""


def _end_to_end(kind: str, total: str, banded: bool, y: str, test: str):
    train = "train AS (SELECT *, " + y + " AS y FROM design WHERE line % 2 = 0)"
    fit = (_filtered(_BAND, [*_TERMS, "y"], "train") + ", fit AS (SELECT * FROM z WHERE pos >= 20 AND pos < n_line - 20)"
           if banded else ", fit AS (SELECT * FROM train)")
    text = sql(_LEGS_OF_LINES + design_view(total) + ", " + train + fit + least_squares("fit", _TERMS, "y", 0.025) + f""", {_wide(_TERMS)},
    errs AS (SELECT flight, line, {_predicted(_TERMS)} - ({test}) AS err FROM design AS fit, b WHERE line % 2 = 1)
    SELECT flight, line, count(*) AS n, {r("stddev_pop(err)", "err_std", 4)} FROM errs GROUP BY 1, 2""", "lines")

    @query(f"e1_{kind.lower()}", "J1", "W5", "P14", "W17", "W20", "M1", "M3", "M8", "M10", sql=text)
    def _(spark, sf):
        samples = src.samples(spark, sf).withColumn("map_val", F.col("mag_1_c") * 0.5).select(
            "flight", "line", "rn", "tt", "mag_1_uc", "mag_1_c", "flux_a", "map_val")
        odd = F.col("line") % 2 == 1
        _, scored = models.compensate_lines(samples, src.lines(spark, sf), src.flights(spark, sf), ~odd, odd, kind,
                                            buffer=8, map_val="map_val")
        return scored.groupBy("flight", "line").agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_pop("err"), 4).alias("err_std"))


_end_to_end("TL", "ft", True, "mag_1_uc", "mag_1_uc - mag_1_c")
_end_to_end("mod_TL", "mag_1_uc", True, "mag_1_uc", "mag_1_uc - mag_1_c")
_end_to_end("map_TL", "map_val", False, "mag_1_uc - map_val", "mag_1_uc - map_val")

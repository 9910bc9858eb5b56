"""Linear models.

Every fit is one aggregate over the samples, combined before the shuffle, followed by a
solve on a matrix whose size depends only on the number of features: triangular factors
(``leastsquares``) for least squares, sums of products where refits or penalties need them.
"""
import json
import math
import warnings
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from aerofield.functions import compensation as comp
from aerofield.functions.filters import butterworth
from aerofield.operators import leastsquares, select, stats
from aerofield.operators.filtering import zero_phase
from aerofield.operators.segments import shuffle_key, trim_lines
from aerofield.operators.sequence import LINE, block_rows, number_rows, with_group_stats
from aerofield.session import materialized, small

ONE = "_one"
REALS = T.ArrayType(T.DoubleType())


def _sum_arrays(partial: DataFrame, size: int, keys=(), column: str = "gram") -> DataFrame:
    """Elementwise sums of the arrays (and of ``n`` and ``left_out``) of each key, in one
    shuffle of the partial sums."""
    counts = [F.sum(c).alias(c) for c in ("n", "left_out")]
    summed = partial.groupBy(*keys).agg(*counts, F.array(*[F.sum(F.col(column)[i]) for i in range(size)]).alias(column))
    return summed if keys else summed.filter(F.col("n").isNotNull())


def gram(df: DataFrame, columns: list[str], keys=()) -> DataFrame:
    """Sums of all pairwise products per key, as the packed upper triangle, with
    the column sums first.  Rows with a missing value are left out and counted
    (``left_out``).

    Each task multiplies its Arrow batches as matrices and passes on one small
    partial sum per key, so the shuffle does not grow with the rows.
    """
    upper = np.triu_indices(len(columns))
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("n", T.LongType()), T.StructField("left_out", T.LongType()), T.StructField("gram", REALS)])

    def partials(batches):
        acc = {}

        def emit():
            rows = [(*key, n, lost, np.concatenate([s, g[upper]])) for key, (n, lost, s, g) in acc.items()]
            acc.clear()
            return pd.DataFrame(rows, columns=schema.names)
        for pdf in batches:
            x = pdf[columns].to_numpy(dtype=float)
            whole = ~np.isnan(x).any(axis=1)
            groups = pdf.groupby(list(keys), sort=False, dropna=False).indices if keys else {(): slice(None)}
            for key, rows in groups.items():
                part = x[rows][whole[rows]]
                key = key if isinstance(key, tuple) else (key,)
                n, lost, s, g = acc.get(key, (0, 0, 0.0, 0.0))
                acc[key] = (n + len(part), lost + int((~whole[rows]).sum()), s + part.sum(axis=0), g + part.T @ part)
            if len(acc) > 4096:
                yield emit()
        if acc:
            yield emit()
    return _sum_arrays(df.select(*keys, *[F.col(c).cast("double") for c in columns]).mapInPandas(partials, schema),
                       len(columns) + len(upper[0]), keys)


def unpack_gram(packed, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Column sums and the full symmetric matrix."""
    packed = np.array(packed, dtype=float)
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = packed[size:]
    return packed[:size], full + np.triu(full, 1).T


def products(df: DataFrame, columns: list[str], least: int = 1) -> tuple[int, np.ndarray, np.ndarray]:
    """Complete rows, column sums and products of all rows.  Fewer than ``least`` complete
    rows are an error, rows left out are told."""
    row = gram(df, columns).first()
    n, lost = (row["n"], row["left_out"]) if row else (0, 0)
    if n < least:
        raise ValueError(f"{n} complete rows, but a fit needs {least}")
    if lost:
        warnings.warn(f"{lost} of {n + lost} rows have missing values and are left out", stacklevel=3)
    if not n:
        return 0, np.zeros(len(columns)), np.zeros((len(columns), len(columns)))
    return n, *unpack_gram(row["gram"], len(columns))


def solve(g: np.ndarray, c: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """(G + ridge I) b = c, by pseudo-inverse if singular."""
    g = g + ridge * np.eye(len(g))
    try:
        return np.linalg.solve(g, c)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(g) @ c


def ridge_fit(df: DataFrame, xs: list[str], y: str, ridge: float = 0.0) -> tuple[np.ndarray, float]:
    """Coefficients without intercept, and the variance of the residual."""
    b, var, _ = leastsquares.fit(df, xs, [y], ridge)
    return b[:, 0], float(var[0])


def ridge_by_key(df: DataFrame, xs: list[str], y: str, keys=LINE, ridge: float = 0.0) -> DataFrame:
    """Coefficients (``coef``) per key: one solve per factor, in batches."""
    size = len(xs) + 1

    @F.pandas_udf(REALS)
    def fit(factors: pd.Series) -> pd.Series:
        return pd.Series([leastsquares.solved(np.array(r, float).reshape(-1, size), 1, ridge)[0][:, 0].tolist() for r in factors])
    return leastsquares.factors(df, [*xs, y], keys).select(*keys, "n", fit("r").alias("coef"))


def detrend(df: DataFrame, column: str, kind: str = "line", xs: list[str] = (), ridge: float = 0.0,
            into: str = "detrended", keys=LINE) -> DataFrame:
    """Remove each line's mean, its straight line over positions, or its
    regression (with intercept) on other columns."""
    if kind == "mean":
        got = with_group_stats(df, {"_m": F.avg(column)}, keys)
        return got.withColumn(into, F.col(column) - F.col("_m")).drop("_m")
    if kind == "line" and ridge == 0:
        rows = number_rows(df, keys)
        y, p = F.col(column), F.col("pos").cast("double")
        got = with_group_stats(rows, {"_a": F.regr_intercept(y, p), "_b": F.regr_slope(y, p)}, keys)
        trend = F.col("_a") + F.col("_b") * p
        return got.withColumn(into, y - F.coalesce(trend, y)).drop("_a", "_b")
    rows = number_rows(df, keys).withColumn(ONE, F.lit(1.0))
    if kind == "line":
        rows, xs = rows.withColumn("_x", F.col("pos").cast("double")), ["_x"]
    names = [ONE, *xs]
    got = rows.join(small(ridge_by_key(rows, names, column, keys, ridge).drop("n")), list(keys))
    trend = F.lit(0.0)
    for i, c in enumerate(names):
        trend = trend + F.col("coef")[i] * F.col(c)
    return got.withColumn(into, F.col(column) - trend).drop("coef", ONE, "_x")


@dataclass
class LinearModel:
    """Coefficients on normalized features, with the normalizations."""
    names: list[str]
    coef: list[float]
    x_norm: dict[str, tuple[float, float]]
    y_norm: tuple[float, float] = (0.0, 1.0)
    bias: float = 0.0
    kind: str = "linear"
    config: dict = field(default_factory=dict)

    def predict(self) -> Column:
        scaled = [(F.col(c) - b) / s for c, (b, s) in ((n, self.x_norm[n]) for n in self.names)]
        return (comp.weighted_sum(scaled, self.coef) + self.bias) * self.y_norm[1] + self.y_norm[0]


def normalized_columns(df: DataFrame, xs: list[str], y: str, kind_x: str, kind_y: str, exempt=()):
    """Frame with normalized columns ``_n<i>`` and ``_ny``, and the statistics."""
    if kind_x == kind_y and y not in (*xs, *exempt):  # one pass
        norm = stats.normalization(df, [*xs, y], kind_x, exempt)
        norm_y = norm.pop(y)
    else:
        norm = stats.normalization(df, xs, kind_x, exempt)
        norm_y = stats.normalization(df, [y], kind_y)[y]
    cols = {f"_n{i}": (F.col(c) - norm[c][0]) / norm[c][1] for i, c in enumerate(xs)}
    cols["_ny"] = (F.col(y) - norm_y[0]) / norm_y[1]
    return df.withColumns(cols), [f"_n{i}" for i in range(len(xs))], norm, norm_y


def linear_fit(df: DataFrame, xs: list[str], y: str, trim: int = 0, ridge: float = 0.0,
               kind_x: str = "none", kind_y: str = "none", exempt=(), config=None) -> LinearModel:
    """Ridge fit without intercept on normalized columns, without ``trim`` rows at
    both ends of each line."""
    scaled, names, norm, norm_y = normalized_columns(df, xs, y, kind_x, kind_y, exempt)
    coef, _ = ridge_fit(trim_lines(scaled, trim) if trim else scaled, names, "_ny", ridge)
    return LinearModel(list(xs), coef.tolist(), norm, norm_y, 0.0, "linear", config or {})


def score(df: DataFrame, model: LinearModel, y: str, flip: bool = False) -> DataFrame:
    """Add the prediction ``y_hat`` and the line-centred error ``err``."""
    return stats.line_errors(df.withColumn("y_hat", model.predict()), "y_hat", y, "err", flip)


def error_spread(scored: DataFrame) -> float:
    return scored.agg(F.stddev_pop("err")).first()[0]


def filtered_design(df: DataFrame, xs: list[str], y: str, pass1: float, pass2: float, fs: float,
                    order: int = 4, trim: int = 20) -> DataFrame:
    """Band-passed design and measurement, trimmed at the line ends; unchanged if
    both pass frequencies are out of range."""
    inside = lambda f: 0 < f < fs / 2
    if not (inside(pass1) or inside(pass2)):
        return df.select(*LINE, "rn", "pos", "n_line", *xs, y)
    got = zero_phase(df, [*xs, y], butterworth(pass1, pass2, fs, order), keep=["rn"])
    return trim_lines(got, trim) if trim else got


def compensation_fit(df: DataFrame, scalar: str, vector: str = "flux_a", total: str | None = None,
                     terms=comp.DEFAULT_TERMS, ridge: float = 0.0, pass1: float = 0.1,
                     pass2: float = 0.9, fs: float = 10.0, order: int = 4, trim: int = 20):
    """Coefficients of the aircraft-field model and the fit's error variance."""
    design, xs = select.with_design(number_rows(df), vector, total, terms)
    return ridge_fit(filtered_design(design, xs, scalar, pass1, pass2, fs, order, trim), xs, scalar, ridge)


def pls_coefficients(g: np.ndarray, c: np.ndarray, k: int) -> list[np.ndarray]:
    """Partial least squares with one target on centred data, for 1..k components,
    from the Gram matrix and the cross products alone."""
    k = min(max(k, 1), len(c))
    g, c = g.copy(), c.copy()
    ws, ps, qs, out = [], [], [], []
    for _ in range(k):
        size = np.linalg.norm(c)
        w = c / size if size else c
        tt = w @ g @ w
        p, q = (g @ w / tt, c @ w / tt) if tt else (g @ w, c @ w)
        ws, ps, qs = [*ws, w], [*ps, p], [*qs, q]
        g = g - tt * np.outer(p, p)
        c = c - tt * p * q
        wm, pm = np.array(ws).T, np.array(ps).T
        out.append(wm @ np.linalg.pinv(pm.T @ wm) @ np.array(qs))
    return out


def pls_fit(df: DataFrame, xs: list[str], y: str, k: int, exempt=(), every_k: bool = False):
    """PLS model on standardized data, or the coefficients for every number of
    components."""
    scaled, names, norm, norm_y = normalized_columns(df, xs, y, "standardize", "standardize", exempt)
    _, _, g = products(scaled, [*names, "_ny"])
    sets = pls_coefficients(g[:-1, :-1], g[:-1, -1], k)
    if every_k:
        return sets
    return LinearModel(list(xs), sets[-1].tolist(), norm, norm_y, 0.0, "plsr", {"k": len(sets)})


def descend(g: np.ndarray, c: np.ndarray, n: int, strength: float, l1_ratio: float,
            start: np.ndarray | None = None, most: int = 100_000) -> np.ndarray:
    """Minimum of |y - X b|^2 / 2n + strength (l1_ratio |b|_1 + (1 - l1_ratio) |b|^2 / 2)
    by cyclic coordinate descent, given X'X and X'y.  Not to converge is an error."""
    b = np.zeros(len(c)) if start is None else start.copy()
    rest = c - g @ b
    for _ in range(most):
        change = 0.0
        for j in range(len(b)):
            old = b[j]
            r = (rest[j] + g[j, j] * old) / n
            b[j] = math.copysign(max(abs(r) - strength * l1_ratio, 0.0), r) / max(g[j, j] / n + strength * (1 - l1_ratio), 1e-300)
            if b[j] != old:
                rest = rest - g[:, j] * (b[j] - old)
                change = max(change, abs(b[j] - old))
        if change <= 1e-12 * max(1.0, np.abs(b).max()):
            return b
    raise ArithmeticError(f"elastic net did not converge in {most} rounds")


def elastic_net_fit(df: DataFrame, xs: list[str], y: str, strength: float = 1.0,
                    l1_ratio: float = 0.5, exempt=()) -> LinearModel:
    """Elastic net without intercept on standardized data."""
    scaled, names, norm, norm_y = normalized_columns(df, xs, y, "standardize", "standardize", exempt)
    n, _, g = products(scaled, [*names, "_ny"])
    b = descend(g[:-1, :-1], g[:-1, -1], n, strength, l1_ratio)
    return LinearModel(list(xs), [float(v) for v in b], norm, norm_y, 0.0,
                       "elasticnet", {"strength": strength, "l1_ratio": l1_ratio})


def elastic_net_cv(df: DataFrame, xs: list[str], y: str, l1_ratio: float = 0.5, folds: int = 5,
                   steps: int = 100, exempt=()) -> LinearModel:
    """Elastic net with its strength chosen by cross-validation over contiguous
    folds of the row order.  Strengths run evenly in log from the smallest one
    that zeroes all coefficients down to a thousandth of it.

    One pass gives the Gram matrix of each fold; every fit and every fold's error
    follow from those."""
    scaled, names, norm, norm_y = normalized_columns(df, xs, y, "standardize", "standardize", exempt)
    placed = number_rows(scaled.select("rn", *names, "_ny"), (), "rn", "_at", "_of").withColumn(
        "_fold", F.least(F.floor(F.col("_at") * folds / F.col("_of")), F.lit(folds - 1)).cast("int"))
    size = len(xs) + 1
    rows = gram(placed, [*names, "_ny"], ["_fold"]).collect()
    parts = [(r["n"], *unpack_gram(r["gram"], size)) for r in rows if r["n"]]
    if len(parts) < 2:
        raise ValueError(f"{len(parts)} folds have complete rows, but a validation needs two")
    if any(r["left_out"] for r in rows):
        warnings.warn(f"{sum(r['left_out'] for r in rows)} rows have missing values and are left out", stacklevel=2)
    whole = tuple(sum(p[i] for p in parts) for i in range(3))

    def centred(n, sums, g):
        return g - np.outer(sums, sums) / n

    top = float(np.max(np.abs(whole[2][:-1, -1])) / whole[0] / max(l1_ratio, 1e-3))
    grid = [top * 10 ** (-3 * i / max(steps - 1, 1)) for i in range(steps)]
    errors = np.zeros(steps)
    for part in parts:
        n, sums, g = (w - p for w, p in zip(whole, part))
        c, b = centred(n, sums, g), None
        for i, strength in enumerate(grid):
            b = descend(c[:-1, :-1], c[:-1, -1], n, strength, l1_ratio, b)
            full = np.append(-b, 1.0)
            shift = full @ sums / n  # the intercept
            errors[i] += (full @ part[2] @ full - 2 * shift * (full @ part[1]) + part[0] * shift * shift) / part[0] / len(parts)
    strength = grid[int(errors.argmin())]
    c = centred(*whole)
    b = descend(c[:-1, :-1], c[:-1, -1], whole[0], strength, l1_ratio)
    return LinearModel(list(xs), [float(v) for v in b], norm, norm_y, float(np.append(-b, 1.0) @ whole[1] / whole[0]),
                       "elasticnet", {"strength": float(strength), "l1_ratio": l1_ratio})


def whitening(df: DataFrame, xs: list[str], k: int, exempt=()) -> tuple[np.ndarray, dict]:
    """Projection of standardized features on their first ``k`` principal axes,
    scaled to unit variance, and the normalization.  Axis signs make each axis'
    largest element positive."""
    norm = stats.normalization(df, xs, "standardize", exempt)
    scaled = df.select(*[((F.col(c) - norm[c][0]) / norm[c][1]).alias(f"_n{i}") for i, c in enumerate(xs)])
    n, sums, g = products(scaled, scaled.columns, 0)
    if n < 2:
        return np.eye(len(xs)), norm
    cov = (g - np.outer(sums, sums) / n) / (n - 1)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    axes = axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])
    return axes / np.sqrt(np.maximum(values[order], 1e-9)), norm


def project(df: DataFrame, xs: list[str], axes: np.ndarray, norm: dict, name: str = "pc") -> DataFrame:
    scaled = [(F.col(c) - norm[c][0]) / norm[c][1] for c in xs]
    return df.withColumns({f"{name}_{j}": comp.weighted_sum(scaled, axes[:, j].tolist())
                           for j in range(axes.shape[1])})


# fixed values: target and test target of each model kind, and rows trimmed per line end
KINDS = {
    "TL": {"target": "e", "test": "d", "trim": 20, "total": None, "band": True},
    "mod_TL": {"target": "e", "test": "d", "trim": 20, "total": "mag", "band": True},
    "map_TL": {"target": "c", "test": "c", "trim": 0, "total": "map", "band": False},
    "elasticnet": {"target": None, "test": None, "trim": 0},
    "plsr": {"target": None, "test": None, "trim": 0},
}


def train(df: DataFrame, kind: str, xs: list[str] = (), mag: str = "mag_1_uc", mag_c: str = "mag_1_c",
          vector: str = "flux_a", map_val: str | None = None, target: str = "d", terms=comp.DEFAULT_TERMS,
          ridge: float = 0.025, fs: float = 10.0, pass1: float = 0.1, pass2: float = 0.9, k: int = 5,
          strength: float = 0.1, l1_ratio: float = 0.5, diurnal=False, igrf=False) -> LinearModel:
    """Fit one model kind on the given samples.  The aircraft-field kinds force
    their target; the feature kinds standardize their features."""
    if kind not in KINDS:
        raise ValueError(f"model type {kind!r} not defined")
    rule = KINDS[kind]
    config = {"kind": kind, "mag": mag, "mag_c": mag_c, "vector": vector, "map_val": map_val,
              "target": rule["target"] or target, "test": rule["test"] or target,
              "terms": list(terms), "diurnal": diurnal, "igrf": igrf}
    ready, names = _inputs(df, kind, config, list(xs), config["target"])
    if kind == "elasticnet":
        model = elastic_net_fit(ready, names, "_y", strength, l1_ratio)
    elif kind == "plsr":
        model = pls_fit(ready, names, "_y", k)
    else:
        if rule["band"]:
            ready = filtered_design(ready, names, "_y", pass1, pass2, fs, trim=0)
        model = linear_fit(ready, names, "_y", rule["trim"], ridge, "none", "none")
    model.kind, model.config = kind, {**config, **model.config}
    return model


def score_on(df: DataFrame, model: LinearModel, xs: list[str] = ()) -> DataFrame:
    """Predictions and line-centred errors on other samples, against the test target."""
    ready, _ = _inputs(df, model.kind, model.config, list(xs) or model.names, model.config["test"])
    return score(ready, model, "_y").withColumnRenamed("_y", "y")


def _inputs(df, kind, cfg, xs, target):
    y = select.target(df, target, cfg["mag"], cfg["mag_c"], cfg["map_val"], cfg["diurnal"], cfg["igrf"])
    ready = number_rows(df.withColumn("_y", y))
    if kind in ("elasticnet", "plsr"):
        return ready, xs
    total = {"mag": cfg["mag"], "map": cfg["map_val"], None: None}[KINDS[kind]["total"]]
    return select.with_design(ready, cfg["vector"], total, cfg["terms"])


def train_and_test(samples, lines, flights, train_lines: list, test_lines: list, kind: str, **options):
    """Fit on one set of lines and score another."""
    fit_rows, _ = select.pick_lines(samples, lines, flights, train_lines)
    test_rows, _ = select.pick_lines(samples, lines, flights, test_lines)
    model = train(fit_rows, kind, **options)
    return model, score_on(test_rows, model, options.get("xs", ()))


def compensate_lines(samples: DataFrame, lines: DataFrame, flights: DataFrame, train_on: Column, test_on: Column, kind: str,
                     n_min: int = 3, buffer: int = 0, **options):
    """Compensation from end to end: samples inside the lines' time ranges, less the ends of
    each contiguous leg; a model of one kind fitted on the lines that ``train_on`` selects;
    errors of those that ``test_on`` selects.  The conditions are Columns over ``lines``.

    Picked rows, legs and numbered legs are stored, as each is read several times; samples
    come with the columns that the result is to have."""
    from aerofield.operators.segments import segments
    lines, flights = materialized(lines, "lines"), materialized(flights, "flights")

    def rows(wanted: Column) -> DataFrame:
        picked, _ = select.pick_lines(samples, lines.filter(wanted), flights)
        legs = segments(materialized(picked, "picked"), "all", n_min, buffer).drop("leg")
        return materialized(number_rows(materialized(legs, "legs")), "numbered")
    model = train(rows(train_on), kind, **options)
    return model, score_on(rows(test_on), model, options.get("xs", ()))


def permutation_importance(df: DataFrame, model: LinearModel, y: str, seed: int = 0) -> DataFrame:
    """Error spread after permuting each feature.

    One seeded permutation serves all features: each row meets the features of
    the row that a shuffled order puts in its place, and the model's linearity
    gives every feature's error from that one join.  Feature ``idx`` is 0-based.
    """
    n = df.count()
    size = block_rows(df.sparkSession)
    base = (number_rows(df.withColumn("_e", model.predict() - F.col(y)), (), "rn", "_at", "_of")
            .select(*LINE, "rn", "_at", "_e", *model.names))
    width = 2 ** 60 // (n // size + 1) + 1
    drawn = number_rows(df.select("rn", *model.names).withColumn("_key", shuffle_key(F.col("rn"), seed)),
                        (), "_key", "_at", "_of", width)
    other = drawn.select("_at", *[F.col(c).alias(f"_p{i}") for i, c in enumerate(model.names)])
    joined = base.join(other, "_at")
    shift = lambda i, c: (F.col(f"_p{i}") - F.col(c)) * (model.coef[i] / model.x_norm[c][1] * model.y_norm[1])
    errs = joined.select(*LINE, *[(F.col("_e") + shift(i, c)).alias(f"_e{i}") for i, c in enumerate(model.names)])
    m = range(len(model.names))
    per_line = errs.groupBy(*LINE).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"_e{i}").alias(f"_m{i}") for i in m],
                                       *[F.var_pop(f"_e{i}").alias(f"_v{i}") for i in m])
    total = per_line.agg(*[F.sqrt(F.sum(F.col(f"_v{i}") * F.col("n")) / F.sum("n")).alias(f"s{i}") for i in m])
    return total.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("idx"), F.lit(c).alias("feature"), F.col(f"s{i}").alias("err_std"))
        for i, c in enumerate(model.names)])).alias("s")).select("s.*")


def centred_gram(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, plain and line-centred Gram matrices, from one pass: the lines'
    sums correct their own products."""
    size = len(columns)
    upper = np.triu_indices(size)

    def both(batches):
        for pdf in batches:
            n, plain, centred = 0, np.zeros(len(upper[0])), np.zeros(len(upper[0]))
            lost = int(pdf["left_out"].sum())
            for count, packed in zip(pdf["n"], pdf["gram"]):
                if count:
                    sums, full = unpack_gram(packed, size)
                    n, plain = n + count, plain + full[upper]
                    centred = centred + (full - np.outer(sums, sums) / count)[upper]
            yield pd.DataFrame({"n": [n], "left_out": [lost], "gram": [np.concatenate([plain, centred])]})
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("left_out", T.LongType()), T.StructField("gram", REALS)])
    half = len(upper[0])
    row = _sum_arrays(gram(df, columns, LINE).select("n", "left_out", "gram").mapInPandas(both, schema), 2 * half).first()
    pad = [0.0] * size
    plain, centred = (unpack_gram([*pad, *part], size)[1] for part in (row["gram"][:half], row["gram"][half:]))
    return row["n"], plain, centred


def drop_importance(df: DataFrame, xs: list[str], y: str, ridge: float = 0.0) -> list[tuple[int, str, float]]:
    """Error spread of the refit without each feature: rows and columns of one
    Gram matrix are deleted, so the samples are read once."""
    n, plain, centred = centred_gram(df, [*xs, y])
    out = []
    for i, c in enumerate(xs):
        left = [j for j in range(len(xs)) if j != i]
        b = solve(plain[np.ix_(left, left)], plain[left, -1], ridge)
        full = np.append(-b, 1.0)
        part = [*left, len(xs)]
        out.append((i, c, float(math.sqrt(max(full @ centred[np.ix_(part, part)] @ full / n, 0.0)))))
    return out


def rolling_fit(df: DataFrame, xs: list[str], y: str, windows: int, ridge: float = 0.0):
    """Coefficient spread over sliding windows, and the first covariance.

    Window i leaves out the first i and the last ``windows - 1 - i`` rows, so its
    Gram matrix is the total less a few rows; only those border rows are gathered.
    Rows with a missing value are left out before the windows are laid.
    """
    whole_rows = df.select("rn", *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in (*xs, y)]).dropna(subset=[*xs, y])
    rows = number_rows(whole_rows, (), "rn", "_at", "_of").select("_at", "_of", *xs, y)
    whole = gram(rows, [*xs, y]).first()
    n, size = (whole["n"] if whole else 0), len(xs) + 1
    if not 1 <= windows <= n - size:
        raise ValueError(f"{windows} windows need more than {n} complete rows")
    edge = rows.filter((F.col("_at") < windows - 1) | (F.col("_at") >= n - windows + 1)).orderBy("_at").collect()
    at = {row["_at"]: np.array([row[c] for c in (*xs, y)], dtype=float) for row in edge}
    _, total = unpack_gram(whole["gram"], size)
    outer = lambda p: np.outer(at[p], at[p])
    g = total - sum((outer(p) for p in range(n - windows + 1, n)), np.zeros((size, size)))
    coefs = []
    for i in range(windows):
        coefs.append(solve(g[:-1, :-1], g[:-1, -1], ridge))
        if i < windows - 1:
            g = g + outer(n - windows + 1 + i) - outer(i)
    b = solve(total[:-1, :-1], total[:-1, -1], ridge)
    full = np.append(-b, 1.0)
    var = full @ total @ full / n
    return np.std(np.array(coefs), axis=0), np.linalg.pinv(total[:-1, :-1]) * var, np.array(coefs)


def compensate_all(flight: DataFrame, calibration: DataFrame, mags: list[str], vector: str = "flux_a",
                   given: str = "mag_1_c", terms=comp.DEFAULT_TERMS, ridge: float = 0.0,
                   pass1: float = 0.1, pass2: float = 0.9, fs: float = 10.0):
    """Compensate every scalar magnetometer of a flight with coefficients of a
    calibration flight.  Returns the rows (``<mag>_comp`` and its line-detrended
    ``<mag>_flat``) and each magnetometer's mean offset from the given field.

    The calibration design is filtered and factored once for all magnetometers.
    """
    design, xs = select.with_design(number_rows(calibration), vector, None, terms)
    inside = lambda f: 0 < f < fs / 2
    both = [*xs, *mags]
    if inside(pass1) or inside(pass2):
        ready = trim_lines(zero_phase(design, both, butterworth(pass1, pass2, fs), keep=["rn"]), 20)
    else:
        ready = design
    coefs, _, _ = leastsquares.fit(ready, xs, mags, ridge)
    target, _ = select.with_design(number_rows(flight), vector, None, terms)
    noise = {m: comp.weighted_sum([F.col(x) for x in xs], coefs[:, i].tolist()) for i, m in enumerate(mags)}
    flown = target.withColumns({f"_noise_{m}": c for m, c in noise.items()}).drop(*xs)
    means = flown.agg(*[F.avg(f"_noise_{m}").alias(m) for m in mags]).first()
    done = flown.withColumns({f"{m}_comp": F.col(m) - (F.col(f"_noise_{m}") - means[m]) for m in mags}).drop(
        *[f"_noise_{m}" for m in mags])
    offsets = done.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("mag"), (F.col(f"{m}_comp") - F.col(given)).alias("d")) for m in mags])).alias("s")
        ).select("s.*").groupBy("mag").agg(F.avg("d").alias("mean_diff"))
    # all lines' trends of all magnetometers in one aggregate
    rows, p = number_rows(done), F.col("pos").cast("double")
    trends = {f"_{part}_{m}": fn(F.col(f"{m}_comp"), p) for m in mags
              for part, fn in (("a", F.regr_intercept), ("b", F.regr_slope))}
    flat = with_group_stats(rows, trends)
    level = lambda m: F.coalesce(F.col(f"_a_{m}") + F.col(f"_b_{m}") * p, F.col(f"{m}_comp"))
    return flat.withColumns({f"{m}_flat": F.col(f"{m}_comp") - level(m) for m in mags}).drop(*trends), offsets


def save_model(spark: SparkSession, model: LinearModel, model_id: str, path: str) -> None:
    """Coefficient rows and one JSON configuration row per model.  A model saved before
    under the same id is replaced, others stay."""
    rows = [(model_id, n, i, float(v), float(model.x_norm[n][0]), float(model.x_norm[n][1]))
            for i, (n, v) in enumerate(zip(model.names, model.coef))]
    rest = {k: v for k, v in asdict(model).items() if k not in ("names", "coef", "x_norm")}
    for part, data, schema in (("coef", rows, "model_id string, term string, idx int, value double, bias double, scale double"),
                               ("config", [(model_id, json.dumps(rest))], "model_id string, config string")):
        (spark.createDataFrame(data, schema).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("model_id").parquet(f"{path}/{part}"))


def load_model(spark: SparkSession, model_id: str, path: str) -> LinearModel:
    mine = F.col("model_id") == model_id
    rows = spark.read.parquet(f"{path}/coef").filter(mine).orderBy("idx").collect()
    rest = json.loads(spark.read.parquet(f"{path}/config").filter(mine).first()["config"])
    rest["y_norm"] = tuple(rest["y_norm"])
    return LinearModel(names=[x["term"] for x in rows], coef=[x["value"] for x in rows],
                       x_norm={x["term"]: (x["bias"], x["scale"]) for x in rows}, **rest)

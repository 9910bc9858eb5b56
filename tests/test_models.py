"""Filters, fits and importance against direct NumPy computations."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerofield.functions.filters import butterworth
from aerofield.operators import filtering, leastsquares, models
from aerofield.operators.sequence import BLOCK_CONF


def _filtfilt(f, x):
    """Odd extension, then sample-by-sample passes from the settled state."""
    pad = f.pad
    e = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]])
    still = 3 * f.reach // 2  # rows until a constant has settled
    settle = lambda v: f.recurse(np.concatenate([np.full(still, v[0]), v]))[0][still:]
    return settle(settle(e)[::-1])[::-1][pad:-pad]


@pytest.mark.parametrize("design", [{}, {"pass1": 0.0, "pass2": 0.5}, {"pass1": 0.5, "pass2": 0.0}, {"order": 3}])
def test_zero_phase_matches_recursion(line_frame, design):
    f = butterworth(**design)
    x = np.random.default_rng(0).normal(size=150).cumsum() + 50000
    got = filtering.zero_phase(line_frame({1: {"x": x}, 2: {"x": x[:20]}, 3: {"x": np.full(60, 7.0)}}), ["x"], f).toPandas().sort_values("rn")
    assert np.allclose(got.loc[got["line"] == 1, "x"], _filtfilt(f, x), atol=1e-5)
    assert np.allclose(got.loc[got["line"] == 2, "x"], x[:20]) if f.shortest >= 20 else True
    assert (got.loc[got["line"] == 3, "x"] == 7.0).all()


def test_blocks_of_a_long_line_agree_with_the_whole(line_frame, tiny_blocks):
    f = butterworth(1.0, 4.0, 10.0, 2)  # short memory, so many blocks
    x = np.random.default_rng(1).normal(size=900) + 300
    got = filtering.zero_phase(line_frame({1: {"x": x}}), ["x"], f).toPandas().sort_values("rn")
    assert 900 > 4 * f.reach and np.allclose(got["x"], _filtfilt(f, x), atol=1e-9)
    state = [(0.5, -0.2), (0.1, 0.3)]
    ran = filtering.causal(line_frame({1: {"x": x}}), ["x"], f, state=state).toPandas().sort_values("rn")
    want, closing = f.recurse(x, state)
    assert np.allclose(ran["x"], want, atol=1e-9)
    end = filtering.closing_state(line_frame({1: {"x": x}}), "x", f).first()["state"]
    assert np.allclose(end, np.array(f.recurse(x)[1]).ravel(), atol=1e-9)


@pytest.mark.parametrize("fan", [3, 4096])
def test_a_memory_longer_than_many_blocks(spark, line_frame, tiny_blocks, monkeypatch, fan):
    """An edge of 0.05 Hz at 160 Hz: an impulse lasts far beyond the line of 60 blocks."""
    monkeypatch.setattr(filtering, "FAN", fan)
    f = butterworth(0.05, 5.0, 160.0)
    assert f.reach > 20_000
    x = np.random.default_rng(4).normal(size=950).cumsum() + 50_000
    got = filtering.zero_phase(line_frame({1: {"x": x, "z": x[::-1] + 7}, 2: {"x": x[:40], "z": x[:40]}}), ["x", "z"], f).toPandas().sort_values("rn")
    for c, v in (("x", x), ("z", x[::-1] + 7)):
        assert np.allclose(got.loc[got["line"] == 1, c], _filtfilt(f, v), atol=1e-4)
    ran = filtering.causal(line_frame({1: {"x": x}}), ["x"], f).toPandas().sort_values("rn")
    want, closing = f.recurse(x)
    assert np.allclose(ran["x"], want, atol=1e-6)
    end = filtering.closing_state(line_frame({1: {"x": x}}), "x", f).first()["state"]
    assert np.allclose(end, np.ravel(closing), rtol=1e-7, atol=1e-5)


@pytest.fixture
def some_lines_in_one_block(spark):
    """Blocks of 128 rows and Arrow batches of 50: some lines fit a block, none a batch."""
    spark.conf.set(BLOCK_CONF, "128")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    yield
    spark.conf.unset(BLOCK_CONF)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lines_with_and_without_a_scan(line_frame, some_lines_in_one_block):
    f = butterworth(1.0, 4.0, 10.0, 2)
    rng = np.random.default_rng(8)
    lines = {n: rng.normal(size=size) + 300 for n, size in enumerate([400, 70, 5, 70, 128, 1, 90, 129])}
    lines[3][20], lines[6][:] = np.nan, 7.0
    df = line_frame({n: {"x": x} for n, x in lines.items()})
    got = {n: p.sort_values("rn")["x"].to_numpy() for n, p in filtering.zero_phase(df, ["x"], f).toPandas().groupby("line")}
    state = [(0.5, -0.2), (0.1, 0.3)]
    ran = {n: p.sort_values("rn")["x"].to_numpy() for n, p in filtering.causal(df, ["x"], f, state=state).toPandas().groupby("line")}
    ends = {r["line"]: r["state"] for r in filtering.closing_state(df, "x", f).collect()}
    assert got.keys() == ran.keys() == ends.keys() == lines.keys()
    for n, x in lines.items():
        want, _ = f.recurse(np.nan_to_num(x), state)
        stop = 20 if n == 3 else len(x)
        assert np.allclose(ran[n][:stop], want[:stop], atol=1e-9) and np.isnan(ran[n][stop:]).all()
        assert np.allclose(ends[n], np.ravel(f.recurse(np.nan_to_num(x))[1]), atol=1e-9)
        if n == 3:
            assert np.isnan(got[n]).all()
        else:
            assert np.allclose(got[n], x if len(x) <= f.shortest or n == 6 else _filtfilt(f, x), atol=1e-9)


def test_short_lines_are_filtered_many_at_a_time(spark, monkeypatch):
    """Lines that fit a block store no blocks, and take a task of few steps for all of them."""
    def none(*_):
        raise AssertionError("a line that fits a block was cut")
    monkeypatch.setattr(filtering, "_by_block", none)
    df = spark.range(0, 60_000, 1, 4).select(F.lit("F").alias("flight"), F.floor(F.col("id") / 60).alias("line"), F.col("id").alias("rn"), F.sin("id").alias("x"))
    f = butterworth(1.0, 4.0, 10.0, 2)
    for got in (filtering.zero_phase(df, ["x"], f), filtering.causal(df, ["x"], f)):
        assert got.count() == 60_000
    assert filtering.closing_state(df, "x", f).count() == 1000


def test_gain_of_a_sine(line_frame):
    t = np.arange(2000) / 10
    keep, drop = np.sin(2 * np.pi * 0.4 * t), np.sin(2 * np.pi * 3.0 * t)
    got = filtering.zero_phase(line_frame({1: {"a": keep, "b": drop}}), ["a", "b"]).toPandas().sort_values("rn")
    mid = slice(500, 1500)
    assert np.allclose(got["a"].to_numpy()[mid], keep[mid], atol=0.02)
    assert np.abs(got["b"].to_numpy()[mid]).max() < 1e-4


@pytest.fixture
def planted(line_frame):
    rng = np.random.default_rng(2)
    cols = {n: rng.normal(size=400) for n in ("a", "b", "c")}
    cols["y"] = 2 * cols["a"] - 3 * cols["b"] + 0.5 * cols["c"] + 0.01 * rng.normal(size=400)
    half = lambda s: {k: v[s] for k, v in cols.items()}
    return line_frame({1: half(slice(0, 250)), 2: half(slice(250, 400))}), cols


def test_gram_of_keys_and_batches(spark, planted):
    df, cols = planted
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        x = np.column_stack([cols["a"], cols["y"]])
        sums, g = models.unpack_gram(models.gram(df, ["a", "y"]).first()["gram"], 2)
        assert np.allclose(sums, x.sum(axis=0)) and np.allclose(g, x.T @ x)
        two = {r["line"]: r for r in models.gram(df, ["a", "y"], ("flight", "line")).collect()}
        assert two[2]["n"] == 150 and np.allclose(models.unpack_gram(two[2]["gram"], 2)[1], x[250:].T @ x[250:])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fit_recovers_planted_coefficients(planted):
    df, _ = planted
    b, var = models.ridge_fit(df, ["a", "b", "c"], "y")
    assert np.allclose(b, [2, -3, 0.5], atol=0.01) and var < 2e-4
    per_line = models.ridge_by_key(df, ["a", "b", "c"], "y").collect()
    assert len(per_line) == 2 and all(np.allclose(r["coef"], [2, -3, 0.5], atol=0.02) for r in per_line)
    model = models.linear_fit(df, ["a", "b", "c"], "y", 20, 0.0, "standardize", "standardize")
    assert models.error_spread(models.score(df, model, "y")) < 0.02


def test_singular_design_uses_the_pseudo_inverse(line_frame):
    x = np.arange(1.0, 9.0)
    b, _ = models.ridge_fit(line_frame({1: {"a": x, "b": 2 * x, "y": 5 * x}}), ["a", "b"], "y")
    assert b[0] + 2 * b[1] == pytest.approx(5.0)


def test_least_squares_of_an_offset_collinear_design(spark, line_frame):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 18)) * 10.0 ** rng.integers(-4, 3, 18)
    x[:, 3] += 50_000.0
    x[:, 11] = 3 * x[:, 3]  # two collinear columns
    y = x @ rng.normal(size=18) + 50_000 + rng.normal(size=600)
    names = [f"t{i}" for i in range(18)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        b, var, rank = leastsquares.fit(line_frame({1: dict(zip([*names, "y"], [*x.T, y]))}).repartition(5), names, ["y"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    e = y - x @ b[:, 0]
    assert rank == 17 and var[0] == pytest.approx(e.var())
    assert (np.abs(x.T @ e) <= 1e-9 * np.linalg.norm(x, axis=0) * np.linalg.norm(y)).all()
    assert b[11, 0] == pytest.approx(3 * b[3, 0])  # the least norm shares it out so


def test_rank_of_a_collinear_design_in_many_batches(spark):
    """Rounding must not grow with the number of batches until a dependent column seems free."""
    x = (F.col("id") * 7919 % 20011) * 0.011 + F.col("id") % 5
    df = spark.range(0, 1_000_000, 1, 1).select(F.lit(1.0).alias("a"), x.alias("b"), (1 + 2 * x).alias("c"), (50_000 + 3 * x).alias("y"))
    b, _, rank = leastsquares.fit(df, ["a", "b", "c"], ["y"])
    t = (50_000 + 2 * 3) / 6  # of all (50000 - t, 3 - 2 t, t) the shortest
    assert rank == 2 and np.allclose(b[:, 0], [50_000 - t, 3 - 2 * t, t], rtol=1e-9)


def test_least_squares_of_few_rows_targets_and_keys(line_frame):
    df = line_frame({1: {"a": [1.0, 2.0], "b": [0.0, 1.0], "c": [0.0, 0.0], "y": [2.0, 5.0], "z": [1.0, 1.0]},
                     2: {"a": [1.0, np.nan, 3.0], "b": [1.0, 1.0, 0.0], "c": [2.0, 1.0, 0.0], "y": [3.0, 9.0, 3.0], "z": [0.0] * 3}})
    rows = {r["line"]: r for r in leastsquares.factors(df, ["a", "b", "c", "y", "z"], ("flight", "line")).collect()}
    assert (rows[1]["n"], rows[2]["n"], rows[2]["left_out"]) == (2, 2, 1)
    b, rank = leastsquares.solved(np.array(rows[1]["r"]).reshape(-1, 5), 2)
    assert rank == 2 and np.allclose(b.T, [[2, 1, 0], [1, -1, 0]])
    b, rank = leastsquares.solved(np.array(rows[2]["r"]).reshape(-1, 5), 2)
    assert rank == 2 and np.allclose(b[:, 0], np.linalg.pinv(np.array([[1.0, 1, 2], [3, 0, 0]])) @ [3, 3])
    b, _ = leastsquares.solved(np.array(rows[1]["r"]).reshape(-1, 5), 2, ridge=0.5)
    x = np.array([[1.0, 0, 0], [2, 1, 0]])
    assert np.allclose(b[:, 0], np.linalg.solve(x.T @ x + 0.5 * np.eye(3), x.T @ [2, 5]))
    with pytest.warns(UserWarning):
        leastsquares.fit(df, ["a"], ["y"])
    none, var, rank = leastsquares.fit(df.limit(0), ["a"], ["y"])
    assert rank == 0 and none.tolist() == [[0.0]] and var[0] == 0
    b, _, rank = leastsquares.fit(line_frame({1: {"a": [0.0, 0.0], "y": [1.0, 2.0]}}), ["a"], ["y"])
    assert rank == 0 and b[0, 0] == 0


def test_detrending_values(line_frame):
    run = lambda y, kind, **k: [x["d"] for x in models.detrend(line_frame({1: y}), "y", kind, into="d", **k).orderBy("rn").collect()]
    assert run({"y": [3.0, 6.0, 8.0]}, "line") == pytest.approx([-1 / 6, 2 / 6, -1 / 6])
    assert run({"y": [3.0, 6.0, 8.0]}, "mean") == pytest.approx([-8 / 3, 1 / 3, 7 / 3])
    assert run({"y": [1.0, 1.0], "a": [1.0, 0.1], "b": [0.1, 1.0]}, "columns", xs=["a", "b"]) == pytest.approx([0, 0], abs=1e-9)
    assert run({"y": [3.0, 6.0, 9.0]}, "line") == pytest.approx([0, 0, 0], abs=1e-12)


def _nipals(x, y, k):
    w, p, q = [], [], []
    x, y = x.copy(), y.copy()
    for _ in range(k):
        wi = x.T @ y
        wi /= np.linalg.norm(wi)
        t = x @ wi
        pi, qi = x.T @ t / (t @ t), y @ t / (t @ t)
        x, y = x - np.outer(t, pi), y - t * qi
        w, p, q = [*w, wi], [*p, pi], [*q, qi]
    w, p = np.array(w).T, np.array(p).T
    return w @ np.linalg.inv(p.T @ w) @ np.array(q)


def test_pls_matches_deflation_of_the_samples(planted):
    df, cols = planted
    z = lambda v: (v - v.mean()) / v.std()
    x = np.column_stack([z(cols[c]) for c in "abc"])
    for k, b in enumerate(models.pls_fit(df, ["a", "b", "c"], "y", 5, every_k=True), 1):
        assert np.allclose(b, _nipals(x, z(cols["y"]), k), atol=1e-9)
    assert models.pls_fit(df, ["a", "b", "c"], "y", 9).config["k"] == 3


def _elastic(x, y, strength, ratio):
    b = np.zeros(x.shape[1])
    for _ in range(2000):
        for j in range(len(b)):
            r = y - x @ b + x[:, j] * b[j]
            c = x[:, j] @ r / len(y)
            b[j] = np.sign(c) * max(abs(c) - strength * ratio, 0) / (x[:, j] @ x[:, j] / len(y) + strength * (1 - ratio))
    return b


def test_elastic_net_matches_coordinate_descent(planted):
    df, cols = planted
    z = lambda v: (v - v.mean()) / v.std()
    want = _elastic(np.column_stack([z(cols[c]) for c in "abc"]), z(cols["y"]), 0.2, 0.5)
    assert np.allclose(models.elastic_net_fit(df, ["a", "b", "c"], "y", 0.2, 0.5).coef, want, atol=1e-5)


def test_cross_validated_strength_is_small_for_clean_data(planted):
    df, _ = planted
    model = models.elastic_net_cv(df, ["a", "b", "c"], "y", 0.5, steps=3)
    assert model.config["strength"] < 0.01 and abs(model.bias) < 0.05


def test_whitening(planted):
    df, _ = planted
    axes, norm = models.whitening(df, ["a", "b", "y"], 2)
    p = models.project(df, ["a", "b", "y"], axes, norm).toPandas()[["pc_0", "pc_1"]]
    assert np.allclose(np.cov(p.T), np.eye(2), atol=1e-9)


def test_drop_importance_matches_refits(planted):
    df, cols = planted
    line = np.r_[np.ones(250), np.full(150, 2)]
    for i, c, std in models.drop_importance(df, ["a", "b", "c"], "y", 0.1):
        x = np.column_stack([cols[n] for n in "abc" if n != c])
        e = x @ np.linalg.solve(x.T @ x + 0.1 * np.eye(2), x.T @ cols["y"]) - cols["y"]
        e = e - pd.Series(e).groupby(line).transform("mean").to_numpy()
        assert std == pytest.approx(e.std())


def test_permutation_importance_ranks_features(planted, tiny_blocks):
    df, _ = planted
    model = models.linear_fit(df, ["a", "b", "c"], "y")
    got = {r["feature"]: r["err_std"] for r in models.permutation_importance(df, model, "y").collect()}
    assert got["b"] > got["a"] > got["c"] > 0.3


def test_rolling_fit_matches_windows(planted):
    df, cols = planted
    x, y = np.column_stack([cols["a"], cols["b"]]), cols["y"]
    sigma, p0, coefs = models.rolling_fit(df, ["a", "b"], "y", 12, 0.5)
    n = 400 - 12 + 1
    want = [np.linalg.solve(x[i:i + n].T @ x[i:i + n] + 0.5 * np.eye(2), x[i:i + n].T @ y[i:i + n]) for i in range(12)]
    assert np.allclose(coefs, want) and np.allclose(sigma, np.std(want, axis=0))


def test_saved_models(spark, planted, tmp_path):
    df, _ = planted
    model = models.linear_fit(df, ["a", "b"], "y", kind_x="standardize", config={"terms": ["p"]})
    models.save_model(spark, model, "one", str(tmp_path))
    models.save_model(spark, models.linear_fit(df, ["c"], "y"), "two", str(tmp_path))
    assert models.load_model(spark, "one", str(tmp_path)) == model


def test_a_model_saved_twice_is_replaced(spark, planted, tmp_path):
    df, _ = planted
    one, two = models.linear_fit(df, ["a", "b"], "y"), models.linear_fit(df, ["c"], "y")
    for model, name in ((one, "x"), (two, "y"), (two, "x")):
        models.save_model(spark, model, name, str(tmp_path))
    assert models.load_model(spark, "x", str(tmp_path)) == two == models.load_model(spark, "y", str(tmp_path))


def test_fits_without_complete_rows_are_errors(planted):
    df, _ = planted
    none = df.withColumn("y", F.lit(None).cast("double"))
    for rows in (df.limit(0), none):
        for fit in (lambda d: models.pls_fit(d, ["a"], "y", 1), lambda d: models.elastic_net_fit(d, ["a"], "y"), lambda d: models.elastic_net_cv(d, ["a"], "y")):
            with pytest.raises(ValueError):
                fit(rows)


def test_compensation_kinds(spark, planted):
    df, _ = planted
    rng = np.random.default_rng(3)
    f = df.withColumns({"flux_a": F.struct(F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("z"),
                                           F.sqrt(F.col("a") ** 2 + F.col("b") ** 2 + F.col("c") ** 2).alias("t")),
                        "mag_1_uc": F.col("y") + 100, "mag_1_c": F.lit(100.0), "m": F.lit(90.0)})
    for kind in models.KINDS:
        model = models.train(f, kind, ["a", "b", "c"], map_val="m")
        assert model.kind == kind and models.error_spread(models.score_on(f, model)) < 10
    with pytest.raises(ValueError):
        models.train(f, "m1")


def test_elastic_net_meets_its_conditions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = x @ [2.0, 0.0, -1.0, 0.5, 0.0] + rng.normal(size=200)
    for strength, mix in ((0.1, 0.5), (0.4, 1.0), (0.01, 0.1)):
        b = models.descend(x.T @ x, x.T @ y, 200, strength, mix)
        slope = x.T @ (y - x @ b) / 200 - strength * (1 - mix) * b
        on = b != 0
        assert np.allclose(slope[on], strength * mix * np.sign(b[on]), atol=1e-9)
        assert (np.abs(slope[~on]) <= strength * mix + 1e-9).all()
    with pytest.raises(ArithmeticError):
        models.descend(x.T @ x, x.T @ y, 200, 0.01, 0.5, most=1)

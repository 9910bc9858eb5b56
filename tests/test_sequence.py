"""Numbering, block windows and medians against brute force, with a hot line."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerofield.operators import differences, maps, match, segments, sequence


@pytest.fixture
def skewed(spark):
    """300 rows of one line, mixed with short lines, out of order."""
    rng = np.random.default_rng(3)
    line = rng.choice([1, 2, 3, 4], 420, p=[0.7, 0.2, 0.07, 0.03])
    return pd.DataFrame({"flight": "F", "line": line, "rn": np.arange(420) * 2, "v": rng.normal(size=420).round(3)})


def test_numbering_matches_order(spark, tiny_blocks, skewed):
    got = sequence.number_rows(spark.createDataFrame(skewed.sample(frac=1, random_state=1))).toPandas().sort_values("rn")
    assert (got["pos"].to_numpy() == skewed.groupby("line").cumcount().to_numpy()).all()
    assert (got["n_line"].to_numpy() == skewed.groupby("line")["rn"].transform("size").to_numpy()).all()


def test_global_numbering(spark, tiny_blocks, skewed):
    got = sequence.number_rows(spark.createDataFrame(skewed), (), "rn", "at", "of").toPandas().sort_values("rn")
    assert (got["at"].to_numpy() == np.arange(420)).all() and (got["of"] == 420).all()


def test_no_block_exceeds_its_size(spark, tiny_blocks, skewed):
    rows = sequence.number_rows(spark.createDataFrame(skewed))
    spread, _ = sequence.with_halo(rows, 3, 2)
    sizes = spread.groupBy("flight", "line", "_blk").count().toPandas()
    assert sizes["count"].max() <= tiny_blocks + 5
    assert (spread.filter("_core").count()) == 420


def test_lags_and_rolling_cross_blocks(spark, tiny_blocks, skewed):
    rows = sequence.number_rows(spark.createDataFrame(skewed))
    got = sequence.blockwise(rows, lambda w: {
        "before": F.lag("v", 3).over(w), "after": F.lead("v", 2).over(w),
        "mean": F.avg("v").over(w.rowsBetween(-3, 2))}, 3, 2).toPandas().sort_values("rn").reset_index(drop=True)
    groups = skewed.groupby("line")["v"]
    assert np.allclose(got["before"], groups.shift(3).to_numpy(), equal_nan=True)
    assert np.allclose(got["after"], groups.shift(-2).to_numpy(), equal_nan=True)
    want = pd.concat([pd.Series([g.iloc[max(0, i - 3):i + 3].mean() for i in range(len(g))], index=g.index) for _, g in groups])
    assert np.allclose(got["mean"], want.sort_index())


def test_running_sum(spark, tiny_blocks, skewed):
    got = sequence.running(spark.createDataFrame(skewed), "v", "cum").toPandas().sort_values("rn")
    assert np.allclose(got["cum"], skewed.groupby("line")["v"].cumsum())


@pytest.mark.parametrize("values", [[1.0], [1.0, 4.0], [5.0] * 9, [3.0, 1.0, 2.0], list(np.random.default_rng(0).normal(size=101)),
                                    [1e9, 0.0, 0.0, 1.0], [*np.linspace(1, 2, 30), 1e12], [-5.0, -0.0, 0.0, 3e-300, -1e300, 2.0], [float("inf"), -1.0, 4.0]])
def test_exact_median(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": values}))
    assert sequence.exact_median(df, ["k"], "x").first()["median"] == pytest.approx(np.median(values))


def _unit(x, scheme):
    n, out = len(x), np.zeros(len(x))
    need = {"backward": 2, "forward": 2, "central": 3, "backward2": 4, "forward2": 4, "fourth": 5}.get(scheme, 99)
    if n < need:
        return out
    for i in range(n):
        on = x[i + 1] - x[i] if i + 1 < n else None
        back = x[i] - x[i - 1] if i else None
        if scheme == "backward":
            out[i] = back if i else on
        elif scheme == "forward":
            out[i] = on if on is not None else back
        elif scheme == "central":
            out[i] = on if i == 0 else back if i == n - 1 else (x[i + 1] - x[i - 1]) / 2
        elif scheme == "backward2":
            out[i] = on if i == 0 else back if i == 1 else (3 * x[i] - 4 * x[i - 1] + x[i - 2]) / 2
        elif scheme == "forward2":
            out[i] = back if i >= n - 2 else (-3 * x[i] + 4 * x[i + 1] - x[i + 2]) / 2
        elif 2 <= i < n - 2:
            out[i] = (x[i - 2] - 4 * x[i - 1] + 6 * x[i] - 4 * x[i + 1] + x[i + 2]) / 16
    return out


def test_unit_differences_of_all_lengths(line_frame, tiny_blocks):
    rng = np.random.default_rng(1)
    data = {n: rng.normal(size=n) for n in (1, 2, 3, 4, 5, 6, 33)}
    df = sequence.number_rows(line_frame({n: {"x": v} for n, v in data.items()}))
    schemes = ["backward", "forward", "central", "backward2", "forward2", "fourth", "bogus"]
    got = differences.add_differences(df, ["x"], schemes).toPandas().sort_values("rn")
    for n, x in data.items():
        for s in schemes:
            assert np.allclose(got.loc[got["line"] == n, f"x_{s}"], _unit(x, s)), (n, s)


def test_short_line_derivative_is_an_error(line_frame):
    df = sequence.number_rows(line_frame({1: {"x": [1.0, 2.0]}}))
    with pytest.raises(Exception, match="too short"):
        differences.add_derivatives(df, {"x": F.col("x")}, F.lit(0.1), {"d": "central"}).collect()


def test_lags_keep_own_value_at_the_head(line_frame, tiny_blocks):
    x = np.arange(40.0)
    got = differences.add_lags(sequence.number_rows(line_frame({1: {"x": x}})), ["x"]).toPandas().sort_values("rn")
    for i in (1, 2, 3):
        assert (got[f"x_lag_{i}"].to_numpy() == np.concatenate([x[:i], x[:-i]])).all()


def test_segments_and_buffer(line_frame, spark, tiny_blocks):
    line = [1] * 5 + [2] * 3 + [1] * 9 + [2] * 2
    df = spark.createDataFrame(pd.DataFrame({"flight": "F", "line": line, "rn": range(19)}))
    got = sorted(x["rn"] for x in segments.segments(df, "all", 3, 1).collect())
    assert got == [1, 2, 3, *range(9, 16)]
    assert sorted(x["rn"] for x in segments.select_rows(df, 1, 3, 1, 2, 0).collect()) == [2, 10, 12, 14]
    assert segments.select_rows(df, 2, 4).count() == 0
    with pytest.raises(ValueError):
        segments.segments(df, "some")


def test_chunks_windows_splits(line_frame, tiny_blocks):
    df = line_frame({1: {"x": [1.0, 2.0, 3.0, 4.0]}})
    assert [(x["x"], x["end"]) for x in segments.chunks(df, ["x"], 2).orderBy("chunk").collect()] == [([1, 2], 2), ([3, 4], 4)]
    assert [x["x_window"] for x in segments.sliding_windows(df, ["x"], 3).orderBy("rn").collect()] == [
        [1, 1, 1], [1, 1, 2], [1, 2, 3], [2, 3, 4]]
    fifty = line_frame({1: {"x": np.arange(50.0)}})
    count = lambda f: [x["count"] for x in segments.split_fractions(fifty, f).groupBy("part").count().orderBy("part").collect()]
    assert count((0.5, 0.5)) == [25, 25] and count((0.7, 0.2, 0.1)) == [35, 10, 5]
    with pytest.raises(ValueError):
        segments.split_fractions(fifty, (1, 1, 1))
    with pytest.raises(ValueError):
        segments.split_rows(fifty, 0.5, "contiguous", 60)
    split = segments.split_rows(fifty, 0.3, seed=2).toPandas()
    assert split["in_train"].sum() == 15 and (split["in_train"] != split["in_valid"]).all()
    blocks = segments.split_rows(fifty, 0.5, "contiguous", 7, 1).toPandas().sort_values("rn")
    assert blocks.groupby(blocks["rn"] // 7)["in_train"].nunique().eq(1).all()


def test_downsample_sizes(line_frame):
    df = line_frame({1: {"x": np.arange(960.0)}})
    assert segments.downsample(df, 100).count() == 96 and segments.downsample(df).count() == 960


@pytest.mark.parametrize("width,kind", [(11, "flat"), (8, "hamming"), (5, "hanning"), (2, "flat")])
def test_smoothing_against_convolution(line_frame, tiny_blocks, width, kind):
    x = np.random.default_rng(4).normal(size=50)
    got = segments.smooth(line_frame({1: {"x": x}, 2: {"x": x[:4]}}), "x", width, kind).toPandas().sort_values("rn")
    want = x
    if width >= 3:
        s = np.r_[x[width - 1:0:-1], x, x[-2:-width - 1:-1]]
        w = np.ones(width) if kind == "flat" else getattr(np, kind)(width)
        y = np.convolve(w / w.sum(), s, mode="valid")
        start = (len(y) - len(x)) // 2
        want = y[start:start + len(x)]
    assert np.allclose(got.loc[got["line"] == 1, "smooth"], want)
    if width > 4:
        assert np.allclose(got.loc[got["line"] == 2, "smooth"], x[:4])


def test_adaptive_variance(line_frame, tiny_blocks):
    r = np.random.default_rng(5).normal(size=60) * 3
    got = segments.adaptive_variance(line_frame({1: {"r": r, "h": np.full(60, 0.5)}}), "r", "h", 4.0, 1.0, 20.0).toPandas().sort_values("rn")
    want = [4.0 if t < 10 else float(np.clip((r[t - 10:t] ** 2).mean() - 0.5, 1.0, 20.0)) for t in range(60)]
    assert np.allclose(got["variance"], want)


def test_systematic_resample(line_frame, tiny_blocks):
    one = match.systematic_resample(line_frame({1: {"w": [0.0, 1.0, 0.0]}}), "w", 0.5)
    assert [x["rn"] for x in one.collect()] == [1, 1, 1]
    same = match.systematic_resample(line_frame({1: {"w": [1 / 3] * 3}}), "w", 0.5).orderBy("draw").collect()
    assert [x["rn"] for x in same] == [0, 1, 2]
    w = np.random.default_rng(6).random(100)
    heavy = w.copy()
    heavy[40] = 500.0
    for weights in (w, heavy):
        got = match.systematic_resample(line_frame({1: {"w": weights}}), "w", 0.3, piece=8).orderBy("draw").toPandas()
        cum = np.cumsum(weights / weights.sum())
        cum[-1] = 1.0
        want = np.searchsorted(cum, (np.arange(1, 101) - 0.3) / 100, side="right")
        assert got["rn"].tolist() == np.clip(want, 0, 99).tolist()


def test_what_follows_is_read_without_growing_frames(spark):
    """A frame that ends with its partition takes the square of the rows in it."""
    s = spark.range(2000).select(F.lit("F").alias("flight"), F.col("id").alias("rn"), (F.col("id") * 0.5).alias("tt"))
    t = s.select("flight", (F.col("tt") + 0.3).alias("t"))
    near = match.nearest_in_time(s, t)
    grid = spark.range(40).select(F.lit("m").alias("map_id"), F.lit(0).alias("iz"), (F.col("id") % 8).alias("iy"), F.floor(F.col("id") / 8).alias("ix"))
    edges = maps.edge_distances(grid, {"d": (F.col("iy") == 2) & (F.col("ix") == 1)})
    for df in (near, edges):
        assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()
    got = {r["t"]: r["rn"] for r in near.collect()}
    assert len(got) == 2000 and all(rn == min(round(t / 0.5), 1999) for t, rn in got.items())
    assert all(r["d"] == pytest.approx(((r["iy"] - 2) ** 2 + (r["ix"] - 1) ** 2) ** 0.5) for r in edges.collect())


def test_nearest_in_time_over_empty_blocks(spark):
    s = pd.DataFrame({"flight": "F", "rn": range(6), "tt": [0.0, 1.0, 1.0, 500.0, 9000.0, 9001.0]})
    t = pd.DataFrame({"flight": "F", "t": [-50.0, 0.5, 1.0, 300.0, 4750.0, 5000.0, 99999.0]})
    got = match.nearest_in_time(spark.createDataFrame(s), spark.createDataFrame(t), tick=100.0).orderBy("t").collect()
    assert [x["rn"] for x in got] == [0, 0, 1, 3, 3, 4, 5]


def _fresh(spark, df, columns):
    return spark.createDataFrame(df.select(*columns).collect(), df.select(*columns).schema)


def test_positions_are_renewed_after_rows_are_dropped(spark, line_frame):
    from aerofield.functions.filters import butterworth
    from aerofield.operators import differences, filtering, select
    df = sequence.number_rows(line_frame({1: {"x": np.sin(np.arange(300) / 9.0)}, 2: {"x": np.cos(np.arange(250) / 7.0)}}))
    cols = ["flight", "line", "rn", "x"]
    f = butterworth(0.5, 2.0)
    for kept in (segments.trim_lines(df, 5), select.whole_windows(df, 96), segments.segments(df, "all", 3, 4)):
        assert "pos" not in kept.columns
        pair = [{r["rn"]: r["x"] for r in filtering.zero_phase(d, ["x"], f).collect()} for d in (kept, _fresh(spark, kept, cols))]
        assert pair[0].keys() == pair[1].keys()
        assert all(abs(pair[0][k] - pair[1][k]) < 1e-9 for k in pair[0])


def test_a_missing_value_acts_the_same_at_any_block_size(spark, line_frame):
    from aerofield.functions.filters import butterworth
    from aerofield.operators import filtering
    x = np.sin(np.arange(400) / 5.0)
    x[150] = np.nan
    df = line_frame({1: {"x": x}, 2: {"x": np.sin(np.arange(400) / 3.0)}})
    f, seen = butterworth(0.5, 2.0), []
    for size in ("64", "65536"):
        spark.conf.set(sequence.BLOCK_CONF, size)
        whole = {r["rn"]: r["x"] for r in filtering.zero_phase(df, ["x"], f).collect()}
        first = {r["rn"]: r["x"] for r in filtering.causal(df, ["x"], f).collect()}
        spark.conf.unset(sequence.BLOCK_CONF)
        gone = lambda v: v is None or v != v
        seen.append(({k for k, v in whole.items() if gone(v)}, {k for k, v in first.items() if gone(v)}))
    assert seen[0] == seen[1] == (set(range(400)), set(range(150, 400)))


def test_positions_over_many_groups_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(sequence, "FAN", 3)
    draw = np.random.default_rng(8)
    ids = sorted(draw.choice(5000, 400, replace=False).tolist())
    rows = [(rn, rn % 2, None if rn % 7 == 0 else rn % 5) for rn in ids]
    df = spark.createDataFrame(rows, "rn long, line long, x long")
    for keys in ((), ("line",)):
        want, n, total = {}, {}, {}
        for rn, line, x in rows:
            k = line if keys else 0
            total[k] = total.get(k, 0) + (x or 0)
            want[rn] = (n.get(k, 0), total[k])
            n[k] = n.get(k, 0) + 1
        got = sequence.number_rows(df.fillna(0), keys, size=16).collect()
        assert {r.rn: (r.pos, r.n_line) for r in got} == {rn: (want[rn][0], n[line if keys else 0]) for rn, line, _ in rows}
        spark.conf.set(sequence.BLOCK_CONF, "16")
        try:
            sums = sequence.running(df.fillna(0), "x", "s", keys).collect()
        finally:
            spark.conf.unset(sequence.BLOCK_CONF)
        assert {r.rn: r.s for r in sums} == {rn: w[1] for rn, w in want.items()}

"""Map lookups, filling and spectra against direct computations."""
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aerofield.operators import maps, mapspectra, spectra, wholemaps
from aerofield.operators.sequence import number_rows


def _cells(spark, val, map_id="m", x0=0.0, y0=0.0, dx=1.0, dy=1.0, iz=0, alt=300.0):
    ny, nx = val.shape
    iy, ix = np.divmod(np.arange(ny * nx), nx)
    pdf = pd.DataFrame({"map_id": map_id, "iz": iz, "iy": iy, "ix": ix, "xx": x0 + ix * dx, "yy": y0 + iy * dy,
                        "alt": alt, "val": val.ravel(), "mask": True})
    return spark.createDataFrame(pdf).withColumn("val", F.when(~F.isnan("val"), F.col("val")))


def _points(spark, xy, map_id="m"):
    return spark.createDataFrame([(i, map_id, float(x), float(y), *map(float, z)) for i, (x, y, *z) in enumerate(xy)],
                                 "rn long, map_id string, x double, y double" + (", z double" if len(xy[0]) > 2 else ""))


def test_lookup_reproduces_a_plane(spark):
    y, x = np.mgrid[0:6, 0:9]
    cells = _cells(spark, 2.0 * x - 3.0 * y + 5, dx=0.5, dy=0.25, x0=1.0)
    pts = [(1.0, 0.0), (5.0, 1.25), (2.3, 0.4), (4.99, 1.2), (5.01, 0.1), (2.0, -0.1)]
    got = [r["map_val"] for r in maps.lookup(_points(spark, pts), cells).orderBy("rn").collect()]
    want = [2 * (a - 1) / 0.5 - 3 * b / 0.25 + 5 for a, b in pts[:4]]
    assert got[:4] == pytest.approx(want) and got[4:] == [None, None]
    odd = [r["map_val"] for r in maps.lookup(_points(spark, pts), cells, regular=False).orderBy("rn").collect()]
    assert odd[:4] == pytest.approx(want) and odd[4:] == [None, None]
    s = maps.slope(_points(spark, [(2.3, 0.4)]), cells, 1e-4).first()
    assert (s["slope_x"], s["slope_y"]) == pytest.approx((4.0, -12.0), rel=1e-6)


def test_lookup_next_to_a_gap_is_missing(spark):
    val = np.ones((3, 3))
    val[1, 1] = np.nan
    got = maps.lookup(_points(spark, [(0.5, 0.5)]), _cells(spark, val)).first()
    assert got["map_val"] is None


def test_levels(spark):
    y, x = np.mgrid[0:3, 0:3]
    cells = _cells(spark, x + y + 0.0, alt=100.0).unionByName(_cells(spark, x + y + 10.0, iz=1, alt=200.0))
    got = maps.lookup(_points(spark, [(0.5, 1.0, 150.0), (2.0, 2.0, 200.0), (1.0, 1.0, 250.0)]), cells, levels=True)
    assert [r["map_val"] for r in got.orderBy("rn").collect()] == [6.5, 14.0, None]


def test_nearest_takes_the_lower_index_half_way(spark):
    cells = _cells(spark, np.arange(9.0).reshape(3, 3))
    got = maps.nearest_lookup(_points(spark, [(0.5, 0.0), (0.51, 1.2), (2.0, 2.0), (3.0, 0.0)]), cells)
    assert [r["map_val"] for r in got.orderBy("rn").collect()] == [0.0, 4.0, 8.0, None]


def _brute_fill(val, k, dy, dx):
    out = val.copy()
    ys, xs = np.where(~np.isnan(val))
    for i, j in zip(*np.where(np.isnan(val))):
        order = sorted(zip(((ys - i) * dy) ** 2 + ((xs - j) * dx) ** 2, ys, xs))[:k]
        out[i, j] = np.mean([val[a, b] for _, a, b in order])
    return out


@pytest.mark.parametrize("k,dy,dx,keep", [(3, 1.0, 1.0, 0.7), (1, 1.0, 2.5, 0.3), (3, 0.5, 4.0, 0.02)])
def test_gap_filling(spark, k, dy, dx, keep):
    rng = np.random.default_rng(9)
    val = np.where(rng.random((40, 12)) < keep, rng.integers(1, 100, (40, 12)), np.nan).astype(float)
    got = maps.fill_gaps(_cells(spark, val, dx=dx, dy=dy), k).toPandas().sort_values(["iy", "ix"])
    assert np.allclose(got["val"].to_numpy().reshape(40, 12), _brute_fill(val, k, dy, dx)) and got["mask"].all()


def test_one_far_cell_fills_everything(spark):
    val = np.full((30, 3), np.nan)
    val[29, 2] = 5.0
    got = maps.fill_gaps(_cells(spark, val), 3)
    assert got.filter("val = 5.0").count() == 90


def test_feather_is_between_the_maps(spark):
    a, b = np.full((6, 6), 10.0), np.full((6, 6), 20.0)
    a[:, 4:], b[:, :2] = np.nan, np.nan
    both = _cells(spark, a, "a").unionByName(_cells(spark, b, "b"))
    got = maps.combine(both, "a", "b", "feather", aligned=True).toPandas().pivot(index="iy", columns="ix", values="val").to_numpy()
    assert (got[:, :2] == 10).all() and (got[:, 4:] == 20).all()
    assert np.allclose(got[:, 2], (1.0 * 10 + 0.5 * 20) / 1.5) and np.allclose(got[:, 3], (0.5 * 10 + 1.0 * 20) / 1.5)
    with pytest.raises(ValueError):
        maps.combine(both, "a", "b", "odd")


def test_inconsistent_axes_are_an_error(spark):
    cells = _cells(spark, np.ones((3, 3))).filter("NOT (ix = 1 AND iy = 1)")
    with pytest.raises(Exception, match="inconsistent"):
        maps.gap_counts(cells).collect()


def test_level_order(spark):
    low, high = (_cells(spark, np.ones((2, 2)), alt=a) for a in (100.0, 300.0))
    got = maps.with_levels(low, high, _cells(spark, np.ones((2, 2)), alt=200.0)).select("iz", "alt").distinct()
    assert sorted((r["iz"], r["alt"]) for r in got.collect()) == [(0, 100.0), (1, 200.0), (2, 300.0)]


def test_transform_matches_numpy_and_inverts(spark):
    val = np.random.default_rng(7).normal(size=(6, 10))
    spec = mapspectra.forward(_cells(spark, val))
    got = spec.toPandas().sort_values(["jy", "jx"])
    assert np.allclose((got["re"] + 1j * got["im"]).to_numpy().reshape(6, 10), np.fft.fft2(val))
    k = 2 * np.pi * np.fft.fftfreq(10)
    assert np.allclose(got["kx"].to_numpy().reshape(6, 10)[0], np.where(np.arange(10) == 5, -np.pi, k))
    back = mapspectra.inverse(spec).toPandas().sort_values(["iy", "ix"])
    assert np.allclose(back["val"].to_numpy().reshape(6, 10), val)


def test_continuation_adds_up(spark):
    val = np.random.default_rng(8).normal(size=(8, 8))
    once = mapspectra.continued(_cells(spark, val), [303.0])
    step = mapspectra.continued(mapspectra.continued(_cells(spark, val), [301.0]), [303.0])
    a, b = (d.orderBy("iy", "ix").toPandas()["val"] for d in (once, step))
    assert np.allclose(a, b)
    with pytest.raises(ValueError, match="alpha"):
        mapspectra.continued(_cells(spark, val), [299.0])
    with pytest.raises(ValueError):
        mapspectra.smoothed(_cells(spark, val), "odd")


def test_continued_cells_are_laid_out_after_all_joins(spark):
    """Joins of cells sort them all; joins of grid rows do not."""
    val = np.random.default_rng(5).normal(size=(5, 6)) + 9
    far = _cells(spark, val).withColumns({"ix": F.col("ix") + 40, "iy": F.col("iy") - 3})  # a map that begins elsewhere
    got = mapspectra.continued(far, [301.0], pad=2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Generate explode(_cells") < plan.index("Join")
    want = mapspectra.continued(_cells(spark, val), [301.0], pad=2)
    order = lambda df: df.orderBy("iy", "ix").toPandas()
    assert np.allclose(order(got)["val"], order(want)["val"]) and len(order(got)) == 30
    assert order(got)["ix"].min() == 40 and order(got)["iy"].min() == -3
    assert order(got)[["xx", "yy"]].equals(order(want)[["xx", "yy"]])


def test_spectral_gradient_of_a_wave(spark):
    y, x = np.mgrid[0:16, 0:16]
    val = np.sin(2 * np.pi * x / 16) + 3.0
    got = mapspectra.spectral_gradient(_cells(spark, val)).filter("axis = 'x' AND iy = 3").orderBy("ix").toPandas()
    assert np.allclose(got["grad"], 2 * np.pi / 16 * np.cos(2 * np.pi * np.arange(16) / 16))


def _line(spark, x):
    return number_rows(spark.createDataFrame(pd.DataFrame({"flight": "F", "line": 1, "rn": range(len(x)), "x": x})))


@pytest.mark.parametrize("n", [15, 16, 120, 240, 101, 202])
def test_line_transform_of_any_length(spark, tiny_blocks, n):
    x = np.random.default_rng(n).normal(size=n)
    got = spectra.line_transform(_line(spark, x), "x").toPandas().sort_values("k")
    assert got["k"].tolist() == list(range(n))
    assert np.allclose((got["re"] + 1j * got["im"]).to_numpy(), np.fft.fft(x))


def test_padded_amplitude(spark, tiny_blocks):
    x = np.random.default_rng(1).normal(size=101)
    got = spectra.spectral_amplitude(_line(spark, x), "x", nfft=128).toPandas().sort_values("k")
    assert np.allclose(got["amp"], np.abs(np.fft.fft(x, 128))[:65])
    cut = spectra.spectral_amplitude(_line(spark, x), "x", nfft=64).toPandas().sort_values("k")
    assert np.allclose(cut["amp"], np.abs(np.fft.fft(x, 64))[:33])


@pytest.mark.parametrize("scaling,onesided", [("density", True), ("spectrum", False)])
def test_periodogram(spark, scaling, onesided):
    x = np.random.default_rng(2).normal(size=50) + 9
    got = spectra.periodogram(_line(spark, x), "x", 10.0, "hamming", onesided=onesided, scaling=scaling).toPandas().sort_values("k")
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(50) / 50)
    p = np.abs(np.fft.fft((x - x.mean()) * w)) ** 2
    p /= 10 * (w ** 2).sum() if scaling == "density" else w.sum() ** 2
    if onesided:
        p = np.r_[p[0], 2 * p[1:25], p[25]]
    assert np.allclose(got["power"], p)


def test_welch_of_a_short_line_is_one_segment(spark):
    x = np.random.default_rng(3).normal(size=30)
    a = spectra.welch(_line(spark, x), "x", 10.0, nperseg=64).toPandas().sort_values("k")
    b = spectra.periodogram(_line(spark, x), "x", 10.0).toPandas().sort_values("k")
    assert np.allclose(a["power"], b["power"])


def test_continuation_keeps_the_levels_of_a_deep_map(spark):
    from aerofield.operators import mapspectra
    rng = np.random.default_rng(0)
    rows = [("m", z, y, x, float(x), float(y), 100.0 + 50 * z, float(v)) for z in range(2) for y in range(4)
            for x, v in enumerate(rng.normal(size=4) + 5)]
    cells = spark.createDataFrame(rows, "map_id string, iz long, iy long, ix long, xx double, yy double, alt double, val double")
    got = mapspectra.continued(cells, [50.0, 100.0, 125.0, 200.0], alpha=0.1).collect()
    assert sorted({(r["iz"], r["alt"]) for r in got}) == [(0, 50.0), (1, 100.0), (2, 150.0), (3, 200.0)] and len(got) == 64
    old = {(r[1], r[2], r[3]): r[7] for r in rows}
    assert all(r["val"] == old[r["iz"] - 1, r["iy"], r["ix"]] for r in got if r["iz"] in (1, 2))
    top = mapspectra.continued(cells.filter("iz = 1"), [200.0]).collect()
    want = {(r["iy"], r["ix"]): r["val"] for r in top}
    assert all(abs(r["val"] - want[r["iy"], r["ix"]]) < 1e-9 for r in got if r["iz"] == 3)
    same = mapspectra.continued(cells.filter("iz = 0"), [100.0], alpha=5.0).collect()
    assert all(abs(r["val"] - old[0, r["iy"], r["ix"]]) < 1e-9 for r in same)


def test_edge_distances_are_exact(spark):
    rng = np.random.default_rng(8)
    for share in (0.3, 0.02, 0.0):
        marked = rng.random((17, 23)) < share
        if share == 0.02:
            marked[:] = False
            marked[16, 22] = True  # one far cell
        rows = [("m", 0, y, x, float(marked[y, x])) for y in range(17) for x in range(23)]
        grid = spark.createDataFrame(rows, "map_id string, iz long, iy long, ix long, v double")
        got = maps.edge_distances(grid, {"d": F.col("v") == 1.0, "none": F.lit(False)}).toPandas()
        assert len(got) == 17 * 23 and got["none"].isna().all()
        spots = np.argwhere(marked)
        for _, r in got.iterrows():
            if len(spots):
                assert r["d"] == pytest.approx(np.hypot(*(spots - [r["iy"], r["ix"]]).T).min())
            else:
                assert np.isnan(r["d"])


def test_lookup_beside_a_gap_is_null(spark):
    for gap in (0.0, None, float("nan")):
        cells = spark.createDataFrame([("m", 0, y, x, float(x), float(y), 100.0, gap if (y, x) == (1, 1) else 5.0 + x) for y in range(3) for x in range(4)],
                                      "map_id string, iz long, iy long, ix long, xx double, yy double, alt double, val double")
        points = spark.createDataFrame([("m", 0.5, 0.5), ("m", 2.5, 0.5)], "map_id string, x double, y double")
        got = {r["x"]: r["map_val"] for r in maps.lookup(points, cells).collect()}
        assert got[0.5] is None and got[2.5] == pytest.approx(7.5)


def test_core_field_needs_a_row_for_every_valid_cell(spark):
    cells = spark.createDataFrame([("m", 0, 0, 0, 10.0), ("m", 0, 0, 1, 20.0), ("m", 0, 0, 2, 0.0)], "map_id string, iz long, iy long, ix long, val double")
    field = spark.createDataFrame([("m", 0, 0, 0, 1, 1.0)], "map_id string, iz long, iy long, ix long, date int, f double")
    got = {r["ix"]: r["val"] for r in maps.core_field_change(cells, field, 1).collect()}
    assert got == {0: 9.0, 1: None, 2: 0.0}


def test_padded_continuation_of_a_slope_keeps_its_edges(spark):
    ny, nx = 12, 15
    rows = [("m", 0, y + 2, x + 5, float(x), float(y), 300.0, 100.0 + 3.0 * x) for y in range(ny) for x in range(nx)]
    cells = spark.createDataFrame(rows, "map_id string, iz long, iy long, ix long, xx double, yy double, alt double, val double")
    grid = mapspectra.padded(cells, 4).toPandas()
    assert len(grid) == (ny + 8) * (nx + 8) and grid["ix"].min() == 1 and grid["iy"].max() == ny + 5
    row = grid[grid["iy"] == 3].sort_values("ix")["val"].to_numpy()
    ring = 142.0 - 42.0 * np.arange(1, 9) / 9
    assert np.allclose(row, [*ring[4:], *(100 + 3.0 * np.arange(nx)), *ring[:4]])
    far = lambda pad: mapspectra.continued(cells, [301.0], pad=pad).toPandas().sort_values(["iy", "ix"])
    whole, cut = far(8), far(0)
    want = 100.0 + 3.0 * whole["xx"].to_numpy()
    assert len(whole) == ny * nx and set(whole["ix"]) == set(range(5, 5 + nx))
    edge = (whole["xx"] <= 2).to_numpy()
    assert np.abs(whole["val"] - want)[edge].mean() < 0.5 * np.abs(cut["val"] - want)[edge].mean()


def test_cells_of_continued_maps_meet_once_and_packed(spark):
    """Collecting, joining and sorting cells one by one fills an executor."""
    got = mapspectra.continued(_cells(spark, np.ones((5, 6))), [301.0], pad=2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan and plan.count("RepartitionByExpression") == 1
    lists = {"iy": range(300), "ix": range(300), "xx": np.arange(300.0), "yy": np.arange(300.0), "_v": np.arange(300.0), "_live": [True] * 300, "mask": [None] * 300}
    batch = pa.RecordBatch.from_pydict({"map_id": ["a"] * 290 + ["b"] * 10, "alt": [3.0] * 100 + [2.0] * 200} | {c: list(x) for c, x in lists.items()})
    pieces = next(wholemaps._packed(iter([batch])))
    assert [len(x) for x in pieces.column("ix")] == [128, 128, 34, 10]
    assert pieces.column("map_id").to_pylist() == ["a", "a", "a", "b"] and pieces.column("alt").to_pylist() == [2.0, 2.0, 2.0, 2.0]


def _odd_maps(spark):
    rng = np.random.default_rng(3)
    grid = lambda name, ny, nx, **k: _cells(spark, rng.normal(size=(ny, nx)) + 4, name, **k)
    gaps = grid("gaps", 5, 4).withColumn("val", F.when(F.col("ix") == 1, F.lit(None)).when(F.col("iy") == 2, F.lit(float("nan"))).otherwise(F.col("val")))
    masked = grid("masked", 4, 6, x0=3.0, dx=0.5).withColumn("mask", F.when(F.col("ix") == 2, F.lit(None)).otherwise(F.col("iy") != 1))
    far = grid("far", 3, 5).withColumns({"ix": F.col("ix") + 40, "iy": F.col("iy") - 3})
    uneven = grid("uneven", 4, 4).withColumn("xx", F.col("xx") * F.col("xx"))
    holes = grid("holes", 5, 5).filter("NOT (ix = 1 AND iy = 1) AND iy <> 3")
    out = gaps
    for more in (masked, far, uneven, holes, twice := grid("twice", 4, 3), twice, grid("row", 1, 6), grid("cell", 1, 1), grid(None, 2, 2)):
        out = out.unionByName(more)
    return out.repartition(3)


@pytest.mark.parametrize("pad", [0, 3])
def test_whole_maps_give_what_passes_give(spark, monkeypatch, pad):
    cells = _odd_maps(spark).persist()
    steps = cells.select("map_id").distinct().withColumns({"dx": F.lit(2.0), "dy": F.lit(0.5)})
    order = lambda df: df.toPandas().sort_values(["map_id", "iz", "iy", "ix", "val"], ignore_index=True)
    for kind in (None, steps):
        run = lambda: mapspectra.continued(cells, [301.0, 299.5, 301.0], 0.1, kind, pad=pad)
        whole = run()
        assert "collect_list" not in whole._jdf.queryExecution().optimizedPlan().toString()
        got = order(whole)
        with monkeypatch.context() as patch:
            patch.setattr(wholemaps, "WHOLE", 0)
            passes = run()
            assert passes.schema.simpleString() == whole.schema.simpleString()
            want = order(passes)
        assert got.drop(columns="val").equals(want.drop(columns="val"))
        assert np.allclose(got["val"], want["val"], equal_nan=True) and got["val"].isna().sum() == want["val"].isna().sum()
    cells.unpersist()


def test_many_whole_maps(spark):
    """More than an Arrow batch and a block of maps hold."""
    val = np.random.default_rng(9).normal(size=(2100, 8, 8)) + 3
    m, iy, ix = (x.ravel() for x in np.mgrid[0:2100, 0:8, 0:8])
    pdf = pd.DataFrame({"map_id": m, "iz": 0, "iy": iy, "ix": ix, "xx": ix * 1.0, "yy": iy * 1.0, "alt": 300.0, "val": val.ravel()})
    got = mapspectra.continued(spark.createDataFrame(pdf), [301.0]).toPandas().sort_values(["map_id", "iy", "ix"])
    kx = 2 * np.pi * np.fft.fftfreq(8)
    k = np.hypot(kx[:, None], kx[None, :])
    want = np.fft.ifft2(np.fft.fft2(val) * np.exp(-k)).real
    assert np.allclose(got["val"].to_numpy().reshape(2100, 8, 8), want) and (got["alt"] == 301.0).all() and (got["iz"] == 0).all()


def test_whole_maps_whose_cells_alternate(spark):
    """Each piece holds one cell, and a map's pieces are more than are taken at a time."""
    val = np.random.default_rng(6).normal(size=(40, 40, 2)) + 3
    iy, ix, m = (x.ravel() for x in np.mgrid[0:40, 0:40, 0:2])
    pdf = pd.DataFrame({"map_id": m, "iz": 0, "iy": iy, "ix": ix, "xx": ix * 1.0, "yy": iy * 1.0, "alt": 300.0, "val": val.ravel()})
    got = mapspectra.continued(spark.createDataFrame(pdf).coalesce(1), [302.0]).toPandas().sort_values(["iy", "ix", "map_id"])
    kx = 2 * np.pi * np.fft.fftfreq(40)
    k = np.hypot(kx[:, None], kx[None, :])[..., None]
    want = np.fft.ifft2(np.fft.fft2(val, axes=(0, 1)) * np.exp(-2 * k), axes=(0, 1)).real
    assert np.allclose(got["val"].to_numpy().reshape(40, 40, 2), want)


def test_deep_and_flat_maps_and_missing_coordinates_together(spark):
    val = np.random.default_rng(4).normal(size=(4, 4)) + 5
    flat, low, high = _cells(spark, val, "flat"), _cells(spark, val, "deep"), _cells(spark, val + 1, "deep", iz=1, alt=400.0)
    lost = _cells(spark, val, "lost").withColumn("xx", F.when(F.col("ix") > 0, F.col("xx")))
    got = mapspectra.continued(flat.unionByName(low).unionByName(high).unionByName(lost), [500.0], pad=1).toPandas()
    assert got.groupby(["map_id", "iz"]).size().to_dict() == {("deep", 0): 16, ("deep", 1): 16, ("deep", 2): 16, ("flat", 0): 16, ("lost", 0): 16}
    alone = mapspectra.continued(flat, [500.0], pad=1).toPandas()
    order = lambda df: df.sort_values(["iy", "ix"])["val"].to_numpy()
    assert np.allclose(order(got[got["map_id"] == "flat"]), order(alone))
    with pytest.raises(ValueError, match="alpha"):
        mapspectra.continued(flat.unionByName(low), [299.0])

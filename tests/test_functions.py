"""Literal values and algebraic properties of row expressions."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerofield.functions import attitude, compensation as comp, geodesy
from aerofield.functions.filters import butterworth
from aerofield.operators import evaluate, maps, select, stats
from aerofield.sources import ingest

LAT = math.radians(39.16066735024198)


def _one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_geodesy_values(spark):
    lat = F.lit(LAT)
    row = _one(spark, a=geodesy.north_to_lat(F.lit(1.0), lat), b=geodesy.east_to_lon(F.lit(1.0), lat),
               c=geodesy.north_to_lat(F.lit(200.0), lat), d=geodesy.east_to_lon(F.lit(0.5), lat),
               e=geodesy.lat_to_north(geodesy.north_to_lat(F.lit(7.0), lat), lat),
               f=geodesy.lon_to_east(geodesy.east_to_lon(F.lit(7.0), lat), lat))
    want = [1.565761736512648e-07, 2.019352321699552e-07, 3.131523473025297e-05, 1.009676160849776e-07, 7.0, 7.0]
    assert list(row) == pytest.approx(want, rel=1e-9)


def test_years(spark):
    y = lambda a, b: geodesy.decimal_year(F.lit(a), F.lit(b))
    row = _one(spark, a=y(2020, 1), b=y(2020, 366), c=y(2100, 0), d=geodesy.days_in_year(F.lit(1900)), e=geodesy.days_in_year(F.lit(2000)))
    assert list(row) == pytest.approx([2020.0, 2020 + 365 / 366, 2100.0, 365, 366])
    with pytest.raises(Exception, match="out of range"):
        _one(spark, a=y(2021, 366))


def test_utm(spark):
    row = _one(spark, a=geodesy.utm_zone(F.lit(-75.7)), b=geodesy.utm_zone(F.lit(179.9)), c=geodesy.is_north(F.lit(0.0)))
    assert list(row) == [18, 60, True]


@pytest.mark.parametrize("order", ["body2nav", "xyz", "zyx"])
def test_angles_round_trip(spark, order):
    angles = {"roll": math.radians(45), "pitch": math.radians(60), "yaw": math.radians(15)}
    names = ["yaw", "pitch", "roll"] if order == "zyx" else ["roll", "pitch", "yaw"]
    dcm = attitude.from_euler(*[F.lit(angles[n]) for n in names], order)
    m = np.array(_one(spark, m=dcm)["m"]).reshape(3, 3)
    assert np.allclose(m @ m.T, np.eye(3))
    if order != "xyz":
        row = _one(spark, **attitude.to_euler(dcm, order))
        assert row.asDict() == pytest.approx(angles) and list(row.asDict()) == names
        back = _one(spark, **attitude.to_euler(F.array(*attitude.transpose(attitude.elements(dcm))), "nav2body"))
        assert back.asDict() == pytest.approx(angles)


def test_gimbal_lock(spark):
    dcm = attitude.from_euler(F.lit(0.3), F.lit(math.pi / 2), F.lit(0.0), "body2nav")
    row = _one(spark, **attitude.to_euler(dcm))
    assert row["roll"] == 0.0 and row["pitch"] == pytest.approx(math.pi / 2)


def test_tilt_is_a_rotation_only_on_request(spark):
    dcm = attitude.from_euler(F.lit(0.1), F.lit(0.2), F.lit(0.3), "body2nav")
    t = [F.lit(v) for v in (0.2, -0.1, 0.3)]
    row = _one(spark, a=attitude.tilt_corrected(dcm, *t), b=attitude.tilt_corrected(dcm, *t, True),
               c=attitude.tilt_corrected(dcm, *[F.lit(0.0)] * 3), d=dcm)
    a, b, c, d = (np.array(x).reshape(3, 3) for x in row)
    assert np.allclose(c, d) and np.allclose(b @ b.T, np.eye(3)) and not np.allclose(a @ a.T, np.eye(3))
    s = np.array([[0, -0.3, -0.1], [0.3, 0, -0.2], [0.1, 0.2, 0]])
    m = math.sqrt(0.14)
    assert np.allclose(a, (np.eye(3) - math.sin(m) / m * s - (1 - math.cos(m)) / m ** 2 * s @ s) @ d)


def test_feature_block_size():
    assert len(attitude.ANGLE_PRODUCTS) == 20


def test_term_layout():
    assert len(comp.term_names()) == 18
    assert len(comp.term_names(["p", "i6", "i5", "i3", "e9", "e8", "e3", "fdm", "b"])) == 41
    r = lambda t, terms: list(comp.term_range(t, terms))
    assert r("e9", ["p", "i6", "e9"]) == list(range(9, 18)) and r("i5", ["e8", "i5", "p"]) == list(range(3, 8))
    assert r("eddy3", ["p", "i3", "e3"]) == [6, 7, 8] and r("b", ["p"]) == []
    with pytest.raises(ValueError):
        comp.term_names(["what"])


@pytest.mark.parametrize("terms", [["p", "i6", "e9"], ["p", "i5", "e8"], ["p", "i3", "e3"]])
def test_coefficient_matrices_round_trip(terms):
    coef = [float(i + 1) for i in range(len(comp.term_names(terms)))]
    m = comp.coefficient_matrices(coef, terms)
    i = np.array(m["induced"]).reshape(3, 3)
    assert np.allclose(i, i.T) and m["permanent"] == [1.0, 2.0, 3.0]
    assert comp.coefficient_vector(*m.values(), terms) == pytest.approx(coef)
    for bad in (["i6"], ["p"], ["p", "i6", "b"]):
        with pytest.raises(ValueError):
            comp.coefficient_matrices(coef, bad)


def test_zero_total_is_guarded(spark):
    z = {a: F.lit(0.0) for a in "xyz"}
    row = _one(spark, **comp.design_columns(z, z, F.lit(0.0)))
    assert all(v == 0.0 for v in row)


def test_butterworth_known_values():
    low = butterworth(0, 2.5, 10.0, 2)
    assert low.rows[0] == pytest.approx((0.29289322, 0.58578644, 0.29289322, 1.0, 0.0, 0.17157288), abs=1e-8)
    assert len(butterworth().rows) == 4 and butterworth().pad == 27 and low.pad == 9
    with pytest.raises(ValueError):
        butterworth(0.9, 0.1)
    with pytest.raises(ValueError):
        butterworth(0, 0)


def test_targets_and_errors(spark):
    df = spark.createDataFrame([(10.0, 7.0, 1.0, 2.0, 3.0)], "mag_1_uc double, mag_1_c double, diurnal double, igrf double, m double")
    val = lambda k: df.select(select.target(df, k, map_val="m", diurnal=True, igrf=True)).first()[0]
    assert [val(k) for k in "abcde"] == [4.0, 3.0, 4.0, 3.0, 7.0]
    with pytest.raises(ValueError):
        select.target(df, "z")
    with pytest.raises(ValueError):
        select.target(df, "c")


def test_norm_parts():
    assert select.unpack_norms((1, 2, 3, 4))["A_scale"] == 1.0
    assert select.unpack_norms((9, 8, 1, 2, 3, 4))["A_bias"] == 9
    with pytest.raises(ValueError):
        select.unpack_norms((1, 2, 3))


def test_line_lookup_errors(spark):
    s = spark.createDataFrame([("F", 1, 5.0)], "flight string, line int, tt double")
    lines = spark.createDataFrame([("F", 1, 0.0, 9.0), ("G", 2, 0.0, 9.0)], "flight string, line int, t_start double, t_end double")
    flights = spark.createDataFrame([("F", 1), ("G", 2)], "flight string, xyz_set int")
    hit, lengths = select.pick_lines(s, lines.filter("line = 1"), flights, [1, 77])
    assert hit.count() == 1 and lengths.first()["n"] == 1
    with pytest.raises(ValueError, match="incompatible"):
        select.pick_lines(s, lines, flights)
    with pytest.raises(ValueError, match="duplicate"):
        select.pick_lines(s, lines.unionByName(lines), flights)
    with pytest.raises(ValueError, match="duplicate"):
        select.pick_lines(s, lines, flights, [1, 1])


def test_features_reject_missing_values(spark):
    df = spark.createDataFrame([("F", 1, 0, 1.0, None)], "flight string, line int, rn int, a double, b double")
    with pytest.raises(ValueError, match="not found"):
        select.select_features(df, ["zzz"])
    with pytest.raises(ValueError, match="missing"):
        select.select_features(df, ["a", "b"])
    _, names, exempt = select.select_features(df, ["ab", "a"], ["a"], {"ab": ["a", "a"]})
    assert names == ["ab_0", "ab_1", "a"] and exempt == [False, False, True]
    with pytest.raises(ValueError):
        select.stack_features([(df, ["a"], [True]), (df, ["b"], [True])])


def test_event_filter(spark):
    ev = spark.createDataFrame([("test", 49.5, "Test event"), ("other", 49.5, "x")], "flight string, tt double, event string")
    assert select.filter_events(ev, "test", "TEST", (49.5, 50)).count() == 1
    assert select.filter_events(ev, "test", "none").count() == 0
    with pytest.raises(ValueError):
        select.filter_events(ev, "test", limits=(1,))


def test_statistics_edges(spark):
    empty = spark.createDataFrame([], "a double")
    assert stats.column_stats(empty, ["a"]).count() == 0
    nan = spark.createDataFrame([(float("nan"),), (None,)], "a double")
    assert stats.column_stats(nan, ["a"]).first()["mean"] is None
    norm = stats.normalization(spark.createDataFrame([(3.0,), (3.0,)], "a double"), ["a"])
    assert norm["a"] == (3.0, 1.0)
    with pytest.raises(ValueError):
        stats.normalization(empty, ["a"], "odd")
    with pytest.raises(ValueError):
        stats.correlation_matrix(empty, ["a"])


def test_text_ingest(spark, tmp_path):
    f = tmp_path / "flight.xyz"
    f.write_text("tt  line  mag\n 0.2 1003.02 5.5\n0.1\t1003.02 *\n 0.15 50713 oops\n")
    rows = ingest.read_flight_text(spark, str(f))
    assert rows.columns == ["tt", "line", "mag"]
    assert [tuple(x) for x in rows.orderBy("tt").collect()] == [(0.1, 1003.02, None), (0.15, 50713.0, None), (0.2, 1003.02, 5.5)]
    ranges = spark.createDataFrame([(1003.02, 0.0, 0.1)], "line double, t0 double, t1 double")
    assert ingest.filter_ranges(rows, ranges).count() == 2
    assert ingest.filter_ranges(rows, ranges, "include").count() == 1
    assert ingest.filter_ranges(rows, ranges, "odd").count() == 3
    out = str(tmp_path / "out")
    assert ingest.ingest(spark, str(f), out, "Flt1", ranges, "exclude")
    stored = spark.read.parquet(f"{out}/samples").orderBy("rn").collect()
    assert [(x["rn"], x["tt"]) for x in stored] == [(0, 0.15), (1, 0.2)]
    meta = spark.read.parquet(f"{out}/flight_meta").first()
    assert (meta["n"], meta["dt"]) == (2, 0.05)


def test_exclude_keeps_null_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None), (1.0, 1.0)], "line double, tt double")
    ranges = spark.createDataFrame([(1.0, 0.0, 2.0)], "line double, t0 double, t1 double")
    assert ingest.filter_ranges(df, ranges).count() == 2


def test_field_operations(spark):
    df = spark.createDataFrame([(1, 2.0)], "rn int, a double")
    assert ingest.field_operation(df, "rename", "a", "b").columns == ["rn", "b"]
    assert ingest.field_operation(df, "clear", "a").first()["a"] is None
    for action, name in (("delete", "zz"), ("write", "a"), ("odd", "a")):
        with pytest.raises(ValueError):
            ingest.field_operation(df, action, name, F.lit(1.0))


def test_filter_states(spark):
    row = _one(spark, **evaluate.deviations(F.array(*[F.lit(4.0)] * 17), F.lit(17)))
    assert row["lat_std"] == 2.0 and row["fogm_std"] == 0.0


def test_extended_axis(spark):
    axis = spark.createDataFrame([("m", float(v)) for v in (-1, 0, 1)], "map_id string, xx double")
    lim = spark.createDataFrame([("m", -2.0, 2.0)], "map_id string, lo double, hi double")
    got = maps.extended_axis(axis, "xx", lim, True).orderBy("i").collect()
    assert [x["xx"] for x in got] == [-3, -2, -1, 0, 1, 2, 3] and [x["i"] for x in got if x["original"]] == [2, 3, 4]
    plain = maps.extended_axis(axis, "xx", lim).orderBy("i").collect()
    assert [x["xx"] for x in plain] == [-2, -1, 0, 1, 2]


def test_time_places_with_a_stuck_clock(spark):
    rows = [("F", i, 5.0 if i % 2 else None) for i in range(40)] + [("F", 40, 1.0), ("G", 41, 2.0)]
    got = ingest.time_places(spark.createDataFrame(rows, "flight string, rn long, tt double")).toPandas().set_index("rn")["pos"]
    want = [40, *range(1, 40, 2), *range(0, 40, 2)]
    assert got[want].tolist() == list(range(41)) and got[41] == 0


def test_saved_flight_tables_and_paths(spark, tmp_path):
    df = spark.createDataFrame([("F", i, LAT, LAT, 300.0) for i in range(3)], "flight string, rn long, lat double, lon double, alt double")
    name = f"flt_{abs(hash(str(tmp_path)))}"
    ingest.save_flight(df, name)
    ingest.save_flight(df.limit(1), name)
    assert spark.table(name).count() == 3
    ingest.save_flight(df.limit(1), name, overwrite=True)
    assert spark.table(name).count() == 1
    spark.sql(f"DROP TABLE {name}")
    ingest.write_path(df, str(tmp_path / "path"))
    text = spark.read.json(str(tmp_path / "path"))
    assert text.count() == 3 and text.first()["geometry"]["coordinates"][2] == 300.0
    with pytest.raises(ValueError):
        ingest.export_path(df, units="km")
    assert not ingest.write_samples(df.limit(0), str(tmp_path / "none"))

"""Stream results equal batch results, over several files and micro-batches."""
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerofield.operators import segments
from aerofield.sources import ingest
from aerofield.streaming import live


@pytest.fixture
def source(spark, tmp_path):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"flight": rng.choice(["A", "B"], 90), "line": 1, "rn": np.arange(90), "tt": np.arange(90.0),
                        "resid": rng.normal(size=90), "hph": 0.1})
    path = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame(pdf[i * 30:(i + 1) * 30]).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    return pdf, stream


def _timed(stream):
    return live.closable(stream.withColumn("ts", live.event_time(F.col("tt"))))


def test_state_survives_batches(spark, source):
    pdf, stream = source
    rows, end = _timed(stream)
    got = live.run_available(live.steps_and_variance(rows, 0.5, 4.0, 0.2, 1.1, delay="5 seconds"), end=end).toPandas().sort_values("rn")
    steps = pdf.groupby("flight")["tt"].diff().fillna(0.5)
    assert np.allclose(got["step"], steps)
    batch = segments.adaptive_variance(spark.createDataFrame(pdf.assign(line=pdf["flight"])), "resid", "hph", 4.0, 0.2, 1.1)
    assert np.allclose(got["variance"], batch.toPandas().sort_values("rn")["variance"])


def _files(spark, path, parts, schema):
    """Files that are read in turn."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/p{i}")
        for root, _, files in os.walk(f"{path}/p{i}"):
            for f in files:
                os.utime(os.path.join(root, f), (1000 + i, 1000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_rows_out_of_order_and_late_rows(spark, tmp_path):
    row = lambda t: ("A", int(10 * t), t, t / 10, 0.0)
    times = [[0.0, 2.0, 5.0, 4.0], [3.0, 1.0, 9.0], [30.0], [31.0], [6.0, 33.0], [32.0]]  # 6.0 comes when 20.0 has passed
    stream = _files(spark, tmp_path / "in", [[row(t) for t in part] for part in times], "flight string, rn long, tt double, resid double, hph double")
    rows, end = _timed(stream)
    told = {}
    got = live.run_available(live.steps_and_variance(rows, 0.5, 4.0, 0.0, 100.0, 2, "10 seconds"), end=end, told=told).toPandas().sort_values("rn")
    kept = sorted(t for part in times for t in part if t != 6.0)
    assert got["rn"].tolist() == [int(10 * t) for t in kept] and told["late"] == 1
    assert got["step"].tolist() == pytest.approx([0.5, *np.diff(kept)]) and (got["step"] >= 0).all()
    squares = [(t / 10) ** 2 for t in kept]
    assert got["variance"].tolist() == pytest.approx([4.0, 4.0, *[(a + b) / 2 for a, b in zip(squares, squares[1:-1])]])


def test_row_windows_run_across_batches(spark, tmp_path):
    row = lambda n: ("A", n % 2, n, n / 1.0, n / 1.0)
    parts = [[row(n) for n in (0, 1, 4, 3)], [row(2)], [row(n) for n in range(5, 40)], [row(n) for n in range(40, 44)]]
    rows, end = _timed(_files(spark, tmp_path / "in", parts, "flight string, line int, rn long, tt double, x double"))
    got = live.run_available(live.row_windows(rows, "x", 4, "10 seconds"), end=end)
    found = {r["rn"]: (r["pos"], r["values"]) for r in got.collect()}
    assert len(found) == 44
    for n, (pos, values) in found.items():
        own = [float(max(n - 2 * k, n % 2)) for k in range(3, -1, -1)]
        assert pos == n // 2 and values == own


def test_text_stream_equals_batch(spark, tmp_path):
    header = ["tt", "line", "mag"]
    for i in range(3):
        (tmp_path / f"f{i}.xyz").write_text("tt line mag\n" + "".join(f"{0.05 * k:.2f} {i} {k if k % 3 else '*'}\n" for k in range(20)))
    ranges = spark.createDataFrame([(1.0, 0.0, 0.5)], "line double, t0 double, t1 double")
    rows = live.stream_text(spark, str(tmp_path / "*.xyz"), header, 1)
    got = live.run_available(live.live_ingest(rows, ranges, decimated=True))
    batch = spark.read.text(str(tmp_path / "*.xyz")).select(F.split(F.trim("value"), r"\s+").alias("v")).filter("v[0] <> 'tt'")
    want = ingest.filter_ranges(ingest.decimate(ingest.parse_flight_text(batch, header)), ranges)
    key = lambda d: sorted((r["line"], r["tt"], r["mag"] or -1.0) for r in d.collect())
    assert key(got) == key(want) and len(key(got)) == 24


def test_windows_drop_late_rows(spark, tmp_path):
    path = str(tmp_path / "in")
    for i, tt in enumerate([[0.0, 10.0, 3000.0], [9000.0], [9005.0], [20.0, 9010.0], [20000.0]]):
        spark.createDataFrame([("A", 1, t, 1.0) for t in tt], "flight string, line int, tt double, e double").coalesce(1).write.parquet(f"{path}/p{i}")
    for i in range(5):
        for root, _, files in os.walk(f"{path}/p{i}"):
            for f in files:
                if f.endswith(".parquet"):
                    os.utime(os.path.join(root, f), (1000 + i, 1000 + i))
    schema = "flight string, line int, tt double, e double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    got = live.run_available(live.windowed_errors(stream.withColumn("ts", live.event_time(F.col("tt"))), "e", "1 hour"))
    rows = {(r["window"]["start"].hour, r["n"]) for r in got.collect()}
    # the first hour closed before its late third row came
    assert rows == {(0, 3), (2, 3)}


def test_an_ended_stream_closes_its_windows(spark, source):
    pdf, stream = source
    rows, end = live.closable(stream.withColumns({"ts": live.event_time(F.col("tt") * 60), "e": F.col("resid")}))
    got = live.run_available(live.windowed_errors(rows, "e", "10 minutes"), end=end)
    assert got.agg(F.sum("n")).first()[0] == len(pdf) and got.filter("flight IS NULL").count() == 0


def test_rows_of_a_micro_batch_wait_in_one_entry():
    from types import SimpleNamespace

    entries = []
    keeper = live.StepAndVariance(0.1, 1.0, 0.0, 1e9, 10, None)
    keeper.waiting = SimpleNamespace(appendValue=entries.append, appendList=entries.extend)
    keeper.handle = SimpleNamespace(registerTimer=lambda ms: None)
    pdf = pd.DataFrame({"ms": [7, 5], "tt": [0.7, 0.5], "rn": [2 ** 62 + 1, 1], "resid": [float("nan"), -1.5], "hph": [0.25, 0.0]})
    assert list(keeper.handleInputRows(("F",), iter([pdf]), None)) == [] and len(entries) == 1
    pd.testing.assert_frame_equal(keeper.unpacked(entries[0][0]), pdf)

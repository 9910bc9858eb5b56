"""Time ranges met bucket by bucket, against a row by range comparison."""
import math

import numpy as np
from pyspark.sql import functions as F

from aerofield.operators import intervals
from aerofield.sources import ingest


def brute(rows, ranges, keep):
    def inside(line, t):
        return line is not None and t is not None and any(
            x == line and a is not None and b is not None and a <= t <= b for x, a, b in ranges)
    return sorted(rn for rn, line, t in rows if inside(line, t) == keep)


def test_ranges_are_merged(spark):
    rows = [(1, 5.0, 6.0), (1, 0.0, 2.0), (1, 2.0, 3.0), (1, 0.5, 1.0), (1, 9.0, 8.0), (2, 1.0, 1.0), (2, None, 4.0), (2, 3.0, None)]
    got = intervals.disjoint(spark.createDataFrame(rows, "line int, t0 double, t1 double"), ["line"], "t0", "t1")
    assert sorted(map(tuple, got.collect())) == [(1, 0.0, 3.0), (1, 5.0, 6.0), (2, 1.0, 1.0)]


def test_rows_in_ranges(spark):
    draw = np.random.default_rng(5)
    start = draw.uniform(0, 100, 60)
    ranges = [(int(i), float(a), float(a + w)) for i, a, w in zip(draw.integers(0, 4, 60), start, draw.exponential(0.7, 60))]
    ranges += [(0, 20.0, 20.0), (1, 90.0, math.inf), (2, -math.inf, 3.0), (3, None, 50.0), (3, 8.0, 7.0), (9, -math.inf, math.inf), (None, 0.0, 100.0)]
    rows = [(i, int(l), float(t)) for i, (l, t) in enumerate(zip(draw.integers(0, 6, 900), draw.uniform(-5, 110, 900)))]
    edges = [t for _, *ab in ranges for t in ab if t is not None and math.isfinite(t)]
    rows += [(1000 + i, l, t) for i, (l, t) in enumerate((l, t) for t in edges for l in (0, 1, 2, 3))]
    rows += [(5000, None, 5.0), (5001, 1, None), (5002, 9, 1e300), (5003, 0, 20.0)]
    df = spark.createDataFrame(rows, "rn long, line int, tt double")
    dim = spark.createDataFrame(ranges, "line int, t0 double, t1 double")
    for keep in (True, False):
        got = intervals.in_ranges(df, dim, ["line"], "tt", "t0", "t1", keep)
        assert got.columns == df.columns
        assert sorted(r.rn for r in got.collect()) == brute(rows, ranges, keep)
    none = dim.limit(0)
    assert ingest.filter_ranges(df, none).count() == len(rows)
    assert ingest.filter_ranges(df, none, "include").count() == 0


def test_many_ranges_on_one_line(spark):
    n = 100_000
    ranges = spark.range(n).select((F.col("id") % 1 + 7).alias("line"), (F.col("id") * 1.0).alias("t0"), (F.col("id") + 0.25).alias("t1"))
    df = spark.range(0, 4 * n, 1).select(F.col("id").alias("rn"), (F.col("id") % 1 + 7).alias("line"), (F.col("id") / 4 + 0.125).alias("tt"))
    got = ingest.filter_ranges(df, ranges, "include")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "_bucket" in plan
    assert got.agg(F.count("*"), F.min("rn"), F.max(F.col("rn") % 4)).first() == (n, 0, 0)

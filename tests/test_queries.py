"""The driver contract, and a cross-section of queries against DuckDB."""
import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from verify import canon

SF = "/root/testdata/sf0.001"
SAMPLE = ["s4_exclude_line_ranges", "p14_design_scalar_total", "j1_line_lengths", "j3_map_values", "w5_segments",
          "w1_unit_differences", "w9_detrended", "m1_gram_per_line", "w17_band_passed_mag", "f6_vector_components",
          "j13_systematic_resample", "a17_weighted_moments", "r5_tumbling_errors"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    got = contract.entry(spark)
    assert got.columns == ["flight", "line", "n", "err_std"] and got.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, tables, name):
    df = contract.queries()[name](spark, SF)
    cur = tables.execute(contract.oracle_sql()[name])
    assert canon(df.columns, df.collect()) == canon([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", ["m8_model_kinds", "e1_tl", "e1_mod_tl"])
def test_compensation_reads_stored_rows_last(spark, name):
    assert not [f for f in contract.queries()[name](spark, SF).inputFiles() if "events.parquet" in f]

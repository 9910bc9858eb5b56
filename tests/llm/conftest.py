import glob
import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with columns whose names the
    operators use for themselves."""
    def make(rows):
        rows = [(*r, *(None,) * (4 - len(r))) for r in rows]
        full = [(a, b, c, d, None if b is None else len(b), "x", 1, 2.0) for a, b, c, d in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, fp string, u long, size double")
    return make


@pytest.fixture(scope="session")
def tables(spark):
    if not os.path.isdir(SF):
        pytest.skip("driver tables absent")
    return {os.path.basename(f)[:-8]: spark.read.parquet(f) for f in glob.glob(f"{SF}/*.parquet")}

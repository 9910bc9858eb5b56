import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from aerofield.operators.sequence import BLOCK_CONF  # noqa: E402
from aerofield.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    yield session
    session.stop()


@pytest.fixture
def tiny_blocks(spark):
    """Blocks of 16 rows, so that short lines are split over many of them."""
    spark.conf.set(BLOCK_CONF, "16")
    yield 16
    spark.conf.unset(BLOCK_CONF)


@pytest.fixture
def line_frame(spark):
    """Samples of given lines from dictionaries of columns."""
    def make(lines: dict, flight: str = "F"):
        parts, rn = [], 0
        for line, cols in lines.items():
            n = len(next(iter(cols.values())))
            parts.append(pd.DataFrame({"flight": flight, "line": line, "rn": range(rn, rn + n), **cols}))
            rn += n
        return spark.createDataFrame(pd.concat(parts, ignore_index=True))
    return make

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagelode.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "-XX:TieredStopAtLevel=1")


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate Columns over inline rows: one(rows, schema, column) -> list of values."""

    def run(rows, schema, column):
        df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
        return [r[0] for r in df.coalesce(1).select(column).collect()]

    return run

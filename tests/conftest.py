import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from daygauge.session import build_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[4]", shuffle_partitions=4, spark__ui__showConsoleProgress="false",
                            spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture
def frame(spark):
    """Pandas frame to DataFrame with dates as dates and NaN as NULL."""
    import datetime

    def make(pdf, schema=None):
        rows = [tuple(None if (isinstance(v, float) and v != v) else v.item() if hasattr(v, "item") else v for v in r)
                for r in pdf.itertuples(index=False)]
        rows = [tuple(v.date() if isinstance(v, datetime.datetime) and c == "date" else v for c, v in zip(pdf.columns, r)) for r in rows]
        return spark.createDataFrame(rows, schema or list(pdf.columns))

    return make

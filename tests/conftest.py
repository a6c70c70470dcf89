import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lacuna.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def series(spark):
    """Build a cell panel from lists: one location and variable per keyword."""
    import datetime as dt

    def build(start="2020-01-01", variable="v", **named):
        day0 = dt.date.fromisoformat(start)
        rows = [
            (loc, day0 + dt.timedelta(days=i), variable, None if x is None else float(x))
            for loc, xs in named.items()
            for i, x in enumerate(xs)
        ]
        return spark.createDataFrame(rows, "location string, obs_date date, variable string, value double")

    return build


@pytest.fixture(scope="session")
def column():
    def read(df, name="filled", **where):
        for k, v in where.items():
            df = df.filter(df[k] == v)
        return [r[name] for r in df.orderBy("obs_date").select(name).collect()]

    return read

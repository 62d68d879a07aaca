import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from netsluice.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def flows(spark):
    """A factory of raw flow tables: a valid row, repeated, with columns replaced by row number."""
    from netsluice import schema

    def make(rows=1, types=None, **replaced):
        types = {"Flow Duration": "double", "Label": "string"} | (types or {})
        base = {f: 1 for f in schema.RAW_FIELDS} | {"Destination Port": 80, "Label": "BENIGN"}
        data = []
        for i in range(rows):
            row = dict(base)
            row["Flow Duration"] = 1000.0 + i
            for name, value in replaced.items():
                row[name] = value(i) if callable(value) else value
            data.append(tuple(row[f] for f in schema.RAW_FIELDS))
        ddl = ", ".join(f"`{f}` {types.get(f, 'bigint')}" for f in schema.RAW_FIELDS)
        return spark.createDataFrame(data, ddl)

    return make

"""The typed staging relation of network logs and its column tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsluice.quality.column_tests import ColumnTest, column_test_results

STAGING_COLUMNS = {
    "id": "bigint",
    "event_name": "string",
    "event_time": "timestamp",
    "source_ip": "string",
    "destination_ip": "string",
    "destination_port": "int",
    "is_attack": "int",
}

STAGING_TESTS = [
    ColumnTest("id", "unique"),
    *[ColumnTest(c, "not_null") for c in STAGING_COLUMNS],
    ColumnTest("is_attack", "accepted_values", (0, 1)),
]


def stage_network_logs(df: DataFrame, view: str | None = None) -> DataFrame:
    """Log columns cast to their staging types; text that does not fit becomes null.

    With ``view`` the relation is also registered for SQL.
    """
    out = df.select([F.col(c).try_cast(t).alias(c) for c, t in STAGING_COLUMNS.items()])
    if view:
        out.createOrReplaceTempView(view)
    return out


def staging_test_results(df: DataFrame) -> DataFrame:
    return column_test_results(df, STAGING_TESTS)

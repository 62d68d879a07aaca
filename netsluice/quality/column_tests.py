"""Declarative column tests: each names what it checks and returns the offending rows' count."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnTest:
    column: str
    kind: str  # unique, not_null or accepted_values
    values: tuple = ()


def column_test_results(df: DataFrame, tests: Sequence[ColumnTest]) -> DataFrame:
    """Rows (column, test, failures, passed).

    ``unique`` counts values that occur more than once; the others count rows, all of them in one
    pass. A null passes ``unique`` and ``accepted_values``.
    """
    aggs, cells = [], []
    for i, t in enumerate(tests):
        c = F.col(f"`{t.column}`")
        if t.kind == "not_null":
            bad = c.isNull()
        elif t.kind == "accepted_values":
            bad = c.isNotNull() & ~c.isin(*t.values)
        elif t.kind == "unique":
            continue
        else:
            raise ValueError(f"unknown column test: {t.kind}")
        aggs.append(F.count(F.when(bad, 1)).alias(f"t{i}"))
        cells.append(
            F.struct(F.lit(t.column).alias("column"), F.lit(t.kind).alias("test"), F.col(f"t{i}").alias("failures"))
        )
    parts = [df.agg(*aggs).select(F.inline(F.array(*cells)))] if aggs else []
    for t in tests:
        if t.kind == "unique":
            repeated = (
                df.where(F.col(f"`{t.column}`").isNotNull())
                .groupBy(f"`{t.column}`")
                .agg(F.count(F.lit(1)).alias("_n"))
                .where("_n > 1")
            )
            parts.append(
                repeated.agg(F.count(F.lit(1)).alias("failures")).select(
                    F.lit(t.column).alias("column"), F.lit("unique").alias("test"), "failures"
                )
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("passed", F.col("failures") == 0)

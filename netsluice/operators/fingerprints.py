"""Which columns are equal, found in one pass over all columns instead of one comparison per pair.

Every column gets a fingerprint: order-free sums of a hash of (digest of the row, value). Columns that are equal on
every row have equal fingerprints, whatever the order of rows. Columns with equal ones are then compared, each with
the first of its class, so that a collision can only cost a further look, never a wrong answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsluice.functions.keys import quoted, row_digest
from netsluice.functions.numbers import is_missing
from netsluice.operators.profile import columns_equal, numeric_columns

_SUM_BITS = 20  #: of a hash, summed: a long holds the sum of 8 * 10**12 rows


def _comparable(df: DataFrame, name: str, numeric: set[str]) -> Column:
    """Equal values give equal ones: numbers are compared as doubles, 0.0 and -0.0 are one."""
    c = quoted(name)
    if name not in numeric:
        return c
    return F.when(c == 0, F.lit(0.0)).otherwise(c.cast("double"))


def column_fingerprints(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, kind, missing, x, s): whether a value is missing somewhere, and two order-free sums of hashes.

    One scan, one aggregate of two numbers and a flag per column. ``kind`` parts columns that are never compared:
    all numbers are one kind, other types are a kind each.
    """
    columns = list(columns or df.columns)
    types, numeric = dict(df.dtypes), set(numeric_columns(df))
    rows = df.select(row_digest(df).alias("_digest"), *[quoted(c) for c in columns])
    aggs, cells = [], []
    for i, name in enumerate(columns):
        h = F.xxhash64("_digest", _comparable(df, name, numeric))
        aggs.append(F.bool_or(is_missing(quoted(name), types[name])).alias(f"m{i}"))
        aggs.append(F.bit_xor(h).alias(f"x{i}"))
        aggs.append(F.sum(F.xxhash64(h).bitwiseAND(F.lit((1 << _SUM_BITS) - 1))).alias(f"s{i}"))
        kind = "number" if name in numeric else types[name]
        cells.append(
            F.struct(
                F.lit(i).alias("place"), F.lit(name).alias("column"), F.lit(kind).alias("kind"),
                F.coalesce(F.col(f"m{i}"), F.lit(False)).alias("missing"), F.col(f"x{i}").alias("x"), F.col(f"s{i}").alias("s"),
            )
        )
    return rows.agg(*aggs).select(F.inline(F.array(*cells)))


def equal_column_classes(df: DataFrame, columns: Sequence[str] | None = None) -> list[list[str]]:
    """Classes of two or more columns that hold the same value in every row, each in column order.

    Null and NaN equal nothing, so a column with a missing value is in no class; without rows all columns of a
    kind are one class. The fingerprints take one scan; a second one compares, where classes are left, each
    column with the first of its class; columns that only collided are looked at again among themselves.
    """
    classes: dict[tuple, list[str]] = {}
    for r in column_fingerprints(df, columns).orderBy("place").collect():  # a row per column of the schema
        if not r.missing:
            classes.setdefault((r.kind, r.x, r.s), []).append(r.column)
    open_, out = [c for c in classes.values() if len(c) > 1], []
    while open_:
        pairs = [(c[0], other) for c in open_ for other in c[1:]]
        same = {(r.left, r.right) for r in columns_equal(df, pairs).collect() if r.identical}  # a row per column at most
        rest = []
        for c in open_:
            equal = [c[0], *[other for other in c[1:] if (c[0], other) in same]]
            if len(equal) > 1:
                out.append(equal)
            rest.append([other for other in c[1:] if (c[0], other) not in same])
        open_ = [c for c in rest if len(c) > 1]
    return out


def redundant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(left, right): every pair of columns that hold the same value in every row, in column order."""
    place = {c: i for i, c in enumerate(columns or df.columns)}
    pairs = [(a, b) for c in equal_column_classes(df, columns) for i, a in enumerate(c) for b in c[i + 1 :]]
    pairs.sort(key=lambda p: (place[p[0]], place[p[1]]))
    return df.sparkSession.createDataFrame(pairs, "left string, right string")

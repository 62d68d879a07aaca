"""Column profiles: each is one scan with partial aggregation unless it says otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsluice.functions.keys import quoted, row_digest
from netsluice.functions.numbers import is_missing
from netsluice.functions.text import trimmed
from netsluice.operators.quantiles import exact_quantiles

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in _NUMERIC or t.startswith("decimal")]


def _per_column(df: DataFrame, columns: Sequence[str], measures, by: Sequence[str] = ()) -> DataFrame:
    """Aggregate every column in one pass, then turn the one wide row into a row per column."""
    types = dict(df.dtypes)
    aggs, cells = [], []
    for i, name in enumerate(columns):
        named = measures(quoted(name), types[name])
        aggs += [m.alias(f"m{i}_{k}") for k, m in named.items()]
        cells.append(
            F.struct(F.lit(name).alias("column"), *[F.col(f"m{i}_{k}").alias(k) for k in named])
        )
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*cells)))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def column_info(df: DataFrame) -> DataFrame:
    """Type and number of present values per column."""
    def present(c: Column, t: str) -> dict[str, Column]:
        return {"non_null": F.count(F.when(~is_missing(c, t), 1))}

    types = F.create_map(*[F.lit(v) for n, t in df.dtypes for v in (n, t)])
    return _per_column(df, df.columns, present).select(
        "column", F.element_at(types, F.col("column")).alias("type"), "non_null"
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with nulls or NaN and how many, most first."""
    def nulls(c: Column, t: str) -> dict[str, Column]:
        return {"nulls": F.count(F.when(is_missing(c, t), 1))}

    return (
        _per_column(df, columns or df.columns, nulls)
        .where(F.col("nulls") > 0)
        .orderBy(F.desc("nulls"), "column")
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max, a row per numeric column."""
    columns = list(columns or numeric_columns(df))

    def moments(c: Column, t: str) -> dict[str, Column]:
        x = F.when(~is_missing(c, t), c.cast("double"))
        return {"count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}

    quartiles = (
        exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        .groupBy("column")
        .pivot("prob", [0.25, 0.5, 0.75])
        .agg(F.first("value"))
        .toDF("column", "p25", "p50", "p75")
    )
    return (
        _per_column(df, columns, moments)
        .join(F.broadcast(quartiles), "column", "left")  # one row per column of the schema
        .select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")
    )


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with exactly one distinct present value: smallest equals largest."""
    def edges(c: Column, t: str) -> dict[str, Column]:
        x = F.when(~is_missing(c, t), c)
        return {"constant": (F.min(x) == F.max(x)) & (F.count(x) > 0)}

    return _per_column(df, columns or df.columns, edges).where("constant").select("column")


def distinct_estimates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Approximate number of distinct present values per column, one sketch each."""
    def sketch(c: Column, t: str) -> dict[str, Column]:
        return {"distinct": F.approx_count_distinct(F.when(~is_missing(c, t), c))}

    return _per_column(df, columns or df.columns, sketch)


def columns_equal(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Whether both columns hold the same value in every row; null and NaN never do."""
    types = dict(df.dtypes)
    aggs, cells = [], []
    for i, (a, b) in enumerate(pairs):
        known = ~is_missing(quoted(a), types[a]) & ~is_missing(quoted(b), types[b])
        same = F.coalesce(known & (quoted(a) == quoted(b)), F.lit(False))
        aggs.append(F.bool_and(same).alias(f"s{i}"))
        cells.append(
            F.struct(
                F.lit(a).alias("left"), F.lit(b).alias("right"), F.coalesce(F.col(f"s{i}"), F.lit(True)).alias("identical")
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def duplicate_rows(
    df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), by_digest: bool = True
) -> DataFrame:
    """Rows, repeats after the first copy, and the repeats' share in percent.

    Copies are counted map-side, so a row that makes up a third of the table costs one entry per
    task. ``by_digest`` shuffles 32 bytes per distinct row instead of the row; without it the
    columns themselves are grouped.
    """
    columns = list(columns or df.columns)
    keys = [row_digest(df, columns).alias("_digest")] if by_digest else [quoted(c) for c in columns if c not in by]
    copies = df.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("_copies"))
    rows, kinds = F.coalesce(F.sum("_copies"), F.lit(0)), F.count(F.lit(1))
    repeats = rows - kinds
    return copies.groupBy(*by).agg(
        rows.alias("rows"),
        repeats.alias("duplicates"),
        F.when(rows > 0, 100.0 * repeats / rows).alias("percent"),
    )


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and percent (3 decimals) per trimmed label, most first."""
    everything = Window.partitionBy()
    counts = df.groupBy(trimmed(F.col(label).cast("string")).alias(label)).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn(
        "percent", F.round(100.0 * F.col("rows") / F.sum("rows").over(everything), 3)
    ).orderBy(F.desc("rows"), label)


def class_split(df: DataFrame, target: str = "is_attack") -> DataFrame:
    """Rows and percent (2 decimals) per class, classes in order."""
    everything = Window.partitionBy()
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn(
        "percent", F.round(100.0 * F.col("rows") / F.sum("rows").over(everything), 2)
    ).orderBy(target)


def distinct_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label).isNotNull()).select(trimmed(F.col(label)).alias(label)).distinct()

"""Leak-free model features and the binary target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsluice import schema
from netsluice.functions.numbers import finite_sql, sql_name


def drop_identifiers(df: DataFrame) -> DataFrame:
    """Remove identifier and target columns, and prove that none is left."""
    out = df.drop(*[c for c in schema.NEVER_FEATURES if c in df.columns])
    left = set(out.columns) & set(schema.NEVER_FEATURES)
    if left:
        raise ValueError(f"identifier columns among the features: {sorted(left)}")
    return out


def feature_columns(df: DataFrame, names: Sequence[str] = tuple(schema.FEATURES)) -> list[Column]:
    """The named features in order as finite doubles; absent columns are 0.0."""
    present = set(drop_identifiers(df).columns)
    return [
        F.expr(f"{finite_sql(sql_name(c)) if c in present else '0.0D'} as {sql_name(c)}") for c in names
    ]


def extract_features(
    df: DataFrame, names: Sequence[str] = tuple(schema.FEATURES), keep: Sequence[str] = ()
) -> DataFrame:
    """Feature table; ``keep`` carries row keys along that are not features."""
    return df.select(*keep, *feature_columns(df, names))


def binary_target(df: DataFrame) -> Column:
    """``is_attack`` as 0/1; null or absent is 0."""
    if "is_attack" not in df.columns:
        return F.lit(0).alias("is_attack")
    return F.coalesce(F.col("is_attack").cast("int"), F.lit(0)).alias("is_attack")


def prepared_dataset(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Features, target, and ``label`` as a companion column for sample weights."""
    label = [F.col("label")] if "label" in df.columns and "label" not in keep else []
    return df.select(*keep, *feature_columns(df), binary_target(df), *label)

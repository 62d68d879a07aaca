"""Row digests and reproducible hash orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsluice.functions.numbers import sql_name


def quoted(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col(f"`{name}`")


def hash_order(keys: Sequence[str], seed: int) -> Column:
    """Hex digest of key and seed: a reproducible random order that other engines share."""
    parts = [quoted(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))).cast("binary"))


def hash_bucket(order: Column, digits: int = 4) -> Column:
    """Leading hex digits: 16**digits buckets of equal expected size, whatever the key skew."""
    return F.substring(order, 1, digits)


def row_digest(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """256-bit digest of a row; equal rows (null = null, NaN = NaN, -0.0 = 0.0) agree.

    Each value carries its length, so neighbouring values cannot run into each other.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for name in columns or df.columns:
        text = sql_name(name)
        dtype = types[name]
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            text = f"if({text} = 0, cast(0 as {dtype.simpleString()}), {text})"
        if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
            text = f"to_json({text}, map('ignoreNullFields', 'false'))"
        if not isinstance(dtype, T.StringType):
            text = f"cast({text} as string)"
        parts.append(f"coalesce(concat(length({text}), ':', {text}), '-')")
    return F.expr(f"unhex(sha2(concat({', '.join(parts)}), 256))")


def texts_json(columns: Sequence[str]) -> Column:
    """The row of text columns as one JSON array, nulls included."""
    return F.to_json(F.array(*[quoted(c) for c in columns]))


def text_digest(df: DataFrame, columns: Sequence[str], json: str) -> Column:
    """256-bit digest of a row of texts from the column ``json`` that :func:`texts_json` gave; equal rows agree.

    The array tells any two rows of valid texts apart. Bytes that are no text all become U+FFFD there, so rows that
    hold it get :func:`row_digest`, whose input never begins like an array.
    """
    odd = F.contains(F.col(json), F.lit("\ufffd"))
    return F.when(odd, row_digest(df, columns)).otherwise(F.unhex(F.sha2(F.col(json), 256)))

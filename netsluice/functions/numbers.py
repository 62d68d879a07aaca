"""Numeric clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsluice.functions.text import WHITESPACE

# --- fixed values: texts that stand for "no number" ---------------------------------
NOT_A_NUMBER_TEXTS = ["", "none", "null", "nan", "inf", "-inf"]

# --- fixed values: words that are read as a number, though not a finite one ---------
SPECIAL_NUMBERS = [
    "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity", "nan", "+nan", "-nan",
]

#: Cells whose text is no number: the cleaned field name and the text.
REFUSED = "array<struct<field:string,text:string>>"

_INFINITY = float("inf")


def not_finite(c: Column) -> Column:
    """True for NaN and either infinity; null stays null."""
    return F.isnan(c) | (F.abs(c) == F.lit(_INFINITY))


def is_missing(c: Column, dtype: str) -> Column:
    """Null, or NaN where the type has one."""
    return c.isNull() | F.isnan(c) if dtype in ("double", "float") else c.isNull()


def finite_or(c: Column, default: float | None) -> Column:
    """The value as double; null, NaN and infinities become ``default``.

    One comparison does it: NaN sorts above infinity, and null fails any comparison.
    """
    d = c.cast("double")
    return F.when(F.abs(d) < _INFINITY, d).otherwise(F.lit(default).cast("double"))


def infinite_to_null(c: Column) -> Column:
    """Infinities and NaN become null."""
    return finite_or(c, None)


# Wide tables are projected with SQL text: one call per column instead of one per operator.


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def finite_sql(c: str, default: str = "0.0D") -> str:
    """SQL form of :func:`finite_or` over an expression."""
    d = f"cast({c} as double)"
    return f"if(abs({d}) < double('Infinity'), {d}, {default})"


def decimal_sql(c: str) -> str:
    """SQL form of :func:`decimal_number` over an expression."""
    return f"if({c} rlike '[dDfFxX]', null, try_cast({c} as double))"


def decimal_number(c: Column) -> Column:
    """Decimal text to double, null otherwise; overflow gives infinity.

    Text with a letter of ``1d``, ``1f`` or ``0x1``, forms that only Spark's cast takes, is refused.
    """
    return F.when(~c.rlike("[dDfFxX]"), c.try_cast("double"))


def grouped_number(c: Column) -> Column:
    """Digits grouped by single underscores (``1_000``) to double, null otherwise."""
    grouped = c.contains("_") & c.rlike(
        r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
    )
    return F.when(grouped, F.replace(c, F.lit("_"), F.lit("")).try_cast("double"))


def parse_number(c: Column) -> Column:
    """Text to double the way Python's ``float`` reads it, words for infinity and NaN included."""
    word = F.lower(F.btrim(c, F.lit(WHITESPACE)))
    special = F.when(word.isin(*SPECIAL_NUMBERS), word.try_cast("double"))
    return F.coalesce(decimal_number(c), special, grouped_number(c))


def coerce_number(c: Column, dtype: str) -> Column:
    """Null, non-finite and placeholder texts become 0.0; other text that is no number gives null."""
    if dtype != "string":
        return finite_or(c, 0.0)
    decimal = decimal_number(c)
    word = F.lower(F.btrim(c, F.lit(WHITESPACE)))
    blank = c.isNull() | decimal.isNotNull() | word.isin(*NOT_A_NUMBER_TEXTS, *SPECIAL_NUMBERS)
    return F.when(F.abs(decimal) < _INFINITY, decimal).when(blank, 0.0).otherwise(grouped_number(c))


def clamp_at_zero(c: Column) -> Column:
    """Negative values become 0; null and NaN are left alone."""
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def safe_number(c: Column) -> Column:
    """Uploaded text to a finite double, 0 for anything else."""
    return finite_or(decimal_number(c), 0.0)


def log10_from_one(c: Column) -> Column:
    """log10 after raising values below 1 to 1; null stays null."""
    return F.log10(F.when(c < 1, F.lit(1.0)).otherwise(c))


def clip_above(c: Column, cap: Column) -> Column:
    return F.when(c > cap, cap).otherwise(c)


def ratio(part: Column, whole: Column, default: float = 0.0) -> Column:
    """``part / whole`` with ``default`` for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(default))

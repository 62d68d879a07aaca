"""Key, label, outcome and display expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"

#: A key as the cleaned records should have it.
SNAKE_KEY = "^[a-z0-9][a-z0-9_/]*$"

# --- fixed values: Windows-1252 characters for the bytes Latin-1 leaves as controls --
_CP1252_BYTES = (
    "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e"
    "\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
)
_CP1252_CHARS = (
    "€‚ƒ„…†‡ˆ‰Š‹ŒŽ"
    "‘’“”•–—˜™š›œžŸ"
)
# --- fixed values: what an en-dash looks like after one or another wrong decoding ----
_BROKEN_DASH = "â€“"
_DASHES = "�–—"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def latin1_to_cp1252(c: Column) -> Column:
    """Text read as Latin-1 to the characters its Windows-1252 bytes stand for."""
    return F.translate(c, _CP1252_BYTES, _CP1252_CHARS)


def snake_key(c: Column) -> Column:
    """Column form of :func:`netsluice.schema.snake`."""
    return F.translate(F.lower(trimmed(c)), " /-.", "____")


def header_key(c: Column) -> Column:
    """Trim, lower-case, and turn every other character than a-z, 0-9 into an underscore."""
    return F.regexp_replace(F.lower(trimmed(c)), "[^a-z0-9]", "_")


def normal_label(c: Column) -> Column:
    """Traffic label in lower-case ASCII with plain dashes; missing or blank gives ``benign``."""
    plain = F.translate(F.replace(c, F.lit(_BROKEN_DASH), F.lit("-")), _DASHES, "---")
    ascii_only = F.regexp_replace(plain, r"[^\x00-\x7F]", "")
    text = F.replace(F.lower(trimmed(ascii_only)), F.lit("  "), F.lit(" - "))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("benign"))


def attack_flag(label: Column) -> Column:
    return (label != "benign").cast("int")


def is_attack_outcome(c: Column) -> Column:
    """Outcome text equals ATTACK whatever its case and outer blanks; null is no attack."""
    return F.coalesce(F.upper(trimmed(c.cast("string"))) == "ATTACK", F.lit(False))


def outcome_text(is_attack: Column) -> Column:
    return F.when(is_attack, F.lit("ATTACK")).otherwise(F.lit("BENIGN"))


def signal_value(is_attack: Column, confidence: Column) -> Column:
    """Height of a point on the signal line: 1 for an attack, else its confidence."""
    return F.when(is_attack, F.lit(1.0)).otherwise(confidence)


def _millis(ts: Column) -> Column:
    """Milliseconds since 1970, halves rounded away from it."""
    return (F.round(F.unix_micros(ts.cast("timestamp")), -3) / 1000).cast("bigint")


def relative_age(ts: Column, as_of: Column) -> Column:
    """Age as ``12s ago``, ``5m ago`` or ``3h ago``, each step rounded half up; times count in whole milliseconds."""
    millis = _millis(as_of) - _millis(ts)
    seconds = F.floor(millis / 1000.0 + 0.5)
    minutes = F.floor(seconds / 60.0 + 0.5)
    hours = F.floor(minutes / 60.0 + 0.5)
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s ago")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h ago")))
    )


def value_text(c: Column, dtype: str) -> Column:
    """A value as people write it: 23 for 23.0, and no exponent for common sizes."""
    text = c.cast("string")
    if dtype not in ("double", "float"):
        return text
    size = F.abs(c)
    whole = (c == F.floor(c)) & (size < 1e15)
    exponent = ((size >= 1e7) & (size < 1e15)) | ((size >= 1e-6) & (size < 1e-3))
    plain = F.regexp_replace(text.try_cast("decimal(38,22)").cast("string"), "0+$", "")
    return F.when(whole, c.cast("bigint").cast("string")).when(exponent, plain).otherwise(text)

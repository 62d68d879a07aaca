"""Scored rows: outcome filters, alerts, the detection log and its searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsluice import schema
from netsluice.functions.keys import quoted
from netsluice.functions.text import is_attack_outcome, value_text
from netsluice.operators.ranking import newest, number_rows
from netsluice.sources import generations


def by_outcome(df: DataFrame, which: str = "all", outcome: str = "is_anomaly") -> DataFrame:
    """All rows, only attacks, or only benign rows."""
    attack = is_attack_outcome(F.col(outcome))
    return {"all": df, "attacks": df.where(attack), "benign": df.where(~attack)}[which]


def sorted_results(df: DataFrame, key: str = "row", ascending: bool = True, row: str = "row") -> DataFrame:
    """Results by row number or confidence; equal keys stay in row order."""
    first = F.col(key).asc() if ascending else F.col(key).desc()
    return df.orderBy(first, F.col(row).asc())


def numbered_results(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Results with their 1-based row number in input order."""
    return number_rows(df, order, "row")


def alerts(
    df: DataFrame, score: str = "ml_confidence_score", threshold: float = schema.ALERT_THRESHOLD
) -> DataFrame:
    """Rows scored strictly above the threshold; NaN and null are none."""
    s = F.col(score)
    return df.where((s > threshold) & ~F.isnan(s))


def is_recent(ts: Column, as_of: Column, seconds: int = 5) -> Column:
    return as_of.cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds)) < ts.cast("timestamp")


def batch_summary(df: DataFrame, outcome: str = "is_anomaly", scored_ok: str | None = None) -> DataFrame:
    """Rows processed, anomalies found, and rows that got a placeholder instead of a score."""
    failed = ~F.col(scored_ok) if scored_ok else F.lit(False)
    return df.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count(F.when(is_attack_outcome(F.col(outcome)), 1)).alias("anomalies_found"),
        F.count(F.when(failed, 1)).alias("failed_count"),
    )


def detection_rows(
    df: DataFrame, source: str, key: Sequence[str], ts: str, payload: Sequence[str], outcome: str = "is_anomaly"
) -> DataFrame:
    """Detections of a scored table: attacks only, with a stable id and their payload."""
    parts = [quoted(k).cast("string") for k in key]
    return df.where(is_attack_outcome(F.col(outcome))).select(
        F.sha2(F.concat_ws("|", F.lit(source), *parts), 256).alias("id"),
        F.lit(source).alias("source"),
        outcome,
        "confidence",
        F.col(ts).alias("timestamp"),
        F.struct(*payload).alias("payload"),
    )


def append_detections(detections: DataFrame, path: str) -> None:
    """Append to a log with a single writer; :func:`log_detections` takes several at once."""
    detections.write.mode("append").parquet(path)


def clear_detections(like: DataFrame, path: str) -> None:
    """Empty the log, keeping its schema."""
    like.limit(0).write.mode("overwrite").parquet(path)


def log_detections(detections: DataFrame, root: str) -> int:
    """Append to a log that several sessions write to and clear; returns the generation that shows the rows."""
    return generations.append(detections, root)


def clear_log(spark: SparkSession, root: str) -> int:
    """Empty such a log: later readers see what is appended after this generation."""
    return generations.commit(spark, root, clears=True)


def read_detections(spark: SparkSession, root: str, fields: str | T.StructType, upto: int | None = None) -> DataFrame:
    """The log as of one generation, by default the last."""
    return generations.read(spark, root, fields, upto)


def recent_attacks(detections: DataFrame, k: int = 5, tie: Sequence[str] = ("id",)) -> DataFrame:
    return newest(detections, "timestamp", tie, k)


def search_detections(
    df: DataFrame, source: str | None = None, search: str = "", payload: Sequence[str] | None = None
) -> DataFrame:
    """Detections of a source whose payload holds the text in any value, whatever its case.

    ``payload`` names the columns to look in; by default the fields of the struct ``payload``.
    """
    if source is not None and source != "all":
        df = df.where(F.col("source") == source)
    needle = search.strip().lower()
    if not needle:
        return df
    if payload is None:
        fields = df.select("payload.*").dtypes
        columns = [(F.col(f"payload.`{name}`"), dtype) for name, dtype in fields]
    else:
        types = dict(df.dtypes)
        columns = [(quoted(name), types[name]) for name in payload]
    texts = F.array(*[F.lower(value_text(c, dtype)) for c, dtype in columns])
    return df.where(F.exists(texts, lambda t: F.coalesce(F.contains(t, F.lit(needle)), F.lit(False))))

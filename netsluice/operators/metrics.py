"""Session figures and time-window rates over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsluice.functions.numbers import ratio
from netsluice.operators.quantiles import exact_quantiles
from netsluice.operators.ranking import running_totals

# --- fixed values: upper bounds in seconds of the usual latency histogram -----------
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def session_kpis(df: DataFrame, attack: Column, confidence: Column, millis: Column) -> DataFrame:
    """Predictions, attacks, attack and benign rate in percent, mean confidence and time; 0 for no rows."""
    n, hits = F.col("predictions"), F.col("attacks")
    sums = df.agg(
        F.count(F.lit(1)).alias("predictions"),
        F.count(F.when(attack, 1)).alias("attacks"),
        F.sum(confidence).alias("c"),
        F.sum(millis).alias("t"),
    )
    rate = ratio(hits * 100.0, n)
    return sums.select(
        n,
        hits,
        rate.alias("attack_rate"),
        F.when(n > 0, 100.0 - rate).otherwise(F.lit(0.0)).alias("benign_rate"),
        ratio(F.col("c"), n).alias("avg_confidence"),
        ratio(F.col("t"), n).alias("avg_millis"),
    )


def scoring_counters(df: DataFrame, version: str, attack: Column) -> DataFrame:
    """Predictions and anomalies per model version."""
    return df.groupBy(version).agg(
        F.count(F.lit(1)).alias("predictions"), F.count(F.when(attack, 1)).alias("anomalies")
    )


def latency_histogram(df: DataFrame, seconds: Column, bounds: Sequence[float] = tuple(LATENCY_BOUNDS)) -> DataFrame:
    """Cumulative counts of observations up to each bound, the last one unbounded."""
    aggs = [F.count(F.when(seconds <= b, 1)).alias(f"b{i}") for i, b in enumerate(bounds)]
    aggs.append(F.count(seconds).alias("all"))
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("rows")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("rows")))
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def rate_columns(attack: Column, seconds: Column, window_seconds: int) -> list[Column]:
    """Aggregates of one time window: used alike by the batch and the streaming form."""
    n = F.count(F.lit(1))
    return [
        n.alias("predictions"),
        (n / F.lit(float(window_seconds))).alias("per_second"),
        (F.count(F.when(attack, 1)) / n).alias("anomaly_ratio"),
        F.avg(seconds).alias("avg_latency"),
    ]


def window_rates(
    df: DataFrame, ts: str, attack: Column, seconds: Column, window_seconds: int = 300, with_p95: bool = True
) -> DataFrame:
    """Per tumbling window: rows, rows per second, anomaly ratio, mean and 95 % latency."""
    start = F.window(F.col(ts).cast("timestamp"), f"{window_seconds} seconds")["start"]
    tagged = df.withColumn("window_start", start)
    rates = tagged.groupBy("window_start").agg(*rate_columns(attack, seconds, window_seconds))
    if not with_p95:
        return rates
    p95 = exact_quantiles(
        tagged.select("window_start", seconds.alias("latency")), ["latency"], [0.95], ["window_start"]
    ).select("window_start", F.col("value").alias("p95_latency"))
    return rates.join(p95, "window_start", "left")


def running_counts(df: DataFrame, batch: str, attack: Column) -> DataFrame:
    """Rows and attacks of each micro-batch and the totals up to it."""
    per_batch = df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("cleaned"), F.count(F.when(attack, 1)).alias("attacks")
    )
    return running_totals(per_batch, [batch], {"total_cleaned": "cleaned", "total_attacks": "attacks"})

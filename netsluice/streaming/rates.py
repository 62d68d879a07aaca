"""Event-time rates and the short signal history of a scored stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsluice.functions.text import signal_value
from netsluice.operators.metrics import rate_columns
from netsluice.operators.ranking import newest
from netsluice.session import stored

HISTORY_LENGTH = 50

#: Size of the latency sketches, and the rank error that quantiles read off them keep to.
SKETCH = 1024
RANK_ERROR = 0.01


def stream_rates(
    stream: DataFrame,
    ts: str,
    attack: Column,
    seconds: Column,
    window_seconds: int = 300,
    slide_seconds: int | None = None,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Rates per event-time window, with what is needed to merge windows. Rows later than ``lateness`` are left out.

    ``latency_sketch`` keeps the latencies' ranks within RANK_ERROR; the 95 % latency is read off it
    (:func:`~netsluice.operators.metrics.window_rates` gives the exact one). ``attacks``, ``latencies`` and
    ``latency_sum`` are sums.
    """
    event_time = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    slide = f"{slide_seconds} seconds" if slide_seconds else None
    return (
        event_time.groupBy(F.window("_ts", f"{window_seconds} seconds", slide).alias("w"))
        .agg(
            *rate_columns(attack, seconds, window_seconds),
            F.count(F.when(attack, 1)).alias("attacks"),
            F.count(seconds).alias("latencies"),
            F.sum(seconds).alias("latency_sum"),
            F.kll_sketch_agg_double(seconds.cast("double"), F.lit(SKETCH)).alias("latency_sketch"),
        )
        .select(F.col("w.start").alias("window_start"), "*", sketched_quantile("latency_sketch", 0.95).alias("p95_latency"))
        .drop("w")
    )


def sketched_quantile(sketch: str, p: float) -> Column:
    """A quantile from a sketch column; null of an empty one."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(p)))


def merged_rates(rates: DataFrame, window_seconds: int) -> DataFrame:
    """Rates of longer windows out of the finished, tumbling windows of :func:`stream_rates`; no row is read again.

    Sums add, and sketches merge with the same bound on the rank, however many of them and in whatever order. The
    result merges on in the same way.
    """
    start = F.window("window_start", f"{window_seconds} seconds")["start"]
    n = F.sum("predictions")
    merged = rates.groupBy(start.alias("window_start")).agg(
        n.alias("predictions"),
        (n / F.lit(float(window_seconds))).alias("per_second"),
        (F.sum("attacks") / n).alias("anomaly_ratio"),
        (F.sum("latency_sum") / F.sum("latencies")).alias("avg_latency"),
        F.sum("attacks").alias("attacks"),
        F.sum("latencies").alias("latencies"),
        F.sum("latency_sum").alias("latency_sum"),
        F.kll_merge_agg_double("latency_sketch", F.lit(SKETCH)).alias("latency_sketch"),
    )
    return merged.withColumn("p95_latency", sketched_quantile("latency_sketch", 0.95))


def rank_audit(df: DataFrame, ts: str, seconds: Column, rates: DataFrame, window_seconds: int, p: float = 0.95) -> DataFrame:
    """(window_start, p95_latency, low, high): the exact shares of a window's latencies below, and up to, its sketched quantile.

    A quantile is within the bound where low - RANK_ERROR <= p <= high + RANK_ERROR.
    """
    start = F.window(F.col(ts).cast("timestamp"), f"{window_seconds} seconds")["start"]
    rows = df.select(start.alias("window_start"), seconds.alias("_s")).where(F.col("_s").isNotNull())
    found = stored(rates.select("window_start", "p95_latency"), "quantiles")
    n = F.count(F.lit(1))
    return rows.join(found, "window_start").groupBy("window_start", "p95_latency").agg(
        (F.count(F.when(F.col("_s") < F.col("p95_latency"), 1)) / n).alias("low"),
        (F.count(F.when(F.col("_s") <= F.col("p95_latency"), 1)) / n).alias("high"),
    )


def signal_history(
    df: DataFrame, ts: str, tie: Sequence[str], attack: Column, confidence: Column, length: int = HISTORY_LENGTH
) -> DataFrame:
    """The newest points of the signal line with their value."""
    return newest(df, ts, tie, length).select(
        *tie, ts, attack.alias("is_anomaly"), signal_value(attack, confidence).alias("value")
    )


def keep_history(path: str, ts: str, tie: Sequence[str], length: int = HISTORY_LENGTH) -> Callable[[DataFrame, int], None]:
    """Batch writer that keeps the newest ``length`` rows: one small table per batch, made from
    the one before it, so that a repeated batch gives the same table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = newest(batch, ts, tie, length)
        if batch_id > 0:
            rows = newest(rows.unionByName(batch.sparkSession.read.parquet(f"{path}/{batch_id - 1}")), ts, tie, length)
        rows.write.mode("overwrite").parquet(f"{path}/{batch_id}")

    return write

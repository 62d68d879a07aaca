"""Stream stages: raw files to records, records to cleaned flows, cleaned flows to scores.

All stages are stateless maps over a checkpointed query. Batches written from ``foreachBatch``
go to a folder named after the batch and are overwritten on a repeat, so a failed and repeated
batch leaves no doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from netsluice import schema
from netsluice.operators.clean import clean_records
from netsluice.operators.detections import alerts
from netsluice.plans.scoring import Model, scored_records
from netsluice.quality.records import CleanedRecords
from netsluice.quality.report import DataQualityError, collect_report
from netsluice.quality.rules import cleaned_rule_results
from netsluice.session import work_path
from netsluice.sources.files import csv_options, json_text, raw_flow_columns


def raw_file_stream(
    spark: SparkSession, folder: str, encoding: str = "windows-1252", files_per_trigger: int | None = None
) -> DataFrame:
    """New raw flow files of a folder as JSON text records; every value keeps its text, missing ones are null."""
    reader = spark.readStream.schema(schema.RAW_SCHEMA).options(**csv_options(encoding))
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return json_text(raw_flow_columns(reader.csv(folder), encoding))


def json_file_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """JSON-lines files of a folder as text records: the file form of a topic."""
    reader = spark.readStream
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(folder).where(F.trim("value") != "")


def cleaned_stream(records: DataFrame, max_records: int | None = None) -> DataFrame:
    """Cleaning stage over text records; ``max_records`` stops after so many over the query's life.

    The cap is met in each task first, so only that many rows per task reach the final count.
    """
    if max_records is not None:
        records = records.limit(max_records)
    return clean_records(records)


def scored_stream(cleaned: DataFrame, model: Model | None, version: str = schema.MODEL_VERSION) -> DataFrame:
    return scored_records(cleaned, model, version)


def bounded(writer: DataStreamWriter, checkpoint: str) -> DataStreamWriter:
    """Run over what is there now and stop, going on from the checkpoint the next time."""
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append a stream to a file table, exactly once, and stop when the input is used up."""
    return bounded(stream.writeStream.format(fmt).outputMode("append"), checkpoint).start(path)


def batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def write_scores(path: str, alerts_path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer with two sinks: every scored row, and the alerts among them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_path(path, batch_id))
        written = batch.sparkSession.read.parquet(batch_path(path, batch_id))
        alerts(written).write.mode("overwrite").parquet(batch_path(alerts_path, batch_id))

    return write


def run_scoring(stream: DataFrame, path: str, alerts_path: str, checkpoint: str) -> StreamingQuery:
    return bounded(stream.writeStream.foreachBatch(write_scores(path, alerts_path)), checkpoint).start()


def write_gated(path: str, quarantine: str, totals: list[dict] | None = None) -> Callable[[DataFrame, int], None]:
    """Batch writer that gates cleaned rows before they are let through.

    A failing batch goes to the quarantine and stops the query; its offsets stay uncommitted.
    ``totals`` collects rows and attacks of each batch, observed while it is written.
    The batch waits for its verdict in one table of the shared folder, which the next one overwrites: its 79
    columns are an eighth there of what they are as cached rows.
    """
    waiting: list[str] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not waiting:
            waiting.append(work_path(spark, "gated-batch"))
        batch.write.mode("overwrite").parquet(waiting[0])
        held = spark.read.schema(batch.schema).parquet(waiting[0])
        report = collect_report(cleaned_rule_results(CleanedRecords(held)))
        if not report.passed:
            held.write.mode("overwrite").parquet(batch_path(quarantine, batch_id))
            raise DataQualityError(report)
        seen = Observation(f"cleaned-{batch_id}")
        counted = held.observe(
            seen, F.count(F.lit(1)).alias("cleaned"), F.coalesce(F.sum("is_attack"), F.lit(0)).alias("attacks")
        )
        counted.write.mode("overwrite").parquet(batch_path(path, batch_id))
        if totals is not None:
            totals.append({"batch_id": batch_id, **seen.get})

    return write


def run_gated(
    stream: DataFrame, path: str, quarantine: str, checkpoint: str, totals: list[dict] | None = None
) -> StreamingQuery:
    return bounded(stream.writeStream.foreachBatch(write_gated(path, quarantine, totals)), checkpoint).start()


def running_totals_of(totals: Sequence[dict]) -> list[dict]:
    """Totals up to each batch, from the per-batch figures."""
    out, rows, hits = [], 0, 0
    for t in totals:
        rows, hits = rows + t["cleaned"], hits + t["attacks"]
        out.append({"batch_id": t["batch_id"], "total_cleaned": rows, "total_attacks": hits})
    return out

"""The batch pipeline: gate, clean, gate, score, alert, gate. Each stage reads the one before it
from its table, so a lost executor or a restart repeats one stage only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsluice import schema
from netsluice.operators.clean import clean_flows
from netsluice.operators.detections import alerts
from netsluice.plans.scoring import Model, scored_records
from netsluice.quality.records import CleanedRecords, TableRecords
from netsluice.quality.report import gate, gate_each
from netsluice.quality.rules import cleaned_rule_results, raw_rule_results, scored_rule_results
from netsluice.sources.files import raw_numbers, read_raw_flows
from netsluice.sources.interleave import file_positions, first_rows, interleave


def file_verdicts(
    spark: SparkSession, paths: str | Sequence[str], first: int | None = None, by_folder: bool = False, **options
) -> DataFrame:
    """The raw rules' results of every file, or of every folder of files, by one job.

    ``first`` restricts the check to a file's first rows.
    """
    if first is None:
        df = read_raw_flows(spark, paths, with_position=True, **options).drop("block", "line_order")
    else:
        df = first_rows(
            file_positions(read_raw_flows(spark, paths, with_position=True, **options)), n=first
        ).drop("line")
    if by_folder:
        df = df.withColumn("source", F.regexp_replace("source", "/[^/]*$", ""))
    return raw_rule_results(df, by=["source"])


def gate_files(
    spark: SparkSession, paths: str | Sequence[str], first: int | None = None, by_folder: bool = False, **options
) -> DataFrame:
    """Gate every raw file, or folder; returns the verdicts (source, rule, ...), or raises with the first failing one's report."""
    return gate_each(file_verdicts(spark, paths, first, by_folder, **options), "source")


def ingest_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    out: str,
    batch: int = 5_000,
    max_records: int | None = None,
    **options,
) -> int:
    """Raw files to the raw table; with a cap, its rows are taken in turns from all files."""
    if max_records is None:
        df = read_raw_flows(spark, paths, **options)
    else:
        lines = file_positions(read_raw_flows(spark, paths, with_position=True, **options))
        df = interleave(lines, batch=batch, max_records=max_records).drop("source", "line", "round")
    raw_numbers(df).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out).count()


def clean_table(spark: SparkSession, raw: str, out: str) -> dict[str, int]:
    """Raw table to cleaned table, gated; returns rows and attacks. Texts refused on the way stay in ``refused``."""
    clean_flows(spark.read.parquet(raw)).write.mode("overwrite").parquet(out)
    cleaned = spark.read.parquet(out)
    gate(cleaned_rule_results(CleanedRecords(cleaned)))
    sums = cleaned.agg(F.count(F.lit(1)).alias("cleaned"), F.sum("is_attack").alias("attacks")).first()
    return {"cleaned": sums["cleaned"], "attacks": sums["attacks"] or 0}


def score_table(
    spark: SparkSession,
    cleaned: str,
    out: str,
    alerts_out: str,
    model: Model | None,
    version: str = schema.MODEL_VERSION,
) -> dict[str, int]:
    """Cleaned table to scored table and alert table, the alerts gated; returns both counts."""
    scored_records(spark.read.parquet(cleaned), model, version).write.mode("overwrite").parquet(out)
    scored: DataFrame = spark.read.parquet(out)
    alerts(scored).write.mode("overwrite").parquet(alerts_out)
    found = spark.read.parquet(alerts_out)
    processed = scored.count()
    gate(scored_rule_results(TableRecords(found), processed))
    return {"scored": processed, "alerts": found.count()}

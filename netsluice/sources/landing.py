"""Landing folder: what changed, and which files are let in."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsluice.functions.numbers import sql_name

# --- fixed values --------------------------------------------------------------------
MIN_FILE_BYTES = 1_000_000
SNIFFED_BYTES = 512
HTML_STARTS = ["<!doctype", "<html"]


def _listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select(
            "path",
            F.element_at(F.split("path", "/"), -1).alias("name"),
            F.col("modificationTime").alias("modified"),
            "length",
        )
    )


def list_landing(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Files of a folder as (name, modified, length); their content is not read."""
    return _listing(spark, folder, pattern).drop("path")


def landing_changes(current: DataFrame, last: DataFrame) -> DataFrame:
    """Files added, changed or removed since the last state; an empty result means nothing to do."""
    was = last.select(
        "name", F.col("modified").alias("was_modified"), F.col("length").alias("was_length"), F.lit(True).alias("was")
    )
    now = current.select("name", "modified", "length", F.lit(True).alias("now"))
    both = now.join(was, "name", "full_outer")
    change = (
        F.when(F.col("was").isNull(), F.lit("added"))
        .when(F.col("now").isNull(), F.lit("removed"))
        .when((F.col("modified") != F.col("was_modified")) | (F.col("length") != F.col("was_length")), F.lit("changed"))
    )
    return both.select("name", change.alias("change")).where(F.col("change").isNotNull())


def starts_like_html(content: Column) -> Column:
    """The first bytes, left-trimmed and lower-cased, begin an HTML page."""
    head = F.lower(F.regexp_replace(F.decode(F.substring(content, 1, SNIFFED_BYTES), "ISO-8859-1"), r"^\s+", ""))
    found = F.lit(False)
    for start in HTML_STARTS:
        found = found | F.startswith(head, F.lit(start))
    return found


def admission(files: DataFrame, min_bytes: int = MIN_FILE_BYTES) -> DataFrame:
    """Add ``admitted`` and the ``reason`` for refusal to files given as (length, content)."""
    reason = F.when(F.col("length") < min_bytes, F.lit("too small")).when(
        starts_like_html(F.col("content")), F.lit("html page")
    )
    return files.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())


def with_heads(listing: DataFrame, path: str = "path") -> DataFrame:
    """Add the first SNIFFED_BYTES bytes of each listed file as ``content``; nothing behind them is read.

    One bounded read per file, spread over the tasks, by the file system that the path names.
    """
    kinds = ", ".join(f"{sql_name(f.name)} {f.dataType.simpleString()}" for f in listing.schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for name in batch.column(path).to_pylist():
                store, inner = fs.FileSystem.from_uri(name)
                with store.open_input_stream(inner, compression=None) as f:
                    heads.append(f.read(SNIFFED_BYTES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary())], names=[*batch.schema.names, "content"])

    return listing.mapInArrow(read, f"{kinds}, content binary")


def admit_landing(
    spark: SparkSession, folder: str, pattern: str = "*.csv", min_bytes: int = MIN_FILE_BYTES
) -> DataFrame:
    """Admission of the files in a folder as (name, length, admitted, reason).

    Small files are refused from the listing; of the others the first bytes alone are looked at.
    """
    files = _listing(spark, folder, pattern).select("path", "name", "length")
    small = files.where(F.col("length") < min_bytes).withColumn("content", F.lit(b""))
    n = spark.sparkContext.defaultParallelism
    large = with_heads(files.where(F.col("length") >= min_bytes).repartition(n, "path"))
    return admission(small.unionByName(large), min_bytes).select("name", "length", "admitted", "reason")

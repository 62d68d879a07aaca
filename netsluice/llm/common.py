"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsluice.session import work_path

#: Characters of text that one round of a batch operator holds at once.
BLOCK_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: lineage ends there, executors may go."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text alone, under fixed names, so that no further column can clash; a null text is empty."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches so that each piece holds about BLOCK_CHARS of text; a longer text stands alone."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        start, held = 0, 0
        for i, text in enumerate(texts):
            size = len(text)
            if held and held + size > BLOCK_CHARS:
                yield batch.slice(start, i - start), texts[start:i]
                start, held = i, 0
            held += size
        if len(texts) > start:
            yield batch.slice(start), texts[start:]


def per_block(fn: Callable[[pa.RecordBatch, list[str]], dict[str, list]], schema: pa.Schema, column: str = "text"):
    """An Arrow mapper that calls ``fn`` on every block and takes a dict of columns from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, column):
            yield pa.RecordBatch.from_pydict(fn(batch, texts), schema=schema)

    return run

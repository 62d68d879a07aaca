"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir), with docs a plain Parquet table, and returns a DataFrame; run()
writes it to the shared folder and reads it again for the next stage. All but the last keep the columns
of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsluice.llm import bag_minhash, line_join, line_quality, packing, suffix_dedup
from netsluice.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels keep.

    The verdict is made where the row is: text and verdict never part, so repeated or missing ids do no
    harm. A null, empty or blank text is rejected.
    """
    field = line_quality.train(docs, table(spark, sf_dir, "labels"))
    return line_quality.kept_rows(docs, field)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line equals or nearly equals; a document left without lines goes."""
    return line_join.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id, and one row of each id in it."""
    return bag_minhash.without_near_duplicates(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes of repeated 100-byte strings; a document left without a word goes."""
    out = suffix_dedup.texts_without_repeats(docs)
    return out.filter(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), added_tokens=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeat_dedup),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the labels nor the near-duplicates; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k + 1}")
    return docs

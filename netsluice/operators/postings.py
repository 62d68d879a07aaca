"""Substring search in a large detection log by trigram postings.

``update_index`` notes for every log file, cut in blocks of rows, which trigrams its payload texts hold; the postings
lie in folders by a digest of the trigram. A search reads the folders of its own trigrams, intersects their
(file, block) postings, reads only the files that are left, and verifies the substring in their candidate blocks.
Files that are not indexed yet are read as a whole, so an answer never depends on how far the index has come.

Each run of ``update_index`` writes a generation of its own and commits it last, by a file of the manifest; what an
interrupted run left is never read. A committed posting is never rewritten.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsluice.functions.text import value_text
from netsluice.operators.detections import search_detections
from netsluice.session import stored

#: Rows of a log file that one posting stands for.
BLOCK_ROWS = 4096

#: Folders that the postings are dealt over by their trigram.
FOLDERS = 64

#: Tasks over which the postings of one folder are dealt when they are written: a trigram that all blocks hold is spread.
SPREAD = 8

_LENGTH = 3
_POSTING = "trigram string, file string, block long"
_MANIFEST = "file string, generation string, blocks long"


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text; none of a shorter one or of null."""
    last = F.coalesce(F.length(text), F.lit(0)) - (_LENGTH - 1)
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(_LENGTH))))


def payload_texts(df: DataFrame, payload: Sequence[str] | None = None) -> Column:
    """The lower-cased texts of all payload values, as :func:`search_detections` compares them."""
    if payload is None:
        fields = [(F.col(f"payload.`{name}`"), dtype) for name, dtype in df.select("payload.*").dtypes]
    else:
        types = dict(df.dtypes)
        fields = [(F.col(f"`{name}`"), types[name]) for name in payload]
    return F.array(*[F.lower(value_text(c, dtype)) for c, dtype in fields])


def _folder(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(FOLDERS)).cast("int")


def _placed(df: DataFrame) -> DataFrame:
    """The rows of a log with the file and the block they lie in."""
    file = F.regexp_replace("_metadata.file_path", "^file:/+", "file:///")
    meta = df.select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return meta.withColumn("_block", F.floor(F.col("_row") / BLOCK_ROWS).cast("long")).drop("_row")


def manifest(spark: SparkSession, index: str) -> DataFrame:
    """(file, generation, blocks) of every log file that is indexed; none where nothing is committed yet."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{index}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def update_index(spark: SparkSession, log: str, index: str, payload: Sequence[str] | None = None) -> int:
    """Index the log files that are not indexed yet; returns their number.

    Trigrams of a block are made distinct before the shuffle, which deals them by folder and, within a folder,
    by file over SPREAD tasks. Two runs at once may index a file twice: a search reads one generation for each file.
    """
    known = {r.file for r in manifest(spark, index).select("file").distinct().collect()}  # file names, as any listing
    new = [f for f in log_files(spark, log) if f not in known]
    if not new:
        return 0
    generation = uuid.uuid4().hex
    rows = _placed(_files(spark, log, new))
    grams = F.flatten(F.transform(payload_texts(rows, payload), trigrams))
    postings = (
        rows.select("_file", "_block", F.explode(F.array_distinct(grams)).alias("trigram"))
        .groupBy("trigram", F.col("_file").alias("file"), F.col("_block").alias("block")).agg(F.lit(1).alias("one"))
        .select("trigram", "file", "block", _folder(F.col("trigram")).alias("folder"))
    )
    spread = F.pmod(F.xxhash64("file"), F.lit(SPREAD))
    (
        postings.repartition("folder", spread).sortWithinPartitions("folder", "trigram", "file", "block")
        .write.partitionBy("folder").parquet(f"{index}/postings/{generation}")
    )
    listed = rows.groupBy(F.col("_file").alias("file")).agg(F.countDistinct("_block").alias("blocks"))
    listed = spark.createDataFrame([(f,) for f in new], "file string").join(listed, "file", "left")
    commit = listed.select("file", F.lit(generation).alias("generation"), F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"))
    commit.coalesce(1).write.mode("append").parquet(f"{index}/manifest")  # a row per log file
    return len(new)


def log_files(spark: SparkSession, log: str) -> list[str]:
    """The data files of a log, as Spark lists them for any scan of it."""
    return sorted(_uri(f) for f in spark.read.parquet(log).inputFiles())


def _files(spark: SparkSession, log: str, files: Sequence[str]) -> DataFrame:
    """These files of a log, with the columns of the whole log."""
    return spark.read.schema(spark.read.parquet(log).schema).option("basePath", log).parquet(*map(unquote, files))


def _uri(path: str) -> str:
    """A file name in one way of writing: a local one comes with one slash or with three."""
    return "file:///" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def candidate_blocks(spark: SparkSession, index: str, needle: str) -> DataFrame:
    """(file, block) of the indexed blocks that hold every trigram of the needle.

    Only the folders of these trigrams are read, and in them only row groups that can hold one.
    """
    grams = sorted({needle[i : i + _LENGTH] for i in range(len(needle) - _LENGTH + 1)})
    listed = manifest(spark, index)
    chosen = listed.groupBy("file").agg(F.min("generation").alias("generation"))
    generations = [r.generation for r in chosen.select("generation").distinct().collect()]
    if not grams or not generations:
        return spark.createDataFrame([], "file string, block long")
    folders = [r.folder for r in spark.createDataFrame([(g,) for g in grams], "g string").select(_folder(F.col("g")).alias("folder")).distinct().collect()]
    paths = [f"{index}/postings/{g}" for g in generations]
    found = None
    for path, generation in zip(paths, generations):
        part = (
            spark.read.schema(_POSTING + ", folder int").parquet(path)
            .where(F.col("folder").isin(folders) & F.col("trigram").isin(grams)).select("trigram", "file", "block", F.lit(generation).alias("generation"))
        )
        found = part if found is None else found.unionAll(part)
    return (
        found.join(chosen, ["file", "generation"], "left_semi")
        .groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).drop("n")
    )


def search_indexed(
    spark: SparkSession, log: str, index: str, source: str | None = None, search: str = "", payload: Sequence[str] | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """The rows that :func:`search_detections` finds in the log, and how many files were there and were read.

    A search text of fewer than three characters has no trigram: every file is read for it.
    """
    needle = search.strip().lower()
    files = log_files(spark, log)
    whole = spark.read.parquet(log)
    if len(needle) < _LENGTH:
        return search_detections(whole, source, search, payload), {"files": len(files), "files_read": len(files)}
    indexed = {r.file for r in manifest(spark, index).select("file").distinct().collect()}
    blocks = stored(candidate_blocks(spark, index, needle), "blocks")
    held = {r.file for r in blocks.select("file").distinct().collect()}
    hit = [f for f in files if f in held]
    unknown = [f for f in files if f not in indexed]
    facts = {"files": len(files), "files_read": len(hit) + len(unknown)}
    found = search_detections(whole.limit(0), source, search, payload)
    if hit:
        rows = _placed(_files(spark, log, hit))
        near = rows.join(blocks.withColumnsRenamed({"file": "_file", "block": "_block"}), ["_file", "_block"], "left_semi")
        found = search_detections(near.select(*whole.columns), source, search, payload)
    if unknown:
        rest = search_detections(_files(spark, log, unknown), source, search, payload)
        found = found.unionByName(rest) if hit else rest
    return found, facts

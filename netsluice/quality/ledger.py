"""Gates that add up: what a raw file measured is kept, so that a later gate reads new files only.

The raw rules judge counts. The ledger keeps them per version of a file; verdicts on a file, a folder, a day or on
everything are the rules over sums of them. Repeated rows are counted within a file; repeats between files are
:class:`~netsluice.operators.digest_store.DigestStore`'s.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsluice import schema
from netsluice.quality.rules import RAW_STAGE, Limits, measure_names, raw_measures, raw_rules, rule_rows
from netsluice.session import stored
from netsluice.sources import generations
from netsluice.sources.files import read_raw_flows

_FILE = "source string, modified timestamp, length long"


def _template(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in schema.RAW_FIELDS))


def _measures(spark: SparkSession) -> list[str]:
    return measure_names(raw_rules(_template(spark)))


def _fields(spark: SparkSession) -> str:
    return _FILE + "".join(f", `{m}` long" for m in _measures(spark))


def raw_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(source, modified, length) of raw files; nothing of their content is read."""
    listing = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    source = F.regexp_replace("path", "^file:/+", "file:///")
    return listing.select(source.alias("source"), F.col("modificationTime").alias("modified"), "length")


def measured(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """A row for each measured version of a file, some of them by two runs at once: equal rows then."""
    return generations.read(spark, root, _fields(spark), upto).distinct()


def update_ledger(spark: SparkSession, paths: str | Sequence[str], root: str, **options) -> int:
    """Measure the files that came or changed since; returns how many. A run that dies leaves the ledger as it was."""
    known = measured(spark, root).select("source", "modified", "length")
    new = stored(raw_files(spark, paths).join(known, ["source", "modified", "length"], "left_anti"), "new-files")
    names = [r.source for r in new.select("source").collect()]  # a row per new file, as any listing
    if not names:
        return 0
    rows = read_raw_flows(spark, names, with_position=True, **options).drop("block", "line_order")
    rows = rows.withColumn("source", F.regexp_replace("source", "^file:/+", "file:///"))
    found = raw_measures(rows, by=["source"])
    counts = [F.coalesce(F.col(f"`{m}`").cast("long"), F.lit(0)).alias(m) for m in _measures(spark)]  # a file without rows: none
    generations.append(new.join(found, "source", "left").select("source", "modified", "length", *counts), root)
    return len(names)


def ledger_verdicts(
    spark: SparkSession, paths: str | Sequence[str], root: str, by: str = "file", limits: Limits = Limits()
) -> DataFrame:
    """The raw rules over the files that are there now, as measured: by ``file``, ``folder``, ``day`` of the file, or ``all``.

    Files that are there but not measured yet make the verdict impossible, and raise.
    """
    now = raw_files(spark, paths)
    rows = now.join(measured(spark, root), ["source", "modified", "length"], "left")
    names = _measures(spark)
    open_ = rows.where(F.col(f"`{names[0]}`").isNull()).count()
    if open_:
        raise LookupError(f"{open_} files are not measured yet")
    groups = {
        "file": [F.col("source").alias("source")],
        "folder": [F.regexp_replace("source", "/[^/]*$", "").alias("source")],
        "day": [F.to_date("modified").alias("day")],
        "all": [],
    }[by]
    keys = {"file": ["source"], "folder": ["source"], "day": ["day"], "all": []}[by]
    sums = rows.groupBy(*groups).agg(*[F.coalesce(F.sum(f"`{m}`"), F.lit(0)).alias(m) for m in names])
    return rule_rows(sums, RAW_STAGE, raw_rules(_template(spark), limits), keys)

"""Landing folder to raw table, each file exactly once, over failures and several runners.

A run reads the state of the last commit, ingests the files that came or changed since, and commits rows and new state
together. A run that dies before its commit leaves nothing; of two runs at once one commits and the other starts over.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsluice.session import stored
from netsluice.sources import generations
from netsluice.sources.files import raw_numbers, read_raw_flows
from netsluice.sources.landing import admit_landing, landing_changes, list_landing

STATE = "name string, modified timestamp, length long, present boolean, admitted boolean, reason string"


def landing_state(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """Every file ever seen, with its last version, whether it is still there and was let in."""
    found = generations.commits(spark, root, upto)
    if not found:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{root}/{found[-1].note['state']}")


def ingested(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """The ingested rows with their file (``source_name``, ``source_modified``), each file in its last version.

    A file that has left the folder keeps its rows.
    """
    found = [c for c in generations.commits(spark, root, upto) if c.folder]
    if not found:
        raise LookupError(f"nothing ingested yet under {root}")
    rows = spark.read.parquet(*[f"{root}/{c.folder}" for c in found])
    last = landing_state(spark, root, upto).select(F.col("name").alias("source_name"), F.col("modified").alias("source_modified"))
    return rows.join(last, ["source_name", "source_modified"], "left_semi")


def _read(spark: SparkSession, folder: str, names: list[str], encoding: str) -> DataFrame:
    rows = read_raw_flows(spark, [f"{folder}/{n}" for n in names], encoding, with_position=True).drop("block", "line_order")
    return rows.withColumn("source_name", F.element_at(F.split("source", "/"), -1)).drop("source")


def ingest_landing(
    spark: SparkSession,
    folder: str,
    root: str,
    pattern: str = "*.csv",
    min_bytes: int = 1_000_000,
    encoding: str = "windows-1252",
    check: Callable[[DataFrame], None] | None = None,
) -> dict[str, int]:
    """Ingest what came or changed since the last commit; returns the generation and the number of files and rows.

    Files that are not admitted are noted in the state with their reason and not looked at again until they change.
    ``check`` may raise on the new rows, such as a gate does: nothing is committed then. File names are listed on the
    driver, as for any scan.
    """
    while True:
        at = generations.generation(spark, root)
        try:
            return _ingest(spark, folder, root, pattern, min_bytes, encoding, check, at)
        except generations.Conflict:
            continue  # another run was first: what is new is seen by its state now


def _ingest(spark, folder, root, pattern, min_bytes, encoding, check, at) -> dict[str, int]:
    state = landing_state(spark, root, at)
    now = stored(list_landing(spark, folder, pattern), "listing")
    changes = stored(landing_changes(now, state.where("present").select("name", "modified", "length")), "changes")
    if changes.isEmpty():
        return {"generation": at, "files": 0, "rows": 0}
    new = stored(
        admit_landing(spark, folder, pattern, min_bytes).join(changes.where("change <> 'removed'"), "name", "left_semi")
        .select("name", "admitted", "reason"), "new",
    )
    seen = now.withColumn("present", F.lit(True))
    fresh = seen.join(new, "name")
    same = seen.join(changes, "name", "left_anti").join(state.select("name", "admitted", "reason"), "name")
    gone = state.join(now, "name", "left_anti").withColumn("present", F.lit(False))
    columns = [f.split()[0] for f in STATE.split(", ")]
    folder_of_state = f"state/{uuid.uuid4().hex}"
    whole = fresh.select(*columns).unionByName(same.select(*columns)).unionByName(gone.select(*columns))
    whole.write.parquet(f"{root}/{folder_of_state}")
    names = sorted(r.name for r in new.where("admitted").select("name").collect())
    data, rows = None, 0
    if names:
        data = f"data/{uuid.uuid4().hex}"
        versions = now.select(F.col("name").alias("source_name"), F.col("modified").alias("source_modified"))
        raw_numbers(_read(spark, folder, names, encoding)).join(versions, "source_name").write.parquet(f"{root}/{data}")
        written = spark.read.parquet(f"{root}/{data}")
        if check is not None:
            check(written)
        rows = written.count()
    number = generations.commit(spark, root, data, note={"state": folder_of_state, "files": len(names), "rows": rows}, after=at)
    return {"generation": number, "files": len(names), "rows": rows}

"""Repeated rows between ingests: the digests of past rows in buckets, met by new ones without moving the old.

The store is a table of (digest, ingest) in hash buckets. New rows are reduced to distinct digests, dealt into the same
buckets, and joined bucket by bucket: only they are shuffled, however large the store has grown.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsluice.functions.keys import row_digest
from netsluice.functions.numbers import sql_text
from netsluice.session import stored

#: Buckets of a store: fixed for its life. Sized so that a bucket of the largest store fits a task.
BUCKETS = 64


@dataclass(frozen=True)
class DigestStore:
    """A store in a folder. Its table is entered in the session's catalog; any session may open the same folder."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    @property
    def table(self) -> str:
        return "digest_store_" + hashlib.md5(self.path.encode()).hexdigest()[:16]

    def open(self) -> DigestStore:
        self.spark.sql(
            f"create table if not exists {self.table} (digest binary, ingest string) using parquet "
            f"clustered by (digest) sorted by (digest) into {self.buckets} buckets location {sql_text(self.path)}"
        )
        self.spark.catalog.refreshTable(self.table)  # files that another session wrote
        return self

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def digests(self, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """(digest, copies) of the rows, in the store's buckets. Copies are counted before the shuffle."""
        rows = df.select(row_digest(df, columns).alias("digest"))
        counted = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
        return counted.repartition(self.buckets, "digest")

    def met(self, new: DataFrame, ingest: str) -> DataFrame:
        """The new digests with ``seen``: whether another ingest brought them before."""
        past = self.rows().where(F.col("ingest") != ingest).select("digest", F.lit(True).alias("seen"))
        # a digest may stand twice, where a run died after it had written: one match is enough
        hits = new.join(past, "digest", "left_semi").select("digest", F.lit(True).alias("seen"))
        return new.join(hits, "digest", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))

    def add(self, df: DataFrame, ingest: str, columns: Sequence[str] | None = None) -> dict[str, int]:
        """Take in the rows of an ingest; returns its rows, its repeats within itself, and its rows that were there before.

        Run again with the same name, after a failure or by mistake, it gives the same figures and adds nothing twice:
        digests that the store holds are not written.
        """
        new = stored(self.digests(df, columns), "digests")
        judged = stored(self.met(new.repartition(self.buckets, "digest"), ingest), "met")
        known = self.rows().select("digest")
        fresh = judged.select("digest").repartition(self.buckets, "digest").join(known, "digest", "left_anti")
        (
            fresh.select("digest", F.lit(ingest).alias("ingest")).write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        )
        sums = judged.agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("repeats"),
            F.coalesce(F.sum(F.when(F.col("seen"), F.col("copies"))), F.lit(0)).alias("seen_before"),
        ).first()
        return sums.asDict()

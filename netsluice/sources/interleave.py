"""Line numbers per file, first rows per file, and round-robin order over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsluice.session import stored

#: Splits whose sizes are broadcast at most: about a hundred bytes each.
BROADCAST_BLOCKS = 1_000_000


def file_positions(df: DataFrame, name: str = "line") -> DataFrame:
    """Exact 1-based line numbers for a scan that carries (source, block, line_order).

    The rows of a block lie together in the scan's order, so a line's number is its distance from the
    block's first row plus the rows of the blocks before, and one row per block is all that is shuffled.
    The scan runs once for the block sizes and once for the rows; if the two had cut the files unlike,
    the job would fail rather than number wrongly.
    """
    place = F.col("line_order")
    sizes = df.groupBy("source", "block").agg(F.min(place).alias("_low"), F.max(place).alias("_high"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "blocks")
    # a row per split, a hundred terabytes have under a million; beyond that the join shuffles
    side = F.broadcast(sizes) if sizes.count() <= BROADCAST_BLOCKS else sizes
    joined = df.join(side, ["source", "block"], "left")
    fits = (place >= F.col("_low")) & (place <= F.col("_high")) & (F.col("_high") - F.col("_low") + 1 == F.col("_n"))
    line = F.when(fits, place - F.col("_low") + F.col("_before") + 1).otherwise(
        F.raise_error(F.lit("the two scans cut the files unlike")).cast("bigint")
    )
    return joined.withColumn(name, line).drop("block", "line_order", "_low", "_high", "_n", "_before")


def first_rows(df: DataFrame, line: str = "line", n: int = 10_000) -> DataFrame:
    """The first n rows of each file, by line number."""
    return df.where(F.col(line) <= n)


def interleave(
    df: DataFrame, source: str = "source", line: str = "line", batch: int = 5_000, max_records: int | None = None
) -> DataFrame:
    """Round-robin over files: chunk r of every file belongs to round r; ``line`` counts from 1.

    Adds ``round``; order by (round, source, line) is the published order. With ``max_records``
    only the first so many rows in that order stay. The cap is worked out from chunk sizes, summed per
    round and then over the rounds.
    """
    rounds = df.withColumn("round", F.floor((F.col(line) - 1) / batch).cast("bigint"))
    if max_records is None:
        return rounds
    candidates = rounds.where(F.col(line) <= max_records)
    earlier = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, -1)  # a row per round
    within = Window.partitionBy("round").orderBy(source).rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored(candidates.groupBy("round", source).agg(F.count(F.lit(1)).alias("_n")), "chunk-sizes")
    rounds_before = sizes.groupBy("round").agg(F.sum("_n").alias("_all")).select(
        "round", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_rounds")
    )
    chunks = (
        sizes.join(rounds_before, "round")
        .withColumn("_before", F.col("_rounds") + F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .where(F.col("_before") < max_records)
        .select("round", source, "_before")
    )
    place = F.col("_before") + F.pmod(F.col(line) - 1, F.lit(batch))
    return candidates.join(stored(chunks, "chunks"), ["round", source]).where(place < max_records).drop("_before")

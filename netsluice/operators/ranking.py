"""Exact positions and top rows without an unbounded window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsluice.functions.keys import hash_bucket, hash_order
from netsluice.functions.text import trimmed
from netsluice.session import stored

#: Rows of a range that one task sorts, about; and keys looked at to place its edges.
RANGE_ROWS = 4_000_000
SAMPLED = 20


def with_position(
    df: DataFrame,
    groups: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    name: str = "position",
) -> DataFrame:
    """Add the 1-based position of each row inside its group.

    ``bucket`` cuts a group into consecutive pieces of bounded size. Rows are numbered inside
    their piece only; the sizes of the earlier pieces, one row per piece, give the offset. The
    numbering and the join with the offsets share one shuffle on (group, piece), so a group
    that holds a third of all rows is spread like any other.
    """
    piece = F.struct(*[F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(groups)], bucket.alias("b"))
    tagged = df.withColumn("_piece", piece)
    ahead = Window.partitionBy([F.col(f"_piece.g{i}") for i in range(len(groups))]).orderBy(
        "_piece.b"
    ).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy("_piece")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_piece", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    )
    local = F.row_number().over(Window.partitionBy("_piece").orderBy(*order))
    return (
        tagged.withColumn("_local", local)
        .join(offsets, "_piece")
        .withColumn(name, (F.col("_local") + F.col("_ahead")).cast("bigint"))
        .drop("_piece", "_local", "_ahead")
    )


def position_by_number(
    df: DataFrame, groups: Sequence[str], key: str, name: str = "position", width: int = 1_000_000
) -> DataFrame:
    """Position by a unique whole-number key: a piece of ``width`` keys holds at most ``width`` rows."""
    bucket = F.floor(F.col(key) / F.lit(width)).cast("bigint")
    return with_position(df, groups, bucket, [F.col(key)], name)


def position_by_hash(
    df: DataFrame,
    groups: Sequence[str],
    keys: Sequence[str],
    seed: int,
    name: str = "position",
    digits: int = 4,
) -> DataFrame:
    """Position in the reproducible random order of the row keys."""
    order = hash_order(keys, seed)
    return with_position(
        df.withColumn("_order", order), groups, hash_bucket(F.col("_order"), digits), [F.col("_order")], name
    ).drop("_order")


def _range_edges(df: DataFrame, order: Sequence[str]) -> list[tuple]:
    """Ascending keys that part the rows in ranges of at most about RANGE_ROWS; from a sample of the keys by their hash.

    The edges only decide how evenly the ranges come out. They are texts of the keys' values, about SAMPLED keys per
    range are looked at.
    """
    keys = df.select(*[F.col(f"`{c}`") for c in order])
    n = keys.count()
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(min(tasks, n // 1000 + 1), -(-n // RANGE_ROWS))
    every = max(1, n // (ranges * SAMPLED))
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in order])
    sample = keys.where(F.pmod(hashed, F.lit(every)) == 0).distinct().orderBy(*[F.col(f"`{c}`") for c in order])
    found = [tuple(r) for r in sample.select(*[F.col(f"`{c}`").cast("string") for c in order]).collect()]
    return [found[len(found) * k // ranges] for k in range(1, ranges) if found]


def _range_of(df: DataFrame, order: Sequence[str], edges: Sequence[tuple]) -> Column:
    """The number of edges up to a row's key, by two short lists: of every so many edges, and of those in between."""
    types = dict(df.dtypes)
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)])
    kind = "array<struct<" + ", ".join(f"k{i}: {types[c]}" for i, c in enumerate(order)) + ">>"

    def listed(part: Sequence[tuple]) -> Column:
        cells = [F.struct(*[F.lit(v).cast(types[c]).alias(f"k{i}") for i, (v, c) in enumerate(zip(e, order))]) for e in part]
        return F.array(*cells).cast(kind)

    def upto(part: Column) -> Column:
        return F.size(F.filter(part, lambda e: e <= key))

    step = max(1, math.isqrt(len(edges)))
    chunks = [edges[i : i + step] for i in range(0, len(edges), step)]
    if len(chunks) < 2:
        return upto(listed(edges))
    chunk = upto(listed([c[0] for c in chunks[1:]]))
    return chunk * step + upto(F.get(F.array(*[listed(c) for c in chunks]), chunk))


def running_totals(df: DataFrame, order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Add running sums over the whole table in the order given: ``sums`` maps new to summed column.

    Fixed edges part the keys in ranges. The ranges' own sums come from a scan of the keys and summed columns
    alone; then each row moves once, to the task of its range, is summed there, and the totals of the earlier ranges
    (one row per range) are added. No task sees the whole table. The rows come out in order, range by range. The table
    is read three times and must give the same rows each time; equal keys lie in one range.
    """
    edges = _range_edges(df, order)
    ranged = df.withColumn("_range", _range_of(df, order, edges))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    offsets = stored(
        totals.select(F.col("_range").alias("_of"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums]), "offsets"
    )
    inside = Window.partitionBy("_range").orderBy(*[F.col(f"`{c}`") for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.repartitionById(len(edges) + 1, F.col("_range"))
        .withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
        .join(F.broadcast(offsets), F.col("_range") == F.col("_of"))  # one row per range
        .withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums})
        .drop("_range", "_of", *[f"_{n}" for n in sums])
    )


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row") -> DataFrame:
    """1-based row numbers over the whole table in the order given."""
    return running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), order, {name: "_one"}).drop("_one")


def top_by_count(df: DataFrame, label: str, k: int = 6) -> DataFrame:
    """The k most frequent labels, ties by label."""
    return (
        df.where(F.col(label).isNotNull())
        .groupBy(trimmed(F.col(label)).alias(label))
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), label)
        .limit(k)
    )


def newest(df: DataFrame, ts: str, tie: Sequence[str], k: int) -> DataFrame:
    """The k newest rows, ties by ``tie``: each task keeps k rows, none is sorted whole."""
    return df.orderBy(F.desc(ts), *[F.desc(t) for t in tie]).limit(k)

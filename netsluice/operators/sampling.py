"""Balanced samples, splits, folds and weights, exact and reproducible.

Rows are ordered by a digest of key and seed. The digest of the last wanted row (the cut) is
found from 16**digits bucket counts and then inside one bucket; after that a sample is a plain
filter on the scan, with no shuffle of the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsluice.functions.keys import hash_bucket, hash_order, row_digest
from netsluice.operators.ranking import position_by_number
from netsluice.session import stored


def with_row_key(df: DataFrame, name: str = "row_key", chunk: int = 100_000) -> DataFrame:
    """Give rows without a key one: digest-able row text plus the number of the copy.

    Copies are counted before the shuffle and written out again in chunks that are spread over
    the cluster, so a row repeated without bound stays a bounded piece of work per task.
    """
    columns = df.columns
    copies = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    last_chunk = F.floor((F.col("_copies") - 1) / chunk).cast("int")
    pieces = copies.withColumn("_chunk", F.explode(F.sequence(F.lit(0), last_chunk)))
    # the pieces are small until they are written out, so their number of tasks is given: by size they would be put together
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = pieces.repartition(tasks, *[F.col(f"`{c}`") for c in columns], "_chunk")
    start = F.col("_chunk").cast("bigint") * chunk + 1
    end = F.least(F.col("_copies"), start + chunk - 1)
    numbered = spread.withColumn("_copy", F.explode(F.sequence(start, end)))
    digest = F.hex(row_digest(df))
    return numbered.select(
        *columns, F.concat_ws("#", digest, F.col("_copy").cast("string")).alias(name)
    )


def class_sizes(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("rows"))


def bucket_digits(largest: int) -> int:
    """Hex digits by which a class of so many rows falls into buckets of some ten thousand rows at most."""
    return max(4, math.ceil(math.log(max(largest, 1) / 10_000, 16)))


def hash_cuts(
    df: DataFrame, target: str, keys: Sequence[str], seed: int, wanted: DataFrame, digits: int | None = None
) -> DataFrame:
    """Per class and wanted number the digest of its ``wanted``-th row in hash order, as (target, wanted, cut).

    ``wanted`` has the columns (target, wanted), any number of rows per class; 0 gets no row. Only the rows
    of the buckets in which a cut lies are sorted, bucket by bucket.
    """
    if digits is None:
        digits = bucket_digits(class_sizes(df, target).agg(F.max("rows")).first()[0] or 0)
    ordered = df.select(F.col(target), hash_order(keys, seed).alias("_order")).withColumn(
        "_bucket", hash_bucket(F.col("_order"), digits)
    )
    running = Window.partitionBy(target).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sizes = ordered.groupBy(target, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    cut_bucket = stored(
        sizes.withColumn("_upto", F.sum("_n").over(running))
        .join(wanted.select(target, "wanted"), target)
        .where((F.col("_upto") >= F.col("wanted")) & (F.col("_upto") - F.col("_n") < F.col("wanted")))
        .select(target, "_bucket", "wanted", (F.col("wanted") - F.col("_upto") + F.col("_n")).alias("_need")),
        "cut",
    )
    inside = Window.partitionBy(target, "_bucket").orderBy("_order")
    ranked = ordered.join(cut_bucket.select(target, "_bucket").distinct(), [target, "_bucket"], "left_semi").withColumn(
        "_rank", F.row_number().over(inside)
    )
    return (
        ranked.join(cut_bucket, [target, "_bucket"])
        .where(F.col("_rank") == F.col("_need"))
        .select(target, "wanted", F.col("_order").alias("cut"))
    )


def under_sample(
    df: DataFrame, keys: Sequence[str], target: str = "is_attack", seed: int = 42
) -> DataFrame:
    """All rows of class 1 and exactly as many of class 0, without replacement.

    No class 1: an empty table. Class 0 not larger: the table unchanged. Rows of neither class
    leave only when sampling takes place. Reads two class counts and one digest on the driver.
    """
    counts = {
        r[target]: r["rows"]
        for r in class_sizes(df, target).where(F.col(target).isin(0, 1)).collect()
    }
    minority, majority = counts.get(1, 0), counts.get(0, 0)
    if minority == 0:
        return df.where(F.lit(False))
    if majority <= minority:
        return df
    spark = df.sparkSession
    zero = df.where(F.col(target) == 0).withColumn(target, F.lit(0))
    wanted = spark.createDataFrame([(0, minority)], f"`{target}` int, wanted bigint")
    cut = hash_cuts(zero, target, keys, seed, wanted).first()["cut"]
    return df.where((F.col(target) == 1) | ((F.col(target) == 0) & (hash_order(keys, seed) <= cut)))


def holdout_sizes(df: DataFrame, target: str, fraction: float = 0.2) -> DataFrame:
    """Rows per class for a hold-out of ceil(fraction * n): proportional, largest remainders first."""
    sizes = class_sizes(df, target)
    everything = Window.partitionBy()
    total = F.sum("rows").over(everything)
    share = F.col("rows") * F.ceil(total * F.lit(fraction)) / total
    by_remainder = Window.orderBy(F.desc("_rest"), F.col(target))
    return (
        sizes.withColumn("_total", F.ceil(total * F.lit(fraction)))
        .withColumn("_base", F.floor(share))
        .withColumn("_rest", F.round(share - F.floor(share), 9))
        .withColumn("_open", F.col("_total") - F.sum("_base").over(everything))
        .withColumn("wanted", F.col("_base") + (F.row_number().over(by_remainder) <= F.col("_open")).cast("int"))
        .select(target, "rows", F.col("wanted").cast("bigint").alias("wanted"))
    )


def stratified_split(
    df: DataFrame,
    keys: Sequence[str],
    target: str = "is_attack",
    fraction: float = 0.2,
    seed: int = 42,
    name: str = "is_test",
) -> DataFrame:
    """Add 1 for hold-out rows, 0 for training rows, each class split in the same proportion."""
    wanted = stored(holdout_sizes(df, target, fraction).where(F.col("wanted") > 0), "wanted")
    cuts = stored(hash_cuts(df, target, keys, seed, wanted).select(F.col(target).alias("_class"), "cut"), "cuts")
    order = hash_order(keys, seed)
    return (
        df.join(cuts, F.col(target).eqNullSafe(F.col("_class")), "left")
        .withColumn(name, F.coalesce((order <= F.col("cut")).cast("int"), F.lit(0)))
        .drop("cut", "_class")
    )


def approximate_split(
    keys: Sequence[str], fraction: float = 0.2, seed: int = 42
) -> Column:
    """Hold-out flag from the digest alone: no pass over the data, sizes only in expectation."""
    bits = F.conv(F.substring(hash_order(keys, seed), 1, 8), 16, 10).cast("bigint")
    return (bits < F.lit(int(fraction * 16**8))).cast("int")


def stratified_folds(
    df: DataFrame,
    keys: Sequence[str],
    target: str = "is_attack",
    k: int = 5,
    seed: int = 42,
    name: str = "fold",
) -> DataFrame:
    """Add a fold number 0..k-1; inside each class fold sizes differ by at most one row.

    A fold is a range of the hash order, so its number is that of the class's k - 1 cuts below a row's
    digest: a comparison on the scan, which moves no row. Rows without a class are a class of their own.
    """
    rows = df.withColumn("_class", F.struct(F.col(target).alias("of")))
    sizes = rows.groupBy("_class").agg(F.count(F.lit(1)).alias("rows"))
    parts = F.explode(F.sequence(F.lit(1), F.lit(k - 1))) if k > 1 else F.explode(F.array().cast("array<int>"))
    wanted = sizes.select("_class", "rows", parts.alias("_j")).select(
        "_class", F.floor(F.col("rows") * F.col("_j") / k).cast("bigint").alias("wanted")
    )
    cuts = hash_cuts(rows, "_class", keys, seed, stored(wanted.where("wanted > 0"), "wanted"))
    lists = cuts.join(wanted, ["_class", "wanted"]).groupBy("_class").agg(F.collect_list("cut").alias("_cuts"))  # k - 1 at most
    none = wanted.groupBy("_class").agg(F.count(F.when(F.col("wanted") == 0, 1)).alias("_empty"))
    sides = stored(none.join(lists, "_class", "left"), "cuts")
    order = hash_order(keys, seed)
    below = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_order"))), F.lit(0))
    numbered = rows.withColumn("_order", order).join(sides, "_class", "left")
    fold = F.coalesce(F.greatest(below, F.lit(0)) + F.col("_empty"), F.lit(0)).cast("int")
    return numbered.withColumn(name, fold).drop("_class", "_order", "_cuts", "_empty")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Square root of the balanced weight, n / (classes * class size), per label."""
    everything = Window.partitionBy()
    return (
        df.groupBy(label)
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn(
            "weight",
            F.sqrt(F.sum("rows").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("rows"))),
        )
    )


def with_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Add the dampened weight of the row's label; 1.0 for a table without labels."""
    if label not in df.columns:
        return df.withColumn(name, F.lit(1.0))
    weights = class_weights(df, label).select(F.col(label).alias("_label"), F.col("weight").alias(name))
    return df.join(stored(weights, "weights"), F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if there are fewer) in a reproducible random choice."""
    everyone = df.withColumn("_all", F.lit(0))
    wanted = df.sparkSession.createDataFrame([(0, n)], "_all int, wanted bigint")
    cut = hash_cuts(everyone, "_all", keys, seed, wanted).first()
    if cut is None:
        return df if n > 0 else df.limit(0)
    return df.where(hash_order(keys, seed) <= cut["cut"])


def stride_sample(
    df: DataFrame, source: str, line: str, batch: int, stride: int
) -> DataFrame:
    """Every stride-th chunk of ``batch`` rows of each source, the first chunk included.

    The rows are ranked by ``line``, which may have gaps; for gapless numbers :func:`stride_lines` is a plain filter.
    """
    chunk = F.floor((F.col("_position") - 1) / batch)
    return (
        position_by_number(df, [source], line, "_position")
        .where(F.pmod(chunk, F.lit(stride)) == 0)
        .drop("_position")
    )


def stride_lines(df: DataFrame, line: str, batch: int, stride: int) -> DataFrame:
    """Every stride-th chunk of ``batch`` lines of each source, where ``line`` counts a source's rows from 1 without gaps.

    :func:`~netsluice.sources.interleave.file_positions` makes such numbers; no row moves.
    """
    chunk = F.floor((F.col(line) - 1) / batch)
    return df.where(F.pmod(chunk, F.lit(stride)) == 0)

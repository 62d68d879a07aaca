"""Class comparisons: means, correlations, histograms, clipped box statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsluice.functions.keys import quoted
from netsluice.functions.numbers import clip_above
from netsluice.functions.text import trimmed
from netsluice.operators.gram import correlation_matrix
from netsluice.operators.quantiles import _value, exact_quantiles, quantile_caps
from netsluice.operators.ranking import top_by_count
from netsluice.session import stored


def class_means(
    df: DataFrame, features: Sequence[str], target: str = "is_attack", classes: Sequence[int] = (0, 1)
) -> DataFrame:
    """Mean of each feature per class: a row per feature, a column per class."""
    wide = df.groupBy(target).agg(*[F.avg(_value(f)).alias(f"m{i}") for i, f in enumerate(features)])
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("mean")) for i, f in enumerate(features)]
    return (
        wide.select(target, F.inline(F.array(*cells)))
        .groupBy("feature")
        .pivot(target, list(classes))
        .agg(F.first("mean"))
        .toDF("feature", *[f"mean_{c}" for c in classes])
    )


def correlations(df: DataFrame, features: Sequence[str], digits: int = 3) -> DataFrame:
    """Pearson coefficients over the rows where both values are present; every ordered pair, by one scan."""
    return correlation_matrix(df, features).select("feature", "other", F.round("r", digits).alias("r"))


def redundant_pairs(df: DataFrame, features: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """Feature pairs whose coefficient reaches the threshold in size, each pair once."""
    rank = {f: i for i, f in enumerate(features)}
    order = F.create_map(*[F.lit(v) for f, i in rank.items() for v in (f, i)])
    first = order[F.col("feature")] < order[F.col("other")]
    return correlations(df, features, 6).where(first & (F.abs("r") >= threshold))


def histogram(df: DataFrame, column: str, target: str, bins: int = 45) -> DataFrame:
    """Equal-width bins between each class's own smallest and largest value, the last one closed.

    Rows (class, bin, low, high, rows); empty bins are included. A class with one single value
    gets a width of 1 around it. Infinite values have no bin and are left out, like null and NaN.
    """
    x = _value(column)
    data = df.select(quoted(target).alias("class"), x.alias("x")).where(
        (F.abs(x) < float("inf")) & F.col("class").isNotNull()
    )
    edges = data.groupBy("class").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    edges = stored(
        edges.select(
            "class",
            F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        ),
        "edges",
    )
    width = (F.col("hi") - F.col("lo")) / bins
    counts = (
        data.join(edges, "class")
        .select("class", F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("class", "bin")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    grid = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, ["class", "bin"], "left").select(
        F.col("class").alias(target),
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def clip_at_quantile(df: DataFrame, column: str, label: str, prob: float = 0.99) -> DataFrame:
    """Cut the column off at its own quantile within each label."""
    caps = stored(quantile_caps(df, column, label, prob).withColumnRenamed(label, "_label"), "caps")
    return (
        df.join(caps, F.col(label).eqNullSafe(F.col("_label")), "left")
        .withColumn(column, clip_above(quoted(column).cast("double"), F.col("cap")))
        .drop("_label", "cap")
    )


def top_label_rows(df: DataFrame, label: str, k: int = 6) -> DataFrame:
    """Rows whose trimmed label is among the k most frequent."""
    top = F.broadcast(top_by_count(df, label, k).select(F.col(label).alias("_label")))  # k rows
    return df.join(top, trimmed(F.col(label)) == F.col("_label"), "left_semi")


def box_stats(df: DataFrame, column: str, label: str, k: int = 6, prob: float = 0.99) -> DataFrame:
    """Quartiles and 1.5-IQR whiskers of the column, clipped at its quantile, for the top labels.

    The two columns of the top labels are written once. Clipping at the cap leaves all ranks below it as they are, and
    makes the others the cap: the quartiles of the clipped values are those of the values, clipped.
    """
    top = top_label_rows(df, label, k).select(trimmed(F.col(label)).alias(label), _value(column).alias(column))
    top = stored(top.where(F.col(column).isNotNull()), "top")
    order = F.col("prob")
    named = {"q1": 0.25, "median": 0.5, "q3": 0.75, "cap": prob}
    found = exact_quantiles(top, [column], list(named.values()), [label]).groupBy(F.col(label).alias("_label")).agg(
        *[F.max(F.when(order == p, F.col("value"))).alias(n) for n, p in named.items()]
    )
    # a quartile between two order statistics of which the upper one is clipped
    x = clip_above(F.col(column), F.col("cap"))
    spread = F.col("q3") - F.col("q1")
    low_fence, high_fence = F.col("q1") - 1.5 * spread, F.col("q3") + 1.5 * spread
    return (
        top.join(F.broadcast(found), F.col(label) == F.col("_label"))  # k rows
        .groupBy(label, "q1", "median", "q3")
        .agg(
            F.count(x).alias("rows"),
            F.min(F.when(x >= low_fence, x)).alias("whisker_low"),
            F.max(F.when(x <= high_fence, x)).alias("whisker_high"),
            F.count(F.when((x < low_fence) | (x > high_fence), 1)).alias("outliers"),
        )
    )

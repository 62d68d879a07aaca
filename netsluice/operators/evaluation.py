"""Classifier quality: counts, rates, reports and the ROC area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsluice.functions.numbers import ratio
from netsluice.operators.ranking import running_totals
from netsluice.session import stored


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("rows"))


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1)).cast("double")


def binary_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: tuple[str, ...] = ()
) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; an empty denominator gives 0."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = df.groupBy(*by).agg(
        _count(y & p).alias("tp"), _count(~y & p).alias("fp"), _count(y & ~p).alias("fn"), _count(~y & ~p).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by,
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(fp, fp + tn).alias("false_positive_rate"),
    )


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    cells = confusion(df, label, prediction)
    true = cells.groupBy(F.col(label).cast("string").alias("class")).agg(
        F.sum("rows").alias("support"),
        F.sum(F.when(F.col(label) == F.col(prediction), F.col("rows")).otherwise(0)).alias("hits"),
    )
    said = cells.groupBy(F.col(prediction).cast("string").alias("class")).agg(F.sum("rows").alias("predicted"))
    both = true.join(said, "class", "full_outer").na.fill(0, ["support", "hits", "predicted"])
    per_class = both.select(
        "class",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
    )
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / total

    averages = per_class.agg(
        total.alias("support"),
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
    )
    blank = F.lit(None).cast("double")
    lines = [
        ("accuracy", blank, blank, F.col("w_recall")),
        ("macro avg", F.col("m_precision"), F.col("m_recall"), F.col("m_f1")),
        ("weighted avg", F.col("w_precision"), F.col("w_recall"), F.col("w_f1")),
    ]
    cells = [
        F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col("support")
        )
        for name, p, r, f in lines
    ]
    return per_class.unionByName(averages.select(F.inline(F.array(*cells))))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null when a class is missing.

    Equal scores are merged first, then each score meets the number of negatives below it.
    """
    merged = df.groupBy(score).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("pos"), F.sum((F.col(label) != 1).cast("bigint")).alias("neg")
    )
    ranked = running_totals(stored(merged, "scores"), [score], {"neg_upto": "neg"})
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.agg(F.when(pairs > 0, wins / pairs).alias("auc"))

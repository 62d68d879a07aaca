"""Scoring of whole tables and streams with a fitted pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsluice import schema
from netsluice.functions.text import outcome_text
from netsluice.operators.boosting import BoostedTrees
from netsluice.operators.features import feature_columns

_FEATURES, _RAW, _PROBABILITY, _PREDICTION = "_features", "_margin", "_probability", "_prediction"


#: What scores flows: a fitted Spark ML pipeline, or histogram-boosted trees.
Model = PipelineModel | BoostedTrees


def model_features(model: Model) -> list[str]:
    """Feature names in the order the model was fitted with."""
    if isinstance(model, BoostedTrees):
        return list(model.features)
    return list(model.stages[0].getInputCols())


def score_flows(
    df: DataFrame, model: Model | None, version: str = schema.MODEL_VERSION, valid: Column | None = None
) -> DataFrame:
    """Add outcome, its confidence, the attack score and the model version to every row.

    ``confidence`` is the probability of the predicted class, ``ml_confidence_score`` that of an
    attack. Without a model, and for rows that are not ``valid``, the outcome is BENIGN with
    confidence 0, a null score, and ``scored_ok`` false.
    """
    if model is None:
        return df.select(
            "*",
            F.lit("BENIGN").alias("is_anomaly"),
            F.lit(0.0).alias("confidence"),
            F.lit(None).cast("double").alias("ml_confidence_score"),
            F.lit(version).alias("ml_model_version"),
            F.lit(False).alias("scored_ok"),
        )
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    columns = feature_columns(df, model_features(model))
    if isinstance(model, BoostedTrees):
        scored = df.select("*", ok.alias("scored_ok"), model.probability(columns).alias(_PROBABILITY))
        p = F.col(_PROBABILITY)
        attack = F.col("scored_ok") & (p > 0.5)
    else:
        classifier = model.stages[-1].copy()
        classifier.setFeaturesCol(_FEATURES).setRawPredictionCol(_RAW)
        classifier.setProbabilityCol(_PROBABILITY).setPredictionCol(_PREDICTION)
        scored = classifier.transform(df.select("*", ok.alias("scored_ok"), array_to_vector(F.array(*columns)).alias(_FEATURES)))
        p = vector_to_array(F.col(_PROBABILITY))[1]
        attack = F.col("scored_ok") & (F.col(_PREDICTION) == 1)
    return scored.select(
        *[F.col(f"`{c}`") for c in df.columns],
        outcome_text(attack).alias("is_anomaly"),
        F.when(~F.col("scored_ok"), 0.0).when(attack, p).otherwise(1 - p).alias("confidence"),
        F.when(F.col("scored_ok"), p).alias("ml_confidence_score"),
        F.lit(version).alias("ml_model_version"),
        "scored_ok",
    )


def scored_records(df: DataFrame, model: Model | None, version: str = schema.MODEL_VERSION) -> DataFrame:
    """Scored rows as they are published: the record, its attack score, version and time."""
    return (
        score_flows(df, model, version)
        .drop("is_anomaly", "confidence")
        .withColumn("detected_at", F.current_timestamp())
    )


def predictions(df: DataFrame, model: Model | None, keys: Sequence[str], valid: Column | None = None) -> DataFrame:
    """Only keys, outcome, confidence and ``scored_ok``."""
    return score_flows(df, model, valid=valid).select(*keys, "is_anomaly", "confidence", "scored_ok")

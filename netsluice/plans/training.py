"""Training: balanced table to weighted boosted trees, cross-validated and tested."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsluice import schema
from netsluice.operators import boosting
from netsluice.operators.boosting import BoostParams
from netsluice.operators.evaluation import binary_metrics, roc_auc
from netsluice.operators.features import prepared_dataset
from netsluice.operators.sampling import stratified_folds, stratified_split, under_sample, with_row_key, with_weights
from netsluice.plans.registry import log_run, save_model
from netsluice.plans.scoring import Model, score_flows
from netsluice.session import shared_folder, stored
from netsluice.sources.files import export_parquet, read_json_lines, read_table


@dataclass(frozen=True)
class TreeParams:
    """Settings of the boosted trees."""

    trees: int = 100
    depth: int = 6
    rate: float = 0.1
    seed: int = 42
    bins: int = 32


def pipeline(params: TreeParams, features: Sequence[str] = tuple(schema.FEATURES)) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    trees = GBTClassifier(
        featuresCol="features",
        labelCol="is_attack",
        weightCol="weight",
        lossType="logistic",
        maxIter=params.trees,
        maxDepth=params.depth,
        stepSize=params.rate,
        seed=params.seed,
        maxBins=params.bins,
        checkpointInterval=10,
    )
    return Pipeline(stages=[assembler, trees])


def fit_model(
    train: DataFrame, params: TreeParams | BoostParams, features: Sequence[str] = tuple(schema.FEATURES), **options
) -> Model:
    """Fit on a training table: with TreeParams Spark ML's trees, with BoostParams histogram-boosted ones."""
    if isinstance(params, BoostParams):
        return boosting.fit(train, features, params=params, **options)
    return pipeline(params, features).fit(train)


def prepare_data(spark: SparkSession, json_lines: str, out: str) -> DataFrame | None:
    """Cleaned JSON lines to the feature table; nothing is written when there is no record."""
    cleaned = read_json_lines(spark, json_lines, schema.CLEAN_SCHEMA)
    if cleaned.isEmpty():
        return None
    export_parquet(prepared_dataset(cleaned), out)
    return spark.read.parquet(out)


def balance_table(
    spark: SparkSession, path: str, out: str, keys: Sequence[str] = (), target: str = "is_attack", seed: int = 42
) -> DataFrame | None:
    """Write the table with both classes equal in size; without attacks nothing is written.

    A table without a key gets one made from its rows first.
    """
    df = spark.read.parquet(path)
    if df.where(F.col(target) == 1).isEmpty():
        return None
    if not keys:
        df, keys = with_row_key(df), ["row_key"]
    export_parquet(under_sample(df, keys, target, seed), out)
    return spark.read.parquet(out)


def training_table(
    df: DataFrame, keys: Sequence[str], test_size: float = 0.2, folds: int = 5, seed: int = 42
) -> DataFrame:
    """Features, target, weight, ``is_test``, and for training rows their ``fold``.

    The features are written once; sizes, cuts of the split and cuts of the folds read key and class from there.
    """
    data = stored(prepared_dataset(df, keep=keys), "prepared")
    data = with_weights(data)
    data = stratified_split(data, keys, "is_attack", test_size, seed)
    data = data.withColumn("_part", F.concat_ws("-", "is_test", "is_attack"))
    return stratified_folds(data, keys, "_part", max(folds, 1), seed).drop("_part")


def _judged(rows: DataFrame, model: Model) -> DataFrame:
    return score_flows(rows, model).withColumn("prediction", (F.col("is_anomaly") == "ATTACK").cast("int"))


def cross_validate(
    train: DataFrame, params: TreeParams | BoostParams, folds: int = 5, features: Sequence[str] = tuple(schema.FEATURES), **options
) -> dict[str, float]:
    """Mean accuracy, precision, recall and F1 over the folds; one fit per fold."""
    rows = []
    for fold in range(folds):
        model = fit_model(train.where(F.col("fold") != fold), params, features, **options)
        held = _judged(train.where(F.col("fold") == fold), model)
        rows.append(binary_metrics(held, "is_attack", "prediction").first())
    names = ["accuracy", "precision", "recall", "f1"]
    return {f"cv_mean_{n}": sum(r[n] for r in rows) / folds for n in names}


def holdout_metrics(test: DataFrame, model: Model) -> dict[str, float]:
    scored = _judged(test, model)
    m = binary_metrics(scored, "is_attack", "prediction").first()
    auc = roc_auc(scored, "is_attack", "ml_confidence_score").first()["auc"]
    return {f"test_{n}": m[n] for n in ("accuracy", "precision", "recall", "f1")} | {
        "test_roc_auc": float("nan") if auc is None else auc
    }


def train_model(
    df: DataFrame,
    keys: Sequence[str],
    params: TreeParams | BoostParams = TreeParams(),
    test_size: float = 0.2,
    folds: int = 5,
    root: str | None = None,
    version: str = schema.MODEL_VERSION,
    features: Sequence[str] = tuple(schema.FEATURES),
    seed: int = 42,
) -> tuple[Model, dict[str, float]]:
    """Fit and evaluate; with ``root`` the model is saved and the run logged there.

    ``keys`` identify rows, so that split and folds come out the same on every run and attempt.
    """
    spark = df.sparkSession
    shared_folder(spark)  # the boosting loop checkpoints there
    data = training_table(df, keys, test_size, folds, getattr(params, "seed", seed)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train = data.where(F.col("is_test") == 0)
        metrics = cross_validate(train, params, folds, features) if folds > 1 else {}
        model = fit_model(train, params, features)
        metrics |= holdout_metrics(data.where(F.col("is_test") == 1), model)
    finally:
        data.unpersist()
    if root:
        path = save_model(spark, model, root, version)
        log_run(spark, root, uuid.uuid4().hex, asdict(params) | {"features": len(features), "weighted": True}, metrics, path)
    return model, metrics


def train_from_path(spark: SparkSession, path: str, keys: Sequence[str] = (), **more) -> tuple[Model, dict[str, float]]:
    """Train on a Parquet or CSV table. Without keys its ``row_key``, as the balanced table has it,
    is used, or one is made from the rows."""
    df = read_table(spark, path)
    if not keys:
        df, keys = df if "row_key" in df.columns else with_row_key(df), ["row_key"]
    return train_model(df, keys, **more)

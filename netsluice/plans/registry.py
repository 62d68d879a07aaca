"""Versioned models and the log of training runs, kept as small tables that several writers may extend at once."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsluice.operators.boosting import BoostedTrees
from netsluice.sources import generations

_STAGES = "version string, path string, stage string, at timestamp"
_RUNS = "run_id string, started timestamp, params map<string,string>, metrics map<string,double>, model_path string"


def _append(spark: SparkSession, path: str, row: tuple, fields: str) -> None:
    generations.append(spark.createDataFrame([row], fields).coalesce(1), path)


def save_model(spark: SparkSession, model: PipelineModel | BoostedTrees, root: str, version: str, stage: str = "None") -> str:
    """Save a model version and enter it in the registry."""
    path = f"{root}/models/{version}"
    if isinstance(model, BoostedTrees):
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)
    _append(spark, f"{root}/registry", (version, path, stage, datetime.now(timezone.utc)), _STAGES)
    return path


def promote(spark: SparkSession, root: str, version: str, stage: str = "Production") -> None:
    """Move a version to a stage; the newest entry counts."""
    _append(spark, f"{root}/registry", (version, f"{root}/models/{version}", stage, datetime.now(timezone.utc)), _STAGES)


def current_version(spark: SparkSession, root: str) -> tuple[str, str] | None:
    """(version, path) of the newest Production entry, else of the newest entry, else nothing."""
    entries = generations.read(spark, f"{root}/registry", _STAGES)
    row = entries.orderBy(F.desc(F.col("stage") == "Production"), F.desc("at")).first()
    return (row["version"], row["path"]) if row else None


def _load(spark: SparkSession, path: str) -> PipelineModel | BoostedTrees:
    """A saved model of either kind: boosted trees have a table of nodes, a pipeline its own folders."""
    try:
        return BoostedTrees.load(spark, path)
    except AnalysisException:
        return PipelineModel.load(path)


def load_model(
    spark: SparkSession, root: str, fallback: str | None = None
) -> tuple[PipelineModel | BoostedTrees | None, str | None]:
    """(model, version): Production, else latest, else the fallback path, else (None, None)."""
    entry = current_version(spark, root)
    for version, path in ([entry] if entry else []) + ([("local", fallback)] if fallback else []):
        try:
            return _load(spark, path), version
        except Exception as e:  # a version that cannot be read gives way to the next choice
            if not any(s in str(e) for s in ("does not exist", "Input path", "PATH_NOT_FOUND", "empty collection")):
                raise
    return None, None


def log_run(
    spark: SparkSession, root: str, run_id: str, params: dict, metrics: dict[str, float], model_path: str | None
) -> None:
    """Append one training run to the ``training_runs`` table."""
    row = (run_id, datetime.now(timezone.utc), {k: str(v) for k, v in params.items()}, metrics, model_path)
    _append(spark, f"{root}/training_runs", row, _RUNS)


def training_runs(spark: SparkSession, root: str) -> DataFrame:
    """The log of training runs."""
    return generations.read(spark, f"{root}/training_runs", _RUNS)

import math

import pytest
from pyspark.sql import functions as F

from netsluice import schema
from netsluice.operators.detections import alerts, batch_summary, by_outcome, clear_detections, append_detections, detection_rows
from netsluice.operators.evaluation import binary_metrics, class_report, roc_auc
from netsluice.operators.metrics import session_kpis
from netsluice.plans import registry
from netsluice.plans.pipeline import clean_table, score_table
from netsluice.plans.scoring import model_features, score_flows
from netsluice.plans.training import TreeParams, balance_table, prepare_data, train_from_path, train_model
from netsluice.quality.report import DataQualityError
from netsluice.sources.files import export_json_lines
from netsluice.streaming.stages import run_scoring, scored_stream

SMALL = TreeParams(trees=2, depth=2)


@pytest.fixture(scope="module")
def flows(spark):
    """Attacks last long; every fifth flow is one."""
    attack = (F.col("id") % 5 == 0).cast("int")
    return spark.range(0, 600, 1, 4).select(
        "id", attack.alias("is_attack"), F.when(attack == 1, "ddos").otherwise("benign").alias("label"),
        (F.col("id") % 40 + attack * 1000).cast("double").alias("flow_duration"),
        (F.col("id") % 7).cast("double").alias("total_fwd_packets"),
    )


@pytest.fixture(scope="module")
def trained(spark, flows, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("models"))
    model, metrics = train_model(flows, ["id"], SMALL, folds=2, root=root)
    return root, model, metrics


def test_training(spark, trained):
    root, model, metrics = trained
    assert metrics["test_accuracy"] == 1.0 and metrics["cv_mean_f1"] == 1.0 and metrics["test_roc_auc"] == 1.0
    assert set(metrics) == {f"cv_mean_{m}" for m in ("accuracy", "precision", "recall", "f1")} | {
        f"test_{m}" for m in ("accuracy", "precision", "recall", "f1", "roc_auc")}
    run = registry.training_runs(spark, root).first()
    assert run.params["trees"] == "2" and run.metrics["test_f1"] == 1.0
    assert model_features(model) == schema.FEATURES


def test_scoring(flows, trained):
    scored = score_flows(flows, trained[1], valid=F.col("id") != 3).orderBy("id").collect()
    attack, benign, invalid = scored[0], scored[1], scored[3]
    assert attack.is_anomaly == "ATTACK" and attack.confidence == attack.ml_confidence_score > 0.5
    assert benign.is_anomaly == "BENIGN" and benign.confidence == pytest.approx(1 - benign.ml_confidence_score)
    assert (invalid.is_anomaly, invalid.confidence, invalid.ml_confidence_score, invalid.scored_ok) == ("BENIGN", 0.0, None, False)
    assert len(scored) == 600 and scored[0].flow_duration == 1000.0


def test_registry(spark, flows, trained, tmp_path):
    root, model, _ = trained
    assert registry.load_model(spark, str(tmp_path / "none")) == (None, None)
    assert registry.load_model(spark, root)[1] == "1.0.0"
    registry.save_model(spark, model, root, "2.0.0")
    assert registry.load_model(spark, root)[1] == "2.0.0"
    registry.promote(spark, root, "1.0.0")
    registry.save_model(spark, model, root, "3.0.0")
    loaded, version = registry.load_model(spark, root)
    assert version == "1.0.0"
    a = score_flows(flows, loaded).agg(F.sum("ml_confidence_score")).first()[0]
    assert a == pytest.approx(score_flows(flows, model).agg(F.sum("ml_confidence_score")).first()[0])
    fallback = registry.load_model(spark, str(tmp_path / "none"), f"{root}/models/2.0.0")
    assert fallback[0] is not None and fallback[1] == "local"


def test_stream_scores_equal_batch_scores(spark, flows, trained, tmp_path):
    source, out, found, check = (str(tmp_path / n) for n in ("in", "out", "alerts", "check"))
    flows.write.parquet(source)
    stream = scored_stream(spark.readStream.schema(flows.schema).parquet(source), trained[1])
    run_scoring(stream, out, found, check).awaitTermination()
    streamed = {r.id: r.ml_confidence_score for r in spark.read.parquet(out).collect()}
    assert streamed == {r.id: r.ml_confidence_score for r in score_flows(flows, trained[1]).collect()}
    assert spark.read.parquet(found).count() == sum(s > 0.8 for s in streamed.values())


def test_prepare_balance_train(spark, flows, tmp_path):
    lines, prepared, balanced = str(tmp_path / "lines"), str(tmp_path / "p"), str(tmp_path / "b.parquet")
    export_json_lines(flows.drop("id"), lines)
    assert prepare_data(spark, lines, prepared).columns == [*schema.FEATURES, "is_attack", "label"]
    counts = balance_table(spark, prepared, balanced).groupBy("is_attack").count().collect()
    assert {r[0]: r[1] for r in counts} == {0: 120, 1: 120}
    _, metrics = train_from_path(spark, balanced, params=SMALL, folds=0)
    assert metrics["test_accuracy"] == 1.0
    none = str(tmp_path / "none")
    flows.where("is_attack = 0").write.parquet(none)
    assert balance_table(spark, none, balanced + "2") is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        train_from_path(spark, str(tmp_path / "absent.parquet"))


def test_clean_and_score_tables(spark, trained, tmp_path):
    raw, cleaned, scored, found = (str(tmp_path / n) for n in ("raw", "cleaned", "scored", "alerts"))
    columns = {f: F.lit(1.0) for f in schema.RAW_FIELDS[:-1]} | {
        "Flow Duration": F.col("id").cast("double") * 10, "Label": F.lit("BENIGN")}
    df = spark.range(200).select([c.alias(n) for n, c in columns.items()])
    df.write.parquet(raw)
    assert clean_table(spark, raw, cleaned) == {"cleaned": 200, "attacks": 0}
    counts = score_table(spark, cleaned, scored, found, trained[1])
    assert counts["scored"] == 200 and counts["alerts"] == alerts(spark.read.parquet(scored)).count()
    df.withColumn("Label", F.lit("odd")).write.mode("overwrite").parquet(raw)
    with pytest.raises(DataQualityError):
        clean_table(spark, raw, cleaned)


def test_published_confusion_matrix(spark):
    """Rates that follow from a published hold-out matrix."""
    cells = [(0, 0, 105226), (0, 1, 6304), (1, 0, 457), (1, 1, 111072)]
    df = spark.createDataFrame(cells, "label int, prediction int, n int").select(
        "label", "prediction", F.explode(F.sequence(F.lit(1), "n"))
    )
    m = binary_metrics(df).first()
    assert [round(m[c], 6) for c in ("accuracy", "precision", "recall", "f1", "false_positive_rate")] == [
        0.969690, 0.946292, 0.995902, 0.970464, 0.056523]
    report = {r["class"]: r for r in class_report(df).collect()}
    assert round(report["0"].precision, 2) == 1.0 and round(report["0"].recall, 2) == 0.94
    assert round(report["macro avg"].f1, 2) == 0.97 and report["accuracy"].support == 223059


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "label int, prediction int, score double")
    assert binary_metrics(empty).first().f1 == 0.0
    assert roc_auc(empty).first().auc is None
    ones = spark.createDataFrame([(1, 1, 0.5)], empty.schema)
    assert roc_auc(ones).first().auc is None
    kpis = session_kpis(empty, F.col("label") == 1, F.col("score"), F.col("score")).first()
    assert tuple(kpis) == (0, 0, 0.0, 0.0, 0.0, 0.0)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.1), (0, 0.4), (1, 0.8), (1, 0.4)], "label int, score double")
    assert roc_auc(df).first().auc == pytest.approx((0.5 + 1 + 1 + 0 + 0.5 + 1) / 6)


def test_outcomes_and_alerts(spark):
    df = spark.createDataFrame(
        [(" attack", 0.81), ("BENIGN", 0.80), (None, math.nan), ("ATTACK", None)], "is_anomaly string, ml_confidence_score double"
    )
    assert by_outcome(df, "attacks").count() == 2 and by_outcome(df, "benign").count() == 2
    assert alerts(df).count() == 1
    assert tuple(batch_summary(df).first()) == (4, 2, 0)


def test_detection_log(spark, tmp_path):
    log = str(tmp_path / "log")
    df = spark.sql("select 7 as id, 'ATTACK' as is_anomaly, 0.9D as confidence, timestamp '2024-01-01' as ts, 1.0D as x")
    rows = detection_rows(df, "Batch", ["id"], "ts", ["x"])
    append_detections(rows, log)
    append_detections(rows, log)
    found = spark.read.parquet(log)
    assert found.count() == 2 and found.select("id").distinct().count() == 1
    clear_detections(rows, log)
    assert spark.read.parquet(log).count() == 0


@pytest.mark.parametrize("name", ["score_flows", "score_flows_pipeline"])
def test_scoring_reads_the_flows_that_training_cleaned(spark, name, monkeypatch):
    from catalog import QUERIES, modelling

    monkeypatch.setattr(modelling, "fit_model", lambda *a, **k: None)
    monkeypatch.setattr(modelling, "save_model", lambda *a: None)
    monkeypatch.setattr(modelling, "load_model", lambda *a: (None, "1.0.0"))
    monkeypatch.setattr(modelling, "pipeline", lambda *a: type("none", (), {"fit": lambda self, df: None})())
    files = QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("events.parquet" in f for f in files)

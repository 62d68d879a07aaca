"""Each test breaks one rule and looks for its name among the failures."""

import json

import pytest
from pyspark.sql import functions as F

from netsluice import schema
from netsluice.quality.records import JsonRecords, TableRecords
from netsluice.quality.report import DataQualityError, collect_report, gate, gate_each
from netsluice.quality.rules import (
    Limits,
    cleaned_rule_results,
    raw_rule_results,
    scored_rule_results,
    unknown_labels,
)


def failures(results):
    return collect_report(results).failures()


# --- raw tables ---------------------------------------------------------------------


def test_good_table_passes(flows):
    report = gate(raw_rule_results(flows(3)))
    assert report.passed and report.failed_rules == 0 and report.total_rules == 12


def test_empty_table(flows):
    names = failures(raw_rule_results(flows(1).limit(0)))
    assert names == ["row_count_minimum", "label_null_rate", "destination_port_null_rate"]


def test_few_columns(spark):
    df = spark.createDataFrame([("tcp", 4.5, " DDoS "), ("udp", None, "PortScan")], "proto string, load double, Label string")
    names = failures(raw_rule_results(df))
    assert names == ["column_count_match", "critical_columns_present", "schema_column_match"]


def test_no_label(flows):
    results = collect_report(raw_rule_results(flows(1).drop("Label")))
    assert "critical_columns_present" in results.failures()
    assert "label_null_rate" not in [r.rule_name for r in results.results]


def test_label_null_rate(flows):
    df = flows(100, Label=lambda i: None if i < 10 else "BENIGN")
    assert failures(raw_rule_results(df)) == ["label_null_rate"]
    assert failures(raw_rule_results(flows(100, Label=lambda i: None if i < 5 else "BENIGN"))) == []


def test_fully_empty_row(flows):
    nothing = flows(1).select([F.lit(None).cast(t).alias(c) for c, t in flows(1).dtypes])
    assert "no_fully_empty_rows" in failures(raw_rule_results(flows(1).union(nothing)))


@pytest.mark.parametrize("port,ok", [(0, True), (65535, True), (99999, False), (-1, False)])
def test_port_range(flows, port, ok):
    names = failures(raw_rule_results(flows(1, **{"Destination Port": port})))
    assert ("port_range_valid" not in names) == ok


def test_unreadable_port_counts_but_null_does_not(flows):
    df = flows(40, types={"Destination Port": "string"}, **{"Destination Port": lambda i: [None, "http"][i] if i < 2 else "80"})
    report = collect_report(raw_rule_results(df))
    rule = next(r for r in report.results if r.rule_name == "port_range_valid")
    assert not rule.passed and rule.details["invalid_count"] == "1"


@pytest.mark.parametrize("label,ok", [("Sinkhole 7", False), ("benign", True), (" DDoS ", True), ("DDOS", False),
                                      ("Web Attack – XSS", True)])
def test_labels(flows, label, ok):
    names = failures(raw_rule_results(flows(1, Label=label)))
    assert ("label_values_valid" not in names) == ok


def test_unknown_label_rows(flows):
    df = flows(5, Label=lambda i: "x" if i < 2 else "BENIGN")
    assert [tuple(r) for r in unknown_labels(df, "Label").collect()] == [("x", 2)]


def test_infinite_values(flows):
    names = failures(raw_rule_results(flows(2, **{"Flow Duration": lambda i: float("inf") if i else float("nan")})))
    assert "no_infinite_values" in names


def test_many_negatives_are_an_error(flows):
    report = collect_report(raw_rule_results(flows(1, **{"Flow Duration": -100.0})))
    assert report.failures() == ["non_negative_numerics"] and not report.passed


def test_few_negatives_warn(flows):
    df = flows(200, **{"Flow Duration": lambda i: -1.0 if i == 0 else 1000.0 + i})
    report = gate(raw_rule_results(df))
    rule = next(r for r in report.results if r.rule_name == "non_negative_numerics")
    assert not rule.passed and rule.severity == "warning" and report.passed


@pytest.mark.parametrize("by_digest", [True, False])
def test_duplicates(flows, by_digest):
    df = flows(10, **{"Flow Duration": 5.0})
    assert failures(raw_rule_results(df, by_digest=by_digest)) == ["duplicate_row_rate"]
    assert failures(raw_rule_results(df, Limits(duplicate_rate=0.9), by_digest=by_digest)) == []


def test_groups_are_judged_apart(flows):
    good, bad = flows(3).withColumn("source", F.lit("a")), flows(3, Label="x").withColumn("source", F.lit("b"))
    results = raw_rule_results(good.union(bad), by=["source"])
    with pytest.raises(DataQualityError) as e:
        gate_each(results, "source")
    assert e.value.report.failures() == ["label_values_valid"]


# --- cleaned records ----------------------------------------------------------------

# a record of ours: the keys that every record needs, and flow figures up to the least number of fields
NEEDED = {"destination_port": 443, "label": "BENIGN"} | {k: 11 for k in schema.CRITICAL_CLEAN if k not in ("destination_port", "label")}
GOOD = NEEDED | {"flow_packets/s": 12.5} | {
    field: 7 * i + 3 for i, field in enumerate(schema.CLEAN_FIELDS[30 : 29 + schema.MIN_RECORD_FIELDS - len(NEEDED)])
}


def records(spark, *rows):
    texts = [(r if isinstance(r, str) else json.dumps(r),) for r in rows]
    return JsonRecords(spark.createDataFrame(texts, "value string"))


def test_good_records(spark):
    report = gate(cleaned_rule_results(records(spark, GOOD, GOOD | {"label": "DoS Hulk"}, "  ")))
    assert report.total_rules == 6 and report.failed_rules == 0


def test_no_records(spark):
    report = collect_report(cleaned_rule_results(JsonRecords(spark.createDataFrame([], "value string"))))
    assert report.failures() == ["record_count_minimum"] and report.total_rules == 1


@pytest.mark.parametrize(
    "row,rule",
    [
        ({"unknown": 1}, "critical_keys_present"),
        (GOOD | {"Destination Port": 80}, "keys_normalized"),
        (GOOD | {"destination_port": 99999}, "port_values_valid"),
        (GOOD | {"destination_port": "80.0"}, "port_values_valid"),
        (GOOD | {"destination_port": [80]}, "port_values_valid"),
        (GOOD | {"label": "nonsense"}, "cleaned_label_values_valid"),
        (GOOD | {"label": 7}, "cleaned_label_values_valid"),
        ({"destination_port": 80, "label": "BENIGN"}, "record_field_count"),
    ],
)
def test_broken_record(spark, row, rule):
    assert rule in failures(cleaned_rule_results(records(spark, GOOD, row)))


@pytest.mark.parametrize(
    "row",
    [
        GOOD | {"destination_port": None},
        GOOD | {"destination_port": 65535.9},
        GOOD | {"destination_port": -0.5},
        GOOD | {"destination_port": " 8_0 "},
        GOOD | {"destination_port": True},
        GOOD | {"label": None},
        GOOD | {"label": 0},
        GOOD | {"label": " dos HULK "},
    ],
)
def test_fine_record(spark, row):
    assert failures(cleaned_rule_results(records(spark, row))) == []


def test_typed_table(spark):
    row = {schema.snake(k): v for k, v in GOOD.items()}
    df = spark.createDataFrame([tuple(row.values())], list(row))
    assert failures(cleaned_rule_results(TableRecords(df))) == []
    wrong = df.withColumn("destination_port", F.lit(70000)).withColumn("label", F.lit("x")).drop("flow_packets_s")
    assert failures(cleaned_rule_results(TableRecords(wrong))) == [
        "port_values_valid", "cleaned_label_values_valid", "record_field_count"
    ]


# --- scored records -----------------------------------------------------------------

ALERT = {"destination_port": 80, "label": "DoS Hulk", "ml_confidence_score": 0.95, "ml_model_version": "v1"}


def test_good_alerts(spark):
    report = gate(scored_rule_results(records(spark, ALERT, ALERT | {"ml_confidence_score": 1.0}), 100))
    assert report.total_rules == 5 and report.failed_rules == 0


def test_no_alerts_pass(spark):
    none = JsonRecords(spark.createDataFrame([], "value string"))
    assert gate(scored_rule_results(none, 100)).total_rules == 2


@pytest.mark.parametrize(
    "change,rule",
    [
        ({"ml_confidence_score": 1.5}, "confidence_range_valid"),
        ({"ml_confidence_score": -0.5}, "confidence_range_valid"),
        ({"ml_confidence_score": None}, "confidence_range_valid"),
        ({"ml_confidence_score": "high"}, "confidence_range_valid"),
        ({"ml_model_version": " "}, "model_version_valid"),
        ({"ml_model_version": 1}, "model_version_valid"),
        ({"ml_confidence_score": 0.5}, "threshold_consistency"),
        ({"ml_confidence_score": 0.8}, "threshold_consistency"),
    ],
)
def test_broken_alert(spark, change, rule):
    assert rule in failures(scored_rule_results(records(spark, ALERT, ALERT | change)))


def test_alert_without_model_fields(spark):
    assert "ml_metadata_present" in failures(scored_rule_results(records(spark, {"label": "x"})))


def test_more_alerts_than_records(spark):
    assert failures(scored_rule_results(records(spark, *[ALERT] * 20), 5)) == ["anomaly_count_plausible"]
    assert failures(scored_rule_results(records(spark, *[ALERT] * 20), 0)) == []


# --- reports ------------------------------------------------------------------------


def test_report_counts_and_text(spark):
    rows = [
        ("stage", 2, "c", "integrity", False, "error", "bad", {"n": "1"}), ("stage", 0, "a", "completeness", True, "error", "fine", None),
        ("stage", 1, "b", "validity", False, "warning", "some", {}),
    ]
    ddl = "stage string, position int, rule_name string, category string, passed boolean, severity string, message string, details map<string,string>"
    results = spark.createDataFrame(rows, ddl)
    mild = collect_report(results.where("rule_name <> 'c'"))
    assert mild.passed and (mild.total_rules, mild.passed_rules, mild.failed_rules) == (2, 1, 1)
    report = collect_report(results)
    text = report.summary()
    assert not report.passed and "FAILED" in text and "1/3" in text and "warn" in text and "integrity/c" in text
    exported = json.loads(report.to_json())
    assert exported["failed_rules"] == 2 and exported["results"][2]["details"] == {"n": "1"}
    assert exported["results"][1]["severity"] == "warning" and report.failures() == ["b", "c"]
    assert str(DataQualityError(report)) == text


def test_gate_sees_what_cleaning_refused(spark):
    from netsluice.operators.clean import clean_records
    from netsluice.quality.records import CleanedRecords

    def failed(*rows):
        texts = [(json.dumps(r),) for r in rows]
        return failures(cleaned_rule_results(CleanedRecords(clean_records(spark.createDataFrame(texts, "value string")))))

    assert failed(GOOD) == []
    assert failed(GOOD, {"Destination Port": "http", "Label": "x"}) == [
        "critical_keys_present", "port_values_valid", "cleaned_label_values_valid", "record_field_count"
    ]
    assert failed(NEEDED) == ["record_field_count"]
    assert failed({"nothing": 1}) == ["critical_keys_present", "record_field_count"]
    assert failed(GOOD | {"Größe!": 1}) == ["keys_normalized"]
    assert failed(GOOD | {"destination_port": 70000}) == ["port_values_valid"]


def test_limits_follow_the_schema():
    assert Limits().duplicate_rate == schema.MAX_DUPLICATE_RATE and len(schema.ALLOWED_LABELS) == 36

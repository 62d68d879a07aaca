import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from check_queries import compare
from netsluice import schema
from netsluice.functions.numbers import coerce_number, log10_from_one, safe_number
from netsluice.functions.text import latin1_to_cp1252, relative_age, value_text
from netsluice.operators.clean import clean_flows, clean_label, clean_records, snake_header, with_normal_keys
from netsluice.operators.features import drop_identifiers, extract_features, prepared_dataset
from netsluice.operators.flows import (
    empty_payloads,
    guess_mapping,
    headers_match,
    parse_flows,
    rejected_flows,
    upload_to_flows,
    valid_flows,
    with_flow_error,
)


def column(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("c"))).collect()]


def test_schema():
    assert len(schema.RAW_FIELDS) == 79 and len(schema.FEATURES) == 33
    assert schema.CLEAN_FIELDS[55] == "fwd_header_length_1" and schema.snake(" Flow Bytes/s") == "flow_bytes_s"


def test_coerce_text(spark):
    values = [None, "", " None ", "NULL", "nan", "-inf", "Infinity", "1e400", "42", " 7.5 ", "1e5", "-1", "1_000", "+.5"]
    assert column(spark, values, lambda c: coerce_number(c, "string")) == [0.0] * 8 + [42.0, 7.5, 1e5, -1.0, 1000.0, 0.5]
    assert column(spark, ["abc", "1d", "0x10", "1__0", "_1", "1 2"], lambda c: coerce_number(c, "string")) == [None] * 6


def test_coerce_numbers(spark):
    values = [None, math.nan, math.inf, -math.inf, -2.5]
    assert column(spark, values, lambda c: coerce_number(c, "double"), "double") == [0.0, 0.0, 0.0, 0.0, -2.5]


def test_safe_number(spark):
    assert column(spark, ["3.5", "", "x", None, "Infinity", "1_0"], safe_number) == [3.5, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_labels(spark):
    values = [
        "Web Attack – XSS", "Web Attack â€“ XSS", "Web Attack � XSS", "Web Attack \x96 XSS", " DDoS ", None, "", "nan",
        "42", "BENIGN", "DoS slowloris", "\t",
    ]
    assert column(spark, values, clean_label) == ["web attack - xss"] * 4 + ["ddos"] + ["benign"] * 5 + [
        "dos slowloris", "benign"
    ]


def test_cp1252(spark):
    assert column(spark, ["Web Attack \x96 XSS", "\x80"], latin1_to_cp1252) == ["Web Attack – XSS", "€"]


def test_log_and_text(spark):
    assert column(spark, [0.0, 100.0, None], log10_from_one, "double") == [0.0, 2.0, None]
    texts = column(spark, [23.0, 0.5, 12345678.5, 0.00012], lambda c: value_text(c, "double"), "double")
    assert texts == ["23", "0.5", "12345678.5", "0.00012"]


def test_relative_age(spark):
    df = spark.sql("select timestamp '2024-01-01 00:00:00' as a, explode(array(0.4, 59.4, 59.5, 3569, 3570, 86400)) as s")
    as_of = F.timestamp_millis((F.unix_millis("a") + F.col("s") * 1000).cast("bigint"))
    ages = [r[0] for r in df.select(relative_age(F.col("a"), as_of)).collect()]
    assert ages == ["0s ago", "59s ago", "1m ago", "59m ago", "1h ago", "24h ago"]


def test_relative_ages_equal_their_sql_after_the_date_and_without_a_time(spark, tmp_path):
    times = ["2024-01-31 00:00:01.499500", "2024-01-31 11:03:04.500769", "2024-01-30 23:59:30.500400", "1960-01-01 00:00:00.000500", None]
    rows = spark.createDataFrame(list(enumerate(times)), "event_id long, t string").selectExpr(
        "event_id", "cast(t as timestamp_ntz) as ts", "1L as user_id", "'view' as event_type", "1.0D as value", "'{\"k\": 7}' as props"
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    df = entry_points.queries()["relative_ages"](spark, str(tmp_path))
    found, wanted = [tuple(r) for r in df.collect()], duck.sql(entry_points.oracle_sql()["relative_ages"])
    assert compare(df.columns, found, wanted.columns, wanted.fetchall()) is None
    assert dict(found)[1] == "-39785s ago"


def test_clean_table(flows):
    df = flows(1, types={f: "string" for f in schema.RAW_FIELDS}, **{
        "Flow Duration": "-1", "Bwd IAT Min": "-1", "Flow Bytes/s": "Infinity", "Label": " DDoS ", "Idle Max": "abc"})
    row = clean_flows(df, report_refused=True).first()
    assert (row.flow_duration, row.bwd_iat_min, row.flow_bytes_s) == (0.0, -1.0, 0.0)
    assert (row.label, row.is_attack, row.idle_max) == ("ddos", 1, None)
    assert [tuple(r) for r in row.refused] == [("idle_max", "abc")] and row.ingested_at is not None


def test_cleaning_is_idempotent(flows):
    once = clean_flows(flows(2, Label="Web Attack – XSS")).drop("is_attack", "ingested_at")
    twice = clean_flows(once).drop("is_attack", "ingested_at")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.select(once.columns).collect()))


def test_last_duplicate_header_wins(spark):
    df = snake_header(spark.createDataFrame([(1, 2)], ["Flow-X", "flow x"]))
    assert df.columns == ["flow_x"] and df.first()[0] == 2


def test_records_with_odd_keys(spark):
    ordered = {f: i for i, f in enumerate(schema.RAW_FIELDS[:-1])} | {"Label": "DDoS"}
    spaced = {" Flow Duration": "-5", "Label": None, " Idle Min ": "7", "extra-key": "e", "flow_duration": 9}
    texts = [(json.dumps(r),) for r in (ordered, spaced, {})]
    rows = clean_records(spark.createDataFrame(texts, "value string").coalesce(1)).collect()
    assert (rows[0].flow_duration, rows[0].idle_min, rows[0].label, rows[0].extra) == (1.0, 77.0, "ddos", {})
    assert (rows[1].flow_duration, rows[1].idle_min, rows[1].label) == (9.0, 7.0, "benign")
    assert rows[1].extra == {"extra_key": "e"} and rows[1].active_max == 0.0
    assert rows[2].flow_duration == 0.0 and rows[2].is_attack == 0


def test_key_with_separator(spark):
    df = spark.createDataFrame([({"A\x01B": "1", " C d": "2"},)], "m map<string,string>")
    assert with_normal_keys(df, "m").first()[0] == {"a\x01b": "1", "c_d": "2"}


def test_features(spark):
    df = spark.createDataFrame([(1.0, math.inf, "x", 1, 5)], "flow_duration double, idle_std double, label string, is_attack int, id int")
    out = extract_features(df)
    assert out.columns == schema.FEATURES
    assert (out.first().flow_duration, out.first().idle_std, out.first().active_std) == (1.0, 0.0, 0.0)
    assert drop_identifiers(df).columns == ["flow_duration", "idle_std", "id"]
    prepared = prepared_dataset(df, keep=["id"])
    assert prepared.columns == ["id", *schema.FEATURES, "is_attack", "label"]
    assert extract_features(df.limit(0)).count() == 0


def test_upload(spark):
    headers = [f.upper().replace("_", " ") for f in schema.FEATURES]
    df = spark.createDataFrame([tuple("1.5" for _ in headers)], headers)
    assert not headers_match(headers) and headers_match([f" {f} " for f in schema.FEATURES])
    assert len(guess_mapping(headers)) == 33
    assert upload_to_flows(df).first().idle_std == 1.5
    with pytest.raises(ValueError, match="idle_std"):
        upload_to_flows(df.drop("IDLE STD"))


def test_flow_json(spark):
    good = {f: 1 for f in schema.FEATURES}
    texts = [good | {"x": "y"}, good | {"fin_flag_count": 1.5}, {k: v for k, v in good.items() if k != "idle_std"},
             good | {"flow_duration": "2.5"}]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(texts)], "i int, value string")
    parsed = parse_flows(df, keep=["i"])
    assert [r.i for r in valid_flows(parsed).orderBy("i").collect()] == [0, 3]
    assert [(r.i, r.bad_fields) for r in rejected_flows(parsed).orderBy("i").collect()] == [
        (1, ["fin_flag_count"]), (2, ["idle_std"])
    ]
    assert parsed.where("i = 0").first().extra == {"x": "y"}
    errors = [r.error for r in with_flow_error(df).orderBy("i").collect()]
    assert errors == [None, None, "no number in: idle_std", "no number in: flow_duration"]


def test_empty_payloads(spark):
    df = spark.createDataFrame([("[]",), ('{"flows": []}',), ('[{"a": 1}]',), ("{}",)], "body string")
    assert sorted(r.body for r in empty_payloads(df).collect()) == ["[]", '{"flows": []}', "{}"]


def test_snake_keys_works_out_each_map_once(spark):
    df = entry_points.queries()["snake_keys"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(") == 1


def test_the_texts_of_a_row_are_searched_together_for_letters(spark):
    """One search a row, not one a cell; a cell with such a letter still is no number, its neighbours still are."""
    names = schema.RAW_FIELDS
    row = ["1"] * (len(names) - 1) + ["BENIGN"]
    rows = [tuple(row[:i] + [t] + row[i + 1 :]) for i, t in ((1, "2d"), (2, "0x1"), (3, "5F"), (4, "7"), (5, None))]
    df = clean_flows(spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)))
    odd = {schema.NUMERIC_FIELDS[1]: None, schema.NUMERIC_FIELDS[2]: None, schema.NUMERIC_FIELDS[3]: None}
    got = [tuple(r) for r in df.select(*schema.NUMERIC_FIELDS[:6]).collect()]
    want = [[1.0] * 6 for _ in rows]
    for i in range(3):
        want[i][i + 1] = odd[schema.NUMERIC_FIELDS[i + 1]]
    want[3][4], want[4][5] = 7.0, 0.0
    assert got == [tuple(w) for w in want]
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = clean_flows(spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)))._jdf.queryExecution()
        assert plan.optimizedPlan().toString().count("[dDfFxX]") < len(names)
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")

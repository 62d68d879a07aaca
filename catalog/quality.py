"""Quality rules, reports and column tests."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from catalog import query, table
from catalog.bindings import PROPS_NUMBER, broken_records, clean_sql, number_sql, raw_flows
from netsluice import schema
from netsluice.operators.clean import clean_flows, clean_records
from netsluice.plans.staging import staging_test_results, stage_network_logs
from netsluice.quality.column_tests import ColumnTest, column_test_results
from netsluice.quality.records import CleanedRecords, JsonRecords, TableRecords
from netsluice.quality.report import collect_report, report_rows
from netsluice.quality.rules import (
    Limits,
    cleaned_rule_results,
    raw_rule_results,
    scored_rule_results,
    unknown_labels,
)
from netsluice.session import stored
from netsluice.sources.files import raw_flow_columns

_PORT = number_sql("destination_port")
_DURATION = number_sql("flow_duration")
_BAD_LABEL = "user_id % 25 = 0"


def _raw(spark, sf_dir, keep=()):
    """Raw flows with some labels unknown and some null."""
    label = (
        F.when(F.expr("event_id % 40 = 0"), F.lit(None))
        .when(F.expr(_BAD_LABEL), F.concat(F.lit("odd "), F.col("event_type")))
        .otherwise(F.col("Label"))
    )
    df = raw_flow_columns(raw_flows(spark, sf_dir, ("event_id", "user_id", "event_type")))
    return df.withColumn("Label", label).select(*keep, *[F.col(f"`{c}`") for c in schema.RAW_FIELDS])


def _shown(results, *by):
    """Verdicts with the one figure each rule is about."""
    figure = F.coalesce(
        *[F.element_at("details", F.lit(k)) for k in (
            "invalid_count", "duplicate_count", "row_count", "column_count", "null_rate",
            "negative_columns", "missing", "missing_columns", "record_count", "anomaly_count")],
    )
    return results.select(*by, "rule_name", "category", "passed", "severity", figure.alias("figure"))


def _raw_sql(group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    by = f"group by {group}" if group else "having count(*) > 0"
    unknown = f"coalesce(event_id % 40 <> 0 and {_BAD_LABEL}, false)"
    rate = "round(avg(case when event_id % 40 = 0 then 1 else 0 end), 6)"
    bad_port = f"count(*) filter (where {_PORT} > 65535)"
    lines = [
        ("row_count_minimum", "completeness", "count(*) > 0", "'error'", "cast(count(*) as varchar)"),
        ("column_count_match", "completeness", "true", "'error'", "'79'"),
        ("critical_columns_present", "completeness", "true", "'error'", "''"),
        ("label_null_rate", "completeness", f"{rate} <= 0.05", "'error'", f"cast({rate} as varchar)"),
        ("no_fully_empty_rows", "completeness", "true", "'error'", "'0'"),
        ("destination_port_null_rate", "completeness", "true", "'error'", "'0.0'"),
        ("port_range_valid", "validity", f"{bad_port} = 0", "'error'", f"cast({bad_port} as varchar)"),
        ("label_values_valid", "validity", f"count(*) filter (where {unknown}) = 0", "'error'",
         f"cast(count(*) filter (where {unknown}) as varchar)"),
        ("no_infinite_values", "validity", "true", "'error'", "'0'"),
        ("non_negative_numerics", "validity", f"count(*) filter (where {_DURATION} < 0) = 0",
         f"case when count(*) filter (where {_DURATION} < 0) between 1 and 0.01 * count(*) then 'warning' else 'error' end",
         f"""case when count(*) filter (where {_DURATION} < 0) = 0 then '' else
             concat('Flow Duration: ', count(*) filter (where {_DURATION} < 0)) end"""),
        ("duplicate_row_rate", "integrity", "true", "'error'", "'0'"),
        ("schema_column_match", "integrity", "true", "'error'", "''"),
    ]
    return " union all ".join(
        f"""select {g}'{n}' as rule_name, '{c}' as category, {p} as passed, {s} as severity, {f} as figure
        from events {by}""" for n, c, p, s, f in lines
    )


@query("dq_raw", _raw_sql())
def dq_raw(spark, sf_dir):
    return _shown(raw_rule_results(_raw(spark, sf_dir)))


@query("dq_raw_padded_headers", _raw_sql())
def dq_raw_padded_headers(spark, sf_dir):
    """Headers with blanks around them are the same headers."""
    df = _raw(spark, sf_dir)
    padded = df.toDF(*[f"{'  ' if i % 2 else ''}{c}{' ' * (i % 3)}" for i, c in enumerate(df.columns)])
    return _shown(raw_rule_results(padded))


def _limits_sql(rate: float) -> str:
    return f"""select rule_name, passed and (rule_name <> 'label_null_rate' or round(try_cast(figure as double), 6) <= {rate}) as passed, severity
        from ({_raw_sql()}) where rule_name in ('label_null_rate', 'non_negative_numerics', 'row_count_minimum')"""


@query("dq_raw_limits", _limits_sql(0.001).replace("and 0.01 * count(*)", "and 0.9 * count(*)"))
def dq_raw_limits(spark, sf_dir):
    """Other thresholds: a null rate of labels that fails, negative values that only warn."""
    results = raw_rule_results(_raw(spark, sf_dir), Limits(null_rate=0.001, negative_rate=0.9))
    return results.where("rule_name in ('label_null_rate', 'non_negative_numerics', 'row_count_minimum')").select("rule_name", "passed", "severity")


@query(
    "dq_report_text",
    f"""with r as ({_raw_sql("event_type")}), c as (select event_type, count(*) filter (where passed) as ok, count(*) as n,
            bool_and(passed or severity <> 'error') as passed from r group by event_type)
    select event_type, 'Quality of raw_csv_validation: ' || case when passed then 'PASSED' else 'FAILED' end as head,
        ok || '/' || n || ' rules passed' as counts from c
    union all select event_type, case when passed then 'ok  ' when severity = 'warning' then 'warn' else 'FAIL' end, category || '/' || rule_name from r""",
)
def dq_report_text(spark, sf_dir):
    """The text and the dictionary of each source's report, line by line; a report is 12 rows."""
    results = stored(raw_rule_results(_raw(spark, sf_dir, ("event_type",)), by=["event_type"]), "results")
    out = []
    for source in [r.event_type for r in results.select("event_type").distinct().collect()]:
        report = collect_report(results.where(F.col("event_type") == source))
        exported = json.loads(report.to_json())
        head, counts, *lines = report.summary().split("\n")
        out.append((source, head, counts.split(", ", 1)[1]))
        for line, rule in zip(lines, exported["results"]):
            mark, rest = line[2:6], line[7:]
            if rest != f"{rule['category']}/{rule['rule_name']}: {rule['message']}":
                raise ValueError(f"text and dictionary differ: {rest}")
            out.append((source, mark, rest.split(": ", 1)[0]))
    return spark.createDataFrame(out, "event_type string, head string, counts string")


@query("dq_raw_per_source", _raw_sql("event_type"))
def dq_raw_per_source(spark, sf_dir):
    return _shown(raw_rule_results(_raw(spark, sf_dir, ("event_type",)), by=["event_type"]), "event_type")


@query(
    "dq_report",
    f"""with r as ({_raw_sql("event_type")})
    select event_type, 'raw_csv_validation' as stage, bool_and(passed or severity <> 'error') as passed,
        cast(count(*) as int) as total_rules, cast(count(*) filter (where passed) as int) as passed_rules,
        cast(count(*) filter (where not passed) as int) as failed_rules
    from r group by event_type""",
)
def dq_report(spark, sf_dir):
    return report_rows(raw_rule_results(_raw(spark, sf_dir, ("event_type",)), by=["event_type"]), ("event_type",))


@query(
    "dq_raw_wrong_table",
    """select 'row_count_minimum' as rule_name, true as passed union all select 'column_count_match', false
    union all select 'critical_columns_present', false union all select 'no_fully_empty_rows', true
    union all select 'no_infinite_values', true union all select 'non_negative_numerics', true
    union all select 'duplicate_row_rate', (select count(*) * 0.95 <= (select count(*) from (select distinct * from lineitem))
        from lineitem)
    union all select 'schema_column_match', false""",
)
def dq_raw_wrong_table(spark, sf_dir):
    """A table that is no flow table: rules of absent columns are left out."""
    return raw_rule_results(table(spark, sf_dir, "lineitem")).select("rule_name", "passed")


@query(
    "unknown_labels",
    f"""select concat('odd ', event_type) as label, count(*) as rows from events
    where event_id % 40 <> 0 and {_BAD_LABEL} group by event_type""",
)
def unknown_label_rows(spark, sf_dir):
    return unknown_labels(_raw(spark, sf_dir), "Label")


def _records(spark, sf_dir):
    """Cleaned records as JSON text with faults. By event_id % 10: 1 has its port in quotes with a
    fraction, 2 a fractional port, 3 no duration, 4 an odd key, 5 an unknown label, 6 two keys only."""
    kind = F.expr("event_id % 10")
    port = F.expr(f"cast({_PORT} as string)")
    port = (
        F.when(kind == 1, F.concat(F.lit('"'), port, F.lit('.0"')))
        .when(kind == 2, F.concat(port, F.lit(".9")))
        .when(kind == 7, F.lit("null"))
        .otherwise(port)
    )
    label = (
        F.when(kind == 5, F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
        .when(kind == 8, F.lit("0"))
        .otherwise(F.lit('" DDoS "'))
    )
    duration = F.when(kind != 3, F.concat(F.lit('"flow_duration": '), F.col("value").cast("string")))
    odd = F.when(kind == 4, F.lit('"Odd Key": 1'))
    rest = [F.lit(f'"{f}": 1') for f in schema.CLEAN_FIELDS[2:9]]
    body = F.concat_ws(
        ", ", F.concat(F.lit('"destination_port": '), port), F.concat(F.lit('"label": '), label), duration, odd, *rest
    )
    text = F.when(kind == 6, F.lit('{"destination_port": 80, "label": "benign"}')).otherwise(
        F.concat(F.lit("{"), body, F.lit("}"))
    )
    return table(spark, sf_dir, "events").select(text.alias("value"))


def _lines(lines: list[tuple[str, str]], source: str) -> str:
    return " union all ".join(
        f"select '{n}' as rule_name, {f} = 0 as passed, cast({f} as varchar) as figure from {source}" for n, f in lines
    )


_BAD_PORT = f"""count(*) filter (where (event_id % 10 = 1) or
    (event_id % 10 not in (1, 6, 7) and {_PORT} > 65535))"""


@query(
    "dq_cleaned",
    "select 'record_count_minimum' as rule_name, true as passed, cast(count(*) as varchar) as figure from events union all "
    + _lines(
        [
            ("critical_keys_present", "count(*) filter (where event_id % 10 in (3, 6))"),
            ("keys_normalized", "count(*) filter (where event_id % 10 = 4)"),
            ("port_values_valid", _BAD_PORT),
            ("cleaned_label_values_valid", "count(*) filter (where event_id % 10 = 5)"),
            ("record_field_count", "count(*) filter (where event_id % 10 in (3, 6))"),
        ],
        "events",
    ),
)
def dq_cleaned(spark, sf_dir):
    return _shown(cleaned_rule_results(JsonRecords(_records(spark, sf_dir)))).select("rule_name", "passed", "figure")


@query(
    "dq_cleaned_table",
    "select 'record_count_minimum' as rule_name, true as passed, cast(count(*) as varchar) as figure from events union all "
    + _lines(
        [
            ("critical_keys_present", "count(*) filter (where false)"),
            ("keys_normalized", "count(*) filter (where false)"),
            ("port_values_valid", f"count(*) filter (where {clean_sql('destination_port')} > 65535)"),
            ("cleaned_label_values_valid", "count(*) filter (where false)"),
            ("record_field_count", "count(*) filter (where false)"),
        ],
        "events",
    ),
)
def dq_cleaned_table(spark, sf_dir):
    cleaned = clean_flows(raw_flows(spark, sf_dir))
    return _shown(cleaned_rule_results(TableRecords(cleaned))).select("rule_name", "passed", "figure")


_CONFIDENCE = f"{PROPS_NUMBER} / 80.0"


def _alerts(spark, sf_dir):
    """Alert records with faults: by event_id % 8: 1 no score, 2 a null score, 3 words for a score,
    4 a blank version, 5 a number for a version, 6 no version."""
    kind = F.expr("event_id % 8")
    score = F.when(kind == 2, F.lit("null")).when(kind == 3, F.lit('"high"')).otherwise(
        F.expr(f"cast({_CONFIDENCE} as string)")
    )
    version = F.when(kind == 4, F.lit('"  "')).when(kind == 5, F.lit("1")).otherwise(F.lit('"1.0.0"'))
    body = F.concat_ws(
        ", ",
        F.lit('"destination_port": 80'),
        F.when(kind != 1, F.concat(F.lit('"ml_confidence_score": '), score)),
        F.when(kind != 6, F.concat(F.lit('"ml_model_version": '), version)),
    )
    return table(spark, sf_dir, "events").select(F.concat(F.lit("{"), body, F.lit("}")).alias("value"))


@query(
    "dq_scored",
    _lines(
        [
            ("ml_metadata_present", "count(*) filter (where event_id % 8 in (1, 6))"),
            ("confidence_range_valid",
             f"count(*) filter (where event_id % 8 in (1, 2, 3) or {_CONFIDENCE} > 1)"),
            ("model_version_valid", "count(*) filter (where event_id % 8 in (4, 5, 6))"),
            ("threshold_consistency",
             f"count(*) filter (where event_id % 8 not in (1, 2, 3) and {_CONFIDENCE} <= 0.8)"),
        ],
        "events",
    )
    + " union all select 'anomaly_count_plausible', false, cast(count(*) as varchar) from events",
)
def dq_scored(spark, sf_dir):
    results = scored_rule_results(JsonRecords(_alerts(spark, sf_dir)), total_processed=5)
    return _shown(results).select("rule_name", "passed", "figure")


@query(
    "column_tests",
    """select 'o_orderkey' as "column", 'unique' as test, 0 as failures, true as passed
    union all select 'o_custkey', 'unique', (select count(*) from
        (select o_custkey from orders group by 1 having count(*) > 1)), false
    union all select 'o_orderdate', 'not_null', 0, true
    union all select 'o_orderstatus', 'accepted_values', count(*), count(*) = 0 from orders where o_orderstatus = 'P'""",
)
def column_tests(spark, sf_dir):
    tests = [
        ColumnTest("o_orderkey", "unique"),
        ColumnTest("o_custkey", "unique"),
        ColumnTest("o_orderdate", "not_null"),
        ColumnTest("o_orderstatus", "accepted_values", ("F", "O")),
    ]
    return column_test_results(table(spark, sf_dir, "orders"), tests)


def _logs(spark, sf_dir):
    return stage_network_logs(
        table(spark, sf_dir, "events").select(
            F.col("event_id").cast("string").alias("id"),
            F.col("event_type").alias("event_name"),
            F.col("ts").alias("event_time"),
            F.concat(F.lit("10.0.0."), F.col("user_id")).alias("source_ip"),
            F.lit("10.0.1.1").alias("destination_ip"),
            F.when(F.expr("event_id % 100 = 0"), F.lit("http")).otherwise(F.expr(f"cast({_PORT} as string)")).alias(
                "destination_port"
            ),
            F.expr("user_id % 3").alias("is_attack"),
        )
    )


@query(
    "staging_logs",
    f"""select event_id as id, event_type as event_name, strftime(ts, '%Y-%m-%d %H:%M:%S') as event_time,
        concat('10.0.0.', user_id) as source_ip,
        case when event_id % 100 = 0 then null else {_PORT} end as destination_port, user_id % 3 as is_attack from events""",
)
def staging_logs(spark, sf_dir):
    return _logs(spark, sf_dir).select(
        "id",
        "event_name",
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"),
        "source_ip",
        "destination_port",
        "is_attack",
    )


@query(
    "staging_tests",
    """select 'id' as "column", 'unique' as test, 0 as failures, true as passed
    union all select 'is_attack', 'accepted_values', count(*), count(*) = 0 from events where user_id % 3 = 2
    union all select 'destination_port', 'not_null', count(*), count(*) = 0 from events where event_id % 100 = 0
    union all select c, 'not_null', 0, true from
        (values ('id'), ('event_name'), ('event_time'), ('source_ip'), ('destination_ip'), ('is_attack')) t(c)""",
)
def staging_tests(spark, sf_dir):
    return staging_test_results(_logs(spark, sf_dir))


@query(
    "dq_cleaned_after_cleaning",
    """with n as (select unnest(['critical_keys_present', 'keys_normalized', 'port_values_valid',
            'cleaned_label_values_valid', 'record_field_count']) as rule_name, unnest([1, 3, 1, 4, 1]) as a, unnest([2, 3, 1, 4, 2]) as b),
        c as (select rule_name, count(*) filter (where event_id % 8 in (a, b)) as invalid from n cross join events group by rule_name)
    select rule_name, invalid = 0 as passed, invalid from c
    union all select 'record_count_minimum', true, null""",
)
def dq_cleaned_after_cleaning(spark, sf_dir):
    """The second gate over cleaned records fails for what was wrong with the records before."""
    cleaned = clean_records(broken_records(spark, sf_dir))
    return cleaned_rule_results(CleanedRecords(cleaned)).select(
        "rule_name", "passed", F.col("details")["invalid_count"].cast("bigint").alias("invalid")
    )

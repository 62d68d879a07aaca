"""Quality rules of the three pipeline stages, each stage compiled to one aggregate.

A rule is a set of named aggregate measures and a verdict over them. All measures of a stage go
into a single ``agg`` (grouped by file where asked), and the one result row is turned into a row
per rule. The raw rules count small whole numbers that each row gives by itself, so equal rows
give equal ones: the rows are grouped by their digest, with their numbers packed into a long, and
copies and measures come from one pass over the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsluice import schema
from netsluice.functions.keys import quoted, row_digest, text_digest, texts_json
from netsluice.functions.numbers import decimal_sql, is_missing, parse_number, sql_name, sql_text
from netsluice.functions.text import SNAKE_KEY, trimmed
from netsluice.quality.records import RecordView

RAW_STAGE = "raw_csv_validation"
CLEAN_STAGE = "cleaned_records_validation"
SCORED_STAGE = "inference_output_validation"
LABEL_RULES = ["label_values_valid", "cleaned_label_values_valid"]


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules."""

    null_rate: float = schema.MAX_NULL_RATE
    duplicate_rate: float = schema.MAX_DUPLICATE_RATE
    negative_rate: float = schema.MAX_NEGATIVE_RATE
    alert_threshold: float = schema.ALERT_THRESHOLD
    record_fields: int = schema.MIN_RECORD_FIELDS


@dataclass(frozen=True)
class Rule:
    """A named check: aggregate measures, and columns over them for verdict and text."""

    name: str
    category: str
    measures: dict[str, Column]
    passed: Column
    message: Column
    details: dict[str, Column] = field(default_factory=dict)
    severity: Column = field(default_factory=lambda: F.lit("error"))
    applies: Column = field(default_factory=lambda: F.lit(True))
    cells: dict[str, tuple[Column, int]] = field(default_factory=dict)  # number of a row, and the largest it can be


def _m(rule: str, measure: str) -> Column:
    return F.col(f"{rule}__{measure}")


def _text(c: Column) -> Column:
    return c.cast("string")


def counting_rule(name: str, category: str, offending: Column, subject: str, **more) -> Rule:
    """Passes when no row (or cell) is offending."""
    n = _m(name, "n")
    return Rule(
        name,
        category,
        {"n": F.coalesce(F.sum(offending.cast("bigint")), F.lit(0))},
        n == 0,
        F.concat(_text(n), F.lit(f" {subject}")),
        {"invalid_count": _text(n)},
        **({"cells": {"n": (offending, 1)}} | more),
    )


def fact_rule(name: str, category: str, passed: bool, message: str, details: dict[str, str]) -> Rule:
    """A verdict that follows from the schema alone."""
    return Rule(
        name, category, {}, F.lit(passed), F.lit(message), {k: F.lit(v) for k, v in details.items()}
    )


def compile_rules(df: DataFrame, stage: str, rules: Sequence[Rule], by: Sequence[str] = ()) -> DataFrame:
    """One aggregate for all rules, then a row per rule in the order given."""
    aggs = [m.alias(f"{r.name}__{k}") for r in rules for k, m in r.measures.items()]
    aggs.append(F.count(F.lit(1)).alias("_rows"))
    return rule_rows(df.groupBy(*by).agg(*aggs), stage, rules, by)


def rule_rows(measured: DataFrame, stage: str, rules: Sequence[Rule], by: Sequence[str] = ()) -> DataFrame:
    """Turn the measured row (one per group) into rule results."""
    cells = []
    for position, r in enumerate(rules):
        details = F.lit(None).cast("map<string,string>")
        if r.details:
            details = F.create_map(*[v for k, c in r.details.items() for v in (F.lit(k), c)])
        cells.append(
            F.struct(
                F.lit(position).alias("position"),
                r.applies.alias("applies"),
                F.lit(r.name).alias("rule_name"),
                F.lit(r.category).alias("category"),
                F.coalesce(r.passed, F.lit(False)).alias("passed"),
                r.severity.alias("severity"),
                r.message.alias("message"),
                details.alias("details"),
            )
        )
    return (
        measured.select(*by, F.lit(stage).alias("stage"), F.inline(F.array(*cells)))
        .where("applies")
        .drop("applies")
    )


def _is_null_rate(name: str, column: str, dtype: str, limit: float) -> Rule:
    rows = _m(name, "rows")
    rate = F.when(rows > 0, _m(name, "nulls") / rows)
    return Rule(
        name,
        "completeness",
        {},
        rate <= limit,  # an empty table has no rate and fails
        F.format_string(f"{column}: null rate %.4f, at most {limit}", rate),
        {"null_rate": _text(F.round(rate, 6)), "threshold": F.lit(str(limit))},
        cells={"rows": (F.lit(1), 1), "nulls": (is_missing(quoted(column), dtype), 1)},
    )


def _as_number(column: str, dtype: str) -> Column:
    name = sql_name(column)
    return F.expr(decimal_sql(name) if dtype == "string" else f"cast({name} as double)")


def _port_outside(number: Column) -> Column:
    low, high = schema.PORT_RANGE
    return F.coalesce(~F.isnan(number) & ((number < low) | (number > high)), F.lit(False))


def _duplicate_rule(limit: float) -> Rule:
    name = "duplicate_row_rate"
    rows, repeats = _m(name, "rows"), _m(name, "repeats")
    rate = repeats / F.greatest(rows, F.lit(1))
    return Rule(
        name,
        "integrity",
        {},
        rate <= limit,
        F.format_string(f"%d repeated rows, rate %.4f, at most {limit}", repeats, rate),
        {"duplicate_count": _text(repeats), "duplicate_rate": _text(F.round(rate, 6))},
        applies=rows > 0,
    )


def _negative_rule(df: DataFrame, columns: Sequence[str], limit: float) -> Rule:
    types = dict(df.dtypes)
    name = "non_negative_numerics"
    numbers: dict[str, tuple[Column, int]] = {"rows": (F.lit(1), 1)}
    for i, c in enumerate(columns):
        # NaN is above every number, so it is not below zero
        number = decimal_sql(sql_name(c)) if types[c] == "string" else sql_name(c)
        numbers[f"c{i}"] = (F.expr(f"{number} < 0"), 1)
    cells = F.expr(" + ".join(["0L", *[f"{name}__c{i}" for i in range(len(columns))]]))
    rate = cells / F.greatest(_m(name, "rows"), F.lit(1))
    counts = [
        F.expr(f"if({name}__c{i} > 0, concat({sql_text(c + ': ')}, {name}__c{i}), null)") for i, c in enumerate(columns)
    ]
    listing = F.concat_ws(", ", *counts)
    return Rule(
        name,
        "validity",
        {},
        cells == 0,
        F.when(cells == 0, F.lit("no negative values")).otherwise(
            F.concat(F.lit("negative values in "), listing, F.format_string(f"; rate %.4f, tolerated {limit}", rate))
        ),
        {
            "negative_columns": listing,
            "negative_rate": _text(F.round(rate, 6)),
            "threshold": F.lit(str(limit)),
        },
        severity=F.when((cells > 0) & (rate <= limit), F.lit("warning")).otherwise(F.lit("error")),
        cells=numbers,
    )


def raw_rules(df: DataFrame, limits: Limits = Limits(), by: Sequence[str] = ()) -> list[Rule]:
    """Rules of a raw flow table; a rule whose column is absent is left out."""
    types = dict(df.dtypes)
    columns = [c for c in df.columns if c not in by]
    rules = []
    rows = _m("row_count_minimum", "n")
    rules.append(
        Rule(
            "row_count_minimum",
            "completeness",
            {},
            rows > 0,
            F.concat(_text(rows), F.lit(" rows")),
            {"row_count": _text(rows)},
            cells={"n": (F.lit(1), 1)},
        )
    )
    expected_count = len(schema.RAW_FIELDS)
    rules.append(
        fact_rule(
            "column_count_match",
            "completeness",
            len(columns) == expected_count,
            f"{len(columns)} columns, expected {expected_count}",
            {"column_count": str(len(columns)), "expected": str(expected_count)},
        )
    )
    absent = [c for c in schema.CRITICAL_RAW if c not in columns]
    rules.append(
        fact_rule(
            "critical_columns_present",
            "completeness",
            not absent,
            f"missing: {', '.join(absent)}" if absent else "none missing",
            {"missing": ", ".join(absent)},
        )
    )
    port, label = schema.CRITICAL_RAW
    if label in columns:
        rules.append(_is_null_rate("label_null_rate", label, types[label], limits.null_rate))
    floating = ("double", "float")
    empty = F.expr(
        " and ".join(
            f"({sql_name(c)} is null{f' or isnan({sql_name(c)})' if types[c] in floating else ''})" for c in columns
        )
    )
    rules.append(counting_rule("no_fully_empty_rows", "completeness", empty, "rows without any value"))
    if port in columns:
        rules.append(_is_null_rate("destination_port_null_rate", port, types[port], limits.null_rate))
        number = _as_number(port, types[port])
        unreadable = ~is_missing(quoted(port), types[port]) & is_missing(number, "double")
        rules.append(
            counting_rule(
                "port_range_valid", "validity", _port_outside(number) | unreadable, "ports outside 0..65535"
            )
        )
    if label in columns:
        # counted only: a smallest or first text would turn the whole pass into a sort by group
        unknown = ~trimmed(_text(quoted(label))).isin(*schema.ALLOWED_LABELS)
        rules.append(
            counting_rule(
                LABEL_RULES[0], "validity", F.coalesce(unknown, F.lit(False)), "rows with unknown labels"
            )
        )
    cells = [f"if(abs({sql_name(c)}) = double('Infinity'), 1, 0)" for c in columns if types[c] in floating]
    infinite = F.expr(" + ".join(["0", *cells]))
    most = {"cells": {"n": (infinite, max(1, len(cells)))}}
    rules.append(counting_rule("no_infinite_values", "validity", infinite, "infinite values", **most))
    rules.append(_negative_rule(df, [c for c in schema.NON_NEGATIVE_RAW if c in columns], limits.negative_rate))
    rules.append(_duplicate_rule(limits.duplicate_rate))
    expected = set(schema.RAW_HEADER)
    missing, extra = sorted(expected - set(columns)), sorted(set(columns) - expected)
    rules.append(
        fact_rule(
            "schema_column_match",
            "integrity",
            not missing,
            f"{len(missing)} expected columns missing, {len(extra)} others",
            {"missing_columns": ", ".join(missing), "extra_columns": ", ".join(extra)},
        )
    )
    return rules


def raw_rule_results(
    df: DataFrame, limits: Limits = Limits(), by: Sequence[str] = (), by_digest: bool = True
) -> DataFrame:
    """Results of the raw-table rules, one row per rule, or per group and rule.

    One pass: equal rows are counted before the shuffle, which carries a digest (or, without
    ``by_digest``, the row itself), a count and the packed numbers.
    """
    df = df.toDF(*[c.strip() for c in df.columns])
    return rule_rows(raw_measures(df, by, by_digest), RAW_STAGE, raw_rules(df, limits, by), by)


def raw_measures(df: DataFrame, by: Sequence[str] = (), by_digest: bool = True) -> DataFrame:
    """The numbers that the raw rules judge, in one row, or a row per group. All of them are counts, which add up."""
    rules = raw_rules(df, Limits(), by)
    places, packed, word, bit = [], [F.lit(0).cast("bigint")], 0, 0
    for r in rules:
        for k, (number, most) in r.cells.items():
            if bit + most.bit_length() > 62:
                packed.append(F.lit(0).cast("bigint"))
                word, bit = word + 1, 0
            value = F.coalesce(number.cast("bigint"), F.lit(0))
            packed[word] = packed[word].bitwiseOR(F.shiftleft(value, bit))
            places.append((f"{r.name}__{k}", word, bit, (1 << most.bit_length()) - 1))
            bit += most.bit_length()
    columns = [c for c in df.columns if c not in by]
    keys, types = [quoted(c) for c in columns], dict(df.dtypes)
    if by_digest and columns and all(types[c] == "string" for c in columns):  # raw files: one text of a row is hashed, not pieces
        df = df.withColumn("_json", texts_json(columns))
        keys = [text_digest(df, columns, "_json").alias("_digest")]
    elif by_digest:
        keys = [row_digest(df, columns).alias("_digest")]
    words = [f"_w{i}" for i in range(len(packed))]
    copies = (
        df.select(*by, *keys, *[p.alias(w) for p, w in zip(packed, words)])
        .groupBy(*by, *(["_digest"] if by_digest else [quoted(c) for c in columns]))
        .agg(F.count(F.lit(1)).alias("_copies"), *[F.first(w).alias(w) for w in words])
    )
    sums = [
        F.coalesce(F.sum(F.col("_copies") * F.shiftright(F.col(f"_w{w}"), bit).bitwiseAND(mask)), F.lit(0)).alias(name)
        for name, w, bit, mask in places
    ]
    rows, kinds = F.coalesce(F.sum("_copies"), F.lit(0)), F.count(F.lit(1))
    return copies.groupBy(*by).agg(
        *sums, rows.alias("duplicate_row_rate__rows"), (rows - kinds).alias("duplicate_row_rate__repeats")
    )


def measure_names(rules: Sequence[Rule]) -> list[str]:
    """The columns of :func:`raw_measures` behind its groups, without planning it."""
    return [f"{r.name}__{k}" for r in rules for k in r.cells] + ["duplicate_row_rate__rows", "duplicate_row_rate__repeats"]


def unknown_labels(df: DataFrame, label: str) -> DataFrame:
    """Every label outside the allowed set, with its rows: the full list behind a failed label rule."""
    value = trimmed(F.col(f"`{label}`").cast("string"))
    return (
        df.where(F.col(f"`{label}`").isNotNull())
        .select(value.alias("label"))
        .where(~F.col("label").isin(*schema.ALLOWED_LABELS))
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def cleaned_rules(records: RecordView, limits: Limits = Limits()) -> list[Rule]:
    """Rules of cleaned records; all but the first are left out when there is no record."""
    count = _m("record_count_minimum", "n")
    some = {"applies": count > 0}
    text, kind = records.text, records.kind
    port, label = "destination_port", "label"
    whole = trimmed(text(port)).rlike(r"^[+-]?\d+(_\d+)*$")
    number = F.when(
        kind(port) == "text",
        F.when(whole, F.replace(trimmed(text(port)), F.lit("_"), F.lit("")).try_cast("double")),
    ).otherwise(text(port).try_cast("double"))
    low, high = schema.PORT_RANGE
    fits = (number > low - 1) & (number < high + 1)  # fractions are cut off towards zero
    bad_port = (
        F.when(kind(port).isin("absent", "null", "boolean"), F.lit(False))
        .when(kind(port) == "nested", F.lit(True))
        .otherwise(~F.coalesce(fits, F.lit(False)))
    )
    zero = kind(label).isin("number", "boolean") & (
        (text(label).try_cast("double") == 0) | (F.lower(text(label)) == "false")
    )
    plain = trimmed(text(label))
    unknown = (
        ~kind(label).isin("absent", "null")
        & ~(plain.isin(*schema.ALLOWED_LABELS) | F.lower(plain).isin(*schema.ALLOWED_LABELS))
        & ~F.coalesce(zero, F.lit(False))
    )
    return [
        Rule(
            "record_count_minimum",
            "completeness",
            {"n": F.count(F.lit(1))},
            count > 0,
            F.concat(_text(count), F.lit(" records")),
            {"record_count": _text(count)},
        ),
        counting_rule(
            "critical_keys_present",
            "completeness",
            ~records.has_keys(schema.CRITICAL_CLEAN),
            "records without a critical key",
            **some,
        ),
        counting_rule(
            "keys_normalized",
            "validity",
            records.any_key(lambda k: ~k.rlike(SNAKE_KEY)),
            "records with a key not in snake case",
            **some,
        ),
        counting_rule("port_values_valid", "validity", bad_port, "ports outside 0..65535", **some),
        counting_rule(LABEL_RULES[1], "validity", unknown, "records with unknown labels", **some),
        counting_rule(
            "record_field_count",
            "integrity",
            records.key_count() < limits.record_fields,
            f"records with fewer than {limits.record_fields} fields",
            **some,
        ),
    ]


def scored_rules(
    records: RecordView, total_processed: Column | None = None, limits: Limits = Limits()
) -> list[Rule]:
    """Rules of the alert records; no alert at all is fine."""
    score, version = "ml_confidence_score", "ml_model_version"
    count = _m("ml_metadata_present", "rows")
    some = {"applies": count > 0}
    number = (
        F.when(records.kind(score) == "text", parse_number(records.text(score)))
        .when(records.kind(score) == "number", records.text(score).try_cast("double"))
        .when(records.kind(score) == "boolean", (F.lower(records.text(score)) == "true").cast("double"))
    )
    inside = (number >= 0) & ((number <= 1) | F.isnan(number))  # NaN is let through
    blank = (records.kind(version) != "text") | (trimmed(records.text(version)) == "")
    low = F.coalesce(number <= limits.alert_threshold, F.lit(False))  # NaN is above
    missing = counting_rule(
        "ml_metadata_present",
        "completeness",
        ~records.has_keys([score, version]),
        "records without score or model version",
    )
    missing.measures["rows"] = F.count(F.lit(1))
    rules = [
        missing,
        counting_rule("confidence_range_valid", "validity", ~F.coalesce(inside, F.lit(False)), "scores outside 0..1", **some),
        counting_rule("model_version_valid", "validity", blank, "records without a model version", **some),
        counting_rule(
            "threshold_consistency", "validity", low, f"scores not above {limits.alert_threshold}", **some
        ),
    ]
    if total_processed is not None:
        rules.append(
            Rule(
                "anomaly_count_plausible",
                "integrity",
                {},
                count <= total_processed,
                F.concat(_text(count), F.lit(" alerts of "), _text(total_processed), F.lit(" records")),
                {"anomaly_count": _text(count), "total_processed": _text(total_processed)},
                applies=total_processed > 0,
            )
        )
    return rules


def cleaned_rule_results(records: RecordView, limits: Limits = Limits()) -> DataFrame:
    return compile_rules(records.df, CLEAN_STAGE, cleaned_rules(records, limits))


def scored_rule_results(
    records: RecordView, total_processed: int | None = None, limits: Limits = Limits()
) -> DataFrame:
    total = None if total_processed is None else F.lit(total_processed)
    return compile_rules(records.df, SCORED_STAGE, scored_rules(records, total, limits))

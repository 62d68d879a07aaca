"""How the driver tables stand in for flow data.

The expressions are plain SQL that Spark and DuckDB read alike, so that the query and its SQL
twin start from the same derived table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import table
from netsluice import schema

PROPS_NUMBER = "cast(regexp_extract(props, '([0-9]+)', 1) as bigint)"

LABEL = (
    "case event_type when 'error' then 'DDoS' when 'signup' then ' PortScan ' "
    "when 'purchase' then 'Web Attack – XSS' else 'BENIGN' end"
)
CLEAN_LABEL = (
    "case event_type when 'error' then 'ddos' when 'signup' then 'portscan' "
    "when 'purchase' then 'web attack - xss' else 'benign' end"
)
IS_ATTACK = "case when event_type in ('error', 'signup', 'purchase') then 1 else 0 end"

_BOUND = {
    "destination_port": "(event_id * 7919) % 70000",
    "flow_duration": "value * 100 - 300",
    "total_fwd_packets": "user_id",
    "total_backward_packets": "user_id % 7",
    "total_length_of_fwd_packets": PROPS_NUMBER,
    "bwd_iat_min": "-(user_id % 3)",
}


def number_sql(field: str) -> str:
    """Value of a cleaned flow field as an expression over ``events``, before clamping."""
    place = schema.NUMERIC_FIELDS.index(field)
    return _BOUND.get(field, f"(user_id * {place + 1} + event_id) % {97 + place}")


def clean_sql(field: str) -> str:
    """Value after cleaning: infinite flow rates and negative clamped fields become 0."""
    value = f"cast({number_sql(field)} as double)"
    if field == "flow_bytes_s":
        return f"case when user_id % 50 = 0 then 0.0 else {value} end"
    if field in schema.NON_NEGATIVE_CLEAN:
        return f"case when {value} < 0 then 0.0 else {value} end"
    return value


def raw_flows(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ("event_id",), by: str | None = None) -> DataFrame:
    """Events as a raw flow table of 79 text columns, with some infinite and negative values.

    Rows that agree in the expression ``by`` lie in one partition, dealt before they are made wide.
    """
    columns = []
    for raw, field in zip(schema.RAW_FIELDS[:-1], schema.NUMERIC_FIELDS):
        text = f"cast({number_sql(field)} as string)"
        if field == "flow_bytes_s":
            text = f"if(user_id % 50 = 0, 'Infinity', {text})"
        columns.append(f"{text} as `{raw}`")
    return spread(table(spark, sf_dir, "events"), by).selectExpr(*keep, *columns, f"{LABEL} as Label")


#: Narrow rows of a task at most, before they are made into wide ones of half a kilobyte.
SPREAD_ROWS = 250_000


def spread(df: DataFrame, by: str | None = None) -> DataFrame:
    """The narrow rows dealt in turn, or by an expression, over the cluster, before they are made into wide ones: a small file is one task.

    The number of tasks, and of files written from them, grows with the table.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SPREAD_ROWS))
    return df.repartition(tasks, *([F.expr(by)] if by else []))


#: How wide records are compressed that a query writes as text and reads again: the names of 79 fields stand in each of them.
LINES_CODEC = "gzip"

#: All numeric flow fields over ``events``, each missing in an eleventh of the rows.
FLOW_NUMBERS = {
    f: f"case when (event_id + {i}) % 11 <> 0 then {clean_sql(f)} end" for i, f in enumerate(schema.NUMERIC_FIELDS)
}


def flow_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "events")).selectExpr("event_id", *[f"{e} as {f}" for f, e in FLOW_NUMBERS.items()])


def broken_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON flow records. By event_id % 8: 1 has but a port that is no number and a label, 2 has neither,
    3 an odd key besides, 4 an unknown label."""
    flows = raw_flows(spark, sf_dir).withColumns(
        {"Destination Port": F.lit("80"), "Label": F.when(F.expr("event_id % 8 = 4"), "nonsense").otherwise(F.col("Label"))}
    )
    names = [c for c in flows.columns if c != "event_id"]
    full = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]))
    odd = F.concat(F.lit('{"odd key!": "1", '), F.substring(full, 2, 1_000_000))
    few = F.concat(F.lit('{"Destination Port": "http", "Label": "BENIGN", "n": '), F.col("event_id"), F.lit("}"))
    kind = F.expr("event_id % 8")
    value = F.when(kind == 1, few).when(kind == 2, F.lit('{"unknown": 1}')).when(kind == 3, odd).otherwise(full)
    return flows.select("event_id", value.alias("value"))


# --- flow payloads ------------------------------------------------------------------


def payload_sql(field: str) -> str:
    """Value of a feature in a JSON flow."""
    if field in schema.INTEGER_FEATURES:
        return f"user_id + {schema.FEATURES.index(field)}"
    return f"value + {schema.FEATURES.index(field)}"


def json_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON flows. By event_id % 10: 0 lacks idle_std, 1 has a fractional packet count,
    2 has words for a duration, 3 a duration in quotes."""
    fields = []
    for f in schema.FEATURES:
        text = f"cast({payload_sql(f)} as string)"
        if f == "idle_std":
            text = f"if(event_id % 10 <> 0, {text}, null)"
        if f == "total_fwd_packets":
            text = f"if(event_id % 10 = 1, '1.5', {text})"
        if f == "flow_duration":
            text = f"""case event_id % 10 when 2 then '"abc"' when 3 then '"12"' else {text} end"""
        fields.append(f"""concat('"{f}": ', {text})""")
    body = f"""concat('{{', concat_ws(', ', {', '.join(fields)}), ', "tag": "x"}}')"""
    return table(spark, sf_dir, "events").selectExpr("event_id", "value", "user_id", f"{body} as value_text")


# --- scored rows --------------------------------------------------------------------

SCORE = f"round(({PROPS_NUMBER} % 100) / 99.0, 4)"
OUTCOME = "case when event_type = 'error' then ' attack' else 'BENIGN' end"
SECONDS = "(user_id % 40) / 100.0"


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored rows: outcome, confidence and seconds taken."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        "value",
        "event_type",
        F.expr(OUTCOME).alias("is_anomaly"),
        F.expr(f"cast({SCORE} as double)").alias("confidence"),
        F.expr(f"cast({SECONDS} as double)").alias("seconds"),
    )


SCORED_SQL = f"""select event_id, ts, user_id, value, event_type, {OUTCOME} as is_anomaly,
    cast({SCORE} as double) as confidence, cast({SECONDS} as double) as seconds from events"""

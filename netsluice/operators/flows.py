"""Flow payloads: header mapping, typed parsing, JSON checks, request shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsluice import schema
from netsluice.functions.keys import quoted
from netsluice.functions.numbers import decimal_sql, finite_sql, sql_name, sql_text


def headers_match(headers: Sequence[str]) -> bool:
    """All feature names occur among the trimmed headers."""
    return set(schema.FEATURES) <= {h.strip() for h in headers}


def guess_mapping(headers: Sequence[str]) -> dict[str, str]:
    """Header to feature name, for headers that equal one after normalisation."""
    mapping = {}
    for h in headers:
        key = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else "_" for c in h.strip().lower())
        if key in schema.FEATURES:
            mapping[h] = key
    return mapping


def unmapped_features(mapping: dict[str, str]) -> list[str]:
    return [f for f in schema.FEATURES if f not in mapping.values()]


def upload_to_flows(df: DataFrame, mapping: dict[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Uploaded text columns as the 33 features, 0 for anything that is no finite number.

    Without a mapping it is guessed; a feature that no header maps to raises.
    """
    mapping = guess_mapping(df.columns) if mapping is None else mapping
    missing = unmapped_features(mapping)
    if missing:
        raise ValueError(f"no column for: {', '.join(missing)}")
    source = {feature: header for header, feature in mapping.items()}
    return df.select(
        *[quoted(k) for k in keep],
        *[
            F.expr(f"{finite_sql(decimal_sql(f'cast({sql_name(source[f])} as string)'))} as {f}")
            for f in schema.FEATURES
        ],
    )


def _flow_type(field: str) -> str:
    return "bigint" if field in schema.INTEGER_FEATURES else "double"


def typed_flows(df: DataFrame, record: str, keep: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The required fields of a text map, typed, then ``bad_fields`` naming those not usable.

    Texts are taken out of the map, then read as numbers, then judged, in one projection each,
    so that no step is repeated for every use of its result.
    """
    kept = [sql_name(c) for c in [*keep, record]]
    texts = df.selectExpr(*kept, *[f"element_at({record}, {sql_text(f)}) as {sql_name(f)}" for f in fields])
    numbers = texts.selectExpr(
        *kept,
        *[
            f"coalesce({decimal_sql(c)}, case lower({c}) when 'true' then 1.0D when 'false' then 0.0D end) as {c}"
            for c in map(sql_name, fields)
        ],
    )
    typed = numbers.selectExpr(
        *kept,
        *[
            f"cast(if({c} = floor({c}), {c}, null) as bigint) as {c}" if f in schema.INTEGER_FEATURES else c
            for f, c in zip(fields, map(sql_name, fields))
        ],
    )
    bad = ", ".join(f"if({sql_name(f)} is null, {sql_text(f)}, null)" for f in fields)
    return typed.selectExpr("*", f"array_compact(array({bad})) as bad_fields")


def parse_flows(
    df: DataFrame, value: str = "value", keep: Sequence[str] = (), fields: Sequence[str] = tuple(schema.FEATURES)
) -> DataFrame:
    """JSON flows to typed columns. ``bad_fields`` is empty for a valid flow; other keys stay in ``extra``."""
    rows = df.select(*keep, F.from_json(value, "map<string,string>").alias("record"))
    return typed_flows(rows, "record", keep, fields).select(
        *keep,
        *fields,
        "bad_fields",
        F.map_filter("record", lambda k, v: ~k.isin(*fields)).alias("extra"),
    )


def valid_flows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.size("bad_fields") == 0).drop("bad_fields")


def rejected_flows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.size("bad_fields") > 0)


def with_flow_error(
    df: DataFrame, value: str = "value", name: str = "error", fields: Sequence[str] = tuple(schema.FEATURES)
) -> DataFrame:
    """Say why a text is no flow: not JSON, not an object, or fields that hold no JSON number
    (the first three by name, then an ellipsis). Null for a proper flow."""
    text = F.col(value)
    strict = T.StructType([T.StructField(f, T.DoubleType()) for f in fields])
    # the parser stops after the first value; inside brackets it has to read all of the text
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    # writing the strict record back leaves out the fields that held no number
    numbers = F.json_object_keys(F.to_json(F.from_json(text, strict)))
    read = df.select(
        "*",
        (whole.isNull() | F.try_variant_get(whole, "$[1]", "variant").isNotNull()).alias("_broken"),
        F.coalesce(numbers, F.array().cast("array<string>")).alias("_numbers"),
    )
    missing = F.col("_missing")
    listed = F.concat(
        F.lit("no number in: "),
        F.concat_ws(", ", F.slice(missing, 1, 3)),
        F.when(F.size(missing) > 3, F.lit("…")).otherwise(F.lit("")),
    )
    error = (
        F.when(F.col("_broken"), F.lit("not JSON"))
        .when(~F.startswith(F.ltrim(text), F.lit("{")), F.lit("not a JSON object"))
        .when(F.size(missing) > 0, listed)
    )
    return (
        read.withColumn("_missing", F.array_except(F.array(*map(F.lit, fields)), F.col("_numbers")))
        .withColumn(name, error)
        .drop("_broken", "_numbers", "_missing")
    )


_RECORDS = "array<map<string,string>>"


def payload_records(body: Column) -> Column:
    """Records of a request: a bare JSON array, or an object holding them under ``flows``."""
    bare = F.startswith(F.ltrim(body), F.lit("["))
    wrapped = F.from_json(body, f"struct<flows:{_RECORDS}>")["flows"]
    return F.when(bare, F.from_json(body, _RECORDS)).otherwise(wrapped)


def explode_payloads(
    df: DataFrame, body: str = "body", keep: Sequence[str] = (), fields: Sequence[str] = tuple(schema.FEATURES)
) -> DataFrame:
    """One typed row per record of each request, with its ``position`` in the request."""
    rows = df.select(*keep, F.posexplode(payload_records(F.col(body))).alias("position", "record"))
    return typed_flows(rows, "record", [*keep, "position"], fields).drop("record")


def empty_payloads(df: DataFrame, body: str = "body") -> DataFrame:
    """Requests without any record; they are errors."""
    return df.where(F.coalesce(F.size(payload_records(F.col(body))), F.lit(0)) <= 0)

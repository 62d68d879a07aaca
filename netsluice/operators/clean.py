"""Cleaning of raw flow tables and of JSON flow records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsluice import schema
from netsluice.functions.keys import quoted
from netsluice.functions.numbers import (
    NOT_A_NUMBER_TEXTS,
    REFUSED,
    SPECIAL_NUMBERS,
    coerce_number,
    decimal_sql,
    finite_sql,
    infinite_to_null,
    parse_number,
    sql_name,
)
from netsluice.functions.text import SNAKE_KEY, WHITESPACE, attack_flag, normal_label, snake_key


def snake_header(df: DataFrame) -> DataFrame:
    """Snake-case the column names; of columns that fall together the last one stays."""
    last = {schema.snake(name): i for i, name in enumerate(df.columns)}
    if len(last) == len(df.columns):
        return df.toDF(*last)
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return numbered.selectExpr(*[f"c{i} as {sql_name(name)}" for name, i in last.items()])


def infinities_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities in floating columns become null."""
    floating = {name for name, dtype in df.dtypes if dtype in ("double", "float")}
    return df.select(
        [infinite_to_null(quoted(c)).alias(c) if c in floating else quoted(c) for c in df.columns]
    )


def clean_label(c: Column) -> Column:
    """Label text to its normal form; text that is a number or stands for none is ``benign``.

    Labels of plain words need no more than lower case.
    """
    words = F.lower(c)
    plain = c.rlike("^[A-Za-z][!-~]*( [!-~]+)*$")
    no_label = words.isin(*NOT_A_NUMBER_TEXTS, *SPECIAL_NUMBERS)
    full = F.when(
        parse_number(c).isNotNull() | F.lower(F.trim(c)).isin(*NOT_A_NUMBER_TEXTS), F.lit("benign")
    ).otherwise(normal_label(c))
    return F.when(no_label, F.lit("benign")).when(plain, words).otherwise(full)


def _numbers(df: DataFrame, columns: list[str], keep: list[str], report_refused: bool) -> DataFrame:
    """Flow columns as finite doubles, clamped where they may not be negative.

    Every text is cast in one projection. A row whose casts are all finite, told by one sum, is
    done; only a row with an odd cell has its texts read again under the full rules.
    """
    types = dict(df.dtypes)
    texts = [c for c in columns if types[c] == "string"]
    place = {c: i for i, c in enumerate(texts)}
    kept = [sql_name(c) for c in keep]
    cast = df.selectExpr(
        *kept,
        *[c if c in place else f"{finite_sql(c)} as {c}" for c in columns],
        *[f"try_cast({c} as double) as _{c}" for c in texts],
        # the texts of a row are searched together for the letters of forms that only Spark's cast takes
        f"concat_ws(',', {', '.join(texts)}) rlike '[dDfFxX]' as _letters" if texts else "false as _letters",
    )
    # 0 * x is 0 for a finite x, NaN for the others, and null for null
    check = F.expr(" + ".join(["0.0D", *[f"0.0D * _{c}" for c in texts]]))
    flagged = cast.withColumn("_odd", F.coalesce(F.col("_letters") | F.isnan(check) | check.isNull(), F.lit(True)))
    read_again = F.transform(F.array(*texts), lambda t: coerce_number(t, "string")) if texts else F.array()
    reread = flagged.withColumn("_again", F.when(F.col("_odd"), read_again))

    out = [*kept]
    for c in columns:
        value = f"if(_odd, get(_again, {place[c]}), _{c})" if c in place else c
        if c in schema.NON_NEGATIVE_CLEAN:
            value = f"if({value} < 0, 0.0D, {value})"
        out.append(f"{value} as {c}")
    if not report_refused:
        return reread.selectExpr(*out)
    if texts:
        named = F.arrays_zip(F.array(*[F.lit(c) for c in texts]), F.array(*texts), "_again")
        bad = F.filter(named, lambda z: z["_again"].isNull())
        listed = F.transform(bad, lambda z: F.struct(z["0"].alias("field"), z["1"].alias("text")))
        refused = F.when(F.col("_odd"), listed).otherwise(F.array())
    else:
        refused = F.array()
    return reread.withColumn("_refused", refused.cast(REFUSED)).selectExpr(*out, "_refused as refused")


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumns({"is_attack": attack_flag(F.col("label")), "ingested_at": F.current_timestamp()})


def clean_flows(df: DataFrame, report_refused: bool = False) -> DataFrame:
    """Cleaned flows from a raw flow table of any header spelling.

    Flow columns become doubles, eight of them clamped at zero; the label is normalised and
    ``is_attack`` and ``ingested_at`` are added. Other columns pass through. Text that is no number
    gives null, whether it is met here or was listed in ``refused`` when the raw table was made. With
    ``report_refused`` the column ``refused`` lists it, also from a table of texts.
    """
    df = snake_header(df)
    if "refused" in df.columns:
        return _with_listed_refusals(df)
    numeric = [c for c in df.columns if c in schema.NUMERIC_FIELDS]
    others = [c for c in df.columns if c not in schema.NUMERIC_FIELDS and c != "label"]
    is_text = dict(df.dtypes).get("label") == "string"
    label = clean_label(F.col("label")) if is_text else F.lit("benign")
    rows = df.select(*others, label.alias("label"), *numeric)
    return _stamped(_numbers(rows, numeric, [*others, "label"], report_refused))


def _with_listed_refusals(df: DataFrame) -> DataFrame:
    """Clean a raw table of numbers, and put null back where its list says that a text was refused."""
    cleaned = clean_flows(df.withColumnRenamed("refused", "_listed"))
    numeric = [c for c in cleaned.columns if c in schema.NUMERIC_FIELDS]
    some = cleaned.withColumn("_fields", F.when(F.size("_listed") > 0, F.transform("_listed", lambda z: z["field"])))
    values = {c: F.expr(f"if(_fields is not null and array_contains(_fields, '{c}'), null, {c})") for c in numeric}
    return some.withColumns(values).withColumnRenamed("_listed", "refused").drop("_fields")


_SEPARATOR = "\x01"


def _normal_keys(keys: Column, pieces: Column) -> Column:
    """Snake-cased keys; key by key only where one of them holds the separator."""
    return F.when(F.size(keys) == 0, keys).when(F.size(pieces) == F.size(keys), pieces).otherwise(
        F.transform(keys, snake_key)
    )


def _snaked_pieces(keys: Column) -> Column:
    """All keys joined, so that each string function runs once per record, and split again."""
    joined = F.concat(F.lit(_SEPARATOR), F.array_join(keys, _SEPARATOR), F.lit(_SEPARATOR))
    blanks = f"[{WHITESPACE}]*"
    snaked = F.translate(
        F.lower(F.regexp_replace(joined, f"{blanks}{_SEPARATOR}{blanks}", _SEPARATOR)), " /-.", "____"
    )
    return F.split(F.substring(snaked, F.lit(2), F.length(snaked) - 2), _SEPARATOR)


def _last_of_each_key(keys: Column, values: Column) -> Column:
    """The map of keys to values; of keys that fall together the last one stays."""
    last_only = F.filter(
        F.arrays_zip(keys, values), lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["_keys"])
    )
    repeated = F.size(F.array_distinct(keys)) < F.size(keys)
    return F.when(repeated, F.map_from_entries(last_only)).otherwise(F.map_from_arrays(keys, values))


def _normal_records(df: DataFrame, record: str, ordered: Column, keep: list[str]) -> DataFrame:
    """``_values`` and ``_ordered`` for records whose keys are as expected, ``_record`` for the rest."""
    steps = df.select(*keep, F.map_keys(record).alias("_keys"), F.map_values(record).alias("_values"))
    steps = steps.select(*keep, "_keys", "_values", F.coalesce(ordered, F.lit(False)).alias("_ordered"))
    rest = ~F.col("_ordered")
    steps = steps.withColumn("_pieces", F.when(rest, _snaked_pieces(F.col("_keys"))))
    steps = steps.withColumn("_keys", F.when(rest, _normal_keys(F.col("_keys"), F.col("_pieces"))))
    record_map = F.when(rest, _last_of_each_key(F.col("_keys"), F.col("_values")))
    return steps.select(*keep, "_values", "_ordered", record_map.alias("_record"))


def with_normal_keys(df: DataFrame, record: str) -> DataFrame:
    """Snake-case the keys of a map column; of keys that fall together the last one stays."""
    others = [c for c in df.columns if c != record]
    return _normal_records(df, record, F.lit(False), others).select(*others, F.col("_record").alias(record))


def clean_records(
    df: DataFrame, value: str = "value", keep: Sequence[str] = (), header: Sequence[str] = tuple(schema.RAW_FIELDS)
) -> DataFrame:
    """Cleaned flows from JSON text records with free-form keys.

    The 78 flow fields come out as doubles: 0.0 where a record lacks the key and null where its
    text is no number, which ``refused`` then lists. ``extra`` keeps every key outside the flow schema,
    so no data is lost. What the gate asks of the record itself stays beside it: ``missing_keys`` of
    the critical ones, ``odd_keys`` that are no snake case even now, and ``field_count``.
    Records with exactly the keys of ``header`` in order, the usual case, are read by position;
    any other record has its keys normalised and looked up.
    """
    fields = schema.CLEAN_FIELDS
    if [schema.snake(h) for h in header] != fields:
        raise ValueError("header is not a spelling of the 79 flow columns")
    parsed = df.select(*keep, F.from_json(F.col(value), "map<string,string>").alias("record"))
    ordered = (F.col("_keys") == F.array(*[F.lit(h) for h in header])) | (
        F.col("_keys") == F.array(*[F.lit(f) for f in fields])
    )
    records = _normal_records(parsed, "record", ordered, list(keep))

    def text(i: int) -> str:
        return f"if(_ordered, get(_values, {i}), element_at(_record, '{fields[i]}'))"

    others = F.map_filter("_record", lambda k, v: ~k.isin(fields))
    empty = F.create_map().cast("map<string,string>")
    none = F.array().cast("array<string>")
    own_keys = F.coalesce(F.map_keys("_record"), none)
    asked = F.array(*[F.lit(k) for k in schema.CRITICAL_CLEAN])
    facts = {
        "missing_keys": F.when(F.col("_ordered"), none).otherwise(F.array_except(asked, own_keys)),
        "odd_keys": F.when(F.col("_ordered"), none).otherwise(F.filter(own_keys, lambda k: ~k.rlike(SNAKE_KEY))),
        "field_count": F.when(F.col("_ordered"), F.lit(len(fields))).otherwise(F.size(own_keys)),
    }
    texts = records.select(
        *keep,
        *[c.alias(name) for name, c in facts.items()],
        clean_label(F.expr(text(len(fields) - 1))).alias("label"),
        F.when(F.col("_ordered"), empty).otherwise(others).alias("extra"),
        *[F.expr(f"{text(i)} as {f}") for i, f in enumerate(schema.NUMERIC_FIELDS)],
    )
    return _stamped(_numbers(texts, schema.NUMERIC_FIELDS, [*keep, "label", "extra", *facts], True))

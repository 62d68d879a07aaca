"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsluice import schema
from netsluice.functions.keys import quoted
from netsluice.functions.numbers import REFUSED, coerce_number, decimal_number, grouped_number, infinite_to_null, sql_name, sql_text
from netsluice.functions.text import latin1_to_cp1252, trimmed

# --- fixed values: texts that mean "missing" in a raw flow file ---------------------
MISSING_TEXTS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
    "Infinity",
    "inf",
    "-inf",
]


def csv_options(encoding: str = "windows-1252") -> dict[str, str]:
    """Reader options of raw flow files.

    Spark no longer decodes Windows-1252; its bytes are read as Latin-1 and put right in the
    label, the only text column.
    """
    charset = "ISO-8859-1" if encoding.lower() in ("windows-1252", "cp1252") else encoding
    return {"header": "true", "encoding": charset, "enforceSchema": "true"}


def raw_flow_columns(df: DataFrame, encoding: str = "windows-1252") -> DataFrame:
    """Missing texts to null, and the label's bytes to the characters meant."""
    missing = ", ".join(sql_text(t) for t in MISSING_TEXTS)
    cells = [
        f"if({c} in ({missing}), null, {c}) as {c}" if name in schema.RAW_FIELDS else c
        for name, c in zip(df.columns, map(sql_name, df.columns))
    ]
    out = df.selectExpr(*cells)
    if encoding.lower() in ("windows-1252", "cp1252"):
        out = out.withColumn("Label", latin1_to_cp1252(F.col("Label")))
    return out


def read_raw_flows(
    spark: SparkSession,
    paths: str | Sequence[str],
    encoding: str = "windows-1252",
    skip_unreadable: bool = False,
    with_position: bool = False,
) -> DataFrame:
    """Raw flow files as 79 text columns, bound by position.

    ``skip_unreadable`` leaves out files that cannot be opened. ``with_position`` adds the file
    (``source``), the offset of the piece of the file (``block``) and an ascending ``line_order``
    within it, from which :func:`file_positions` makes line numbers.
    """
    reader = spark.read.schema(schema.RAW_SCHEMA).options(**csv_options(encoding))
    if skip_unreadable:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    df = reader.csv(paths if isinstance(paths, str) else list(paths))
    if with_position:
        df = df.select(
            F.col("_metadata.file_path").alias("source"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line_order"),
            "*",
        )
    return raw_flow_columns(df, encoding)


def raw_numbers(df: DataFrame) -> DataFrame:
    """Flow columns of a raw table as doubles; missing and infinite values are null.

    Text that is no number is null too, and is listed in ``refused`` as (cleaned field name, text), so
    that cleaning and its gate still see it. Only rows with a cell that a plain cast does not take are
    looked at cell by cell.
    """
    types = dict(df.dtypes)
    texts = [c for c in df.columns if c in schema.RAW_FIELDS[:-1] and types[c] == "string"]
    others = [c for c in df.columns if c not in texts and c != "refused"]
    if not texts:
        return df if "refused" in df.columns else df.withColumn("refused", F.array().cast(REFUSED))
    place = {c: i for i, c in enumerate(texts)}
    named = {c: sql_name(c) for c in texts}
    # the texts of a row are searched together for the letters of forms that only Spark's cast takes
    cast = df.selectExpr(
        *[sql_name(c) for c in others],
        *named.values(),
        *[f"try_cast({n} as double) as _n{i}" for i, n in enumerate(named.values())],
        f"concat_ws(',', {', '.join(named.values())}) rlike '[dDfFxX]' as _letters",
    )
    # 0 * x is 0 for a finite x, NaN for the others, and null where the cast took nothing
    check = F.expr(" + ".join(["0.0D", *[f"if({n} is null, 0.0D, 0.0D * _n{i})" for i, n in enumerate(named.values())]]))
    flagged = cast.withColumn("_odd", F.col("_letters") | F.isnan(check) | check.isNull())
    cells = F.array(*[quoted(c) for c in texts])
    pairs = F.arrays_zip(F.array(*[F.lit(schema.snake(c)) for c in texts]).alias("field"), cells.alias("text"))
    unread = F.filter(pairs, lambda z: coerce_number(z["text"], "string").isNull())
    finite = lambda t: F.coalesce(infinite_to_null(decimal_number(t)), grouped_number(t))
    again = flagged.withColumns(
        {
            "refused": F.when(F.col("_odd"), unread).otherwise(F.array()).cast(REFUSED),
            "_again": F.when(F.col("_odd"), F.transform(cells, finite)),
        }
    )
    return again.selectExpr(
        *[
            sql_name(c) if c not in place else f"if(_odd, get(_again, {place[c]}), _n{place[c]}) as {sql_name(c)}"
            for c in df.columns
            if c != "refused"
        ],
        "refused",
    )


def read_cleaned_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV export of cleaned flows, by the names in its header."""
    types = {f.name: f.dataType for f in schema.CLEAN_SCHEMA.fields}
    header = spark.read.option("header", "true").csv(path).columns
    fields = [T.StructField(c.strip(), types.get(c.strip(), T.StringType())) for c in header]
    return spark.read.schema(T.StructType(fields)).option("header", "true").csv(path)


def json_objects(df: DataFrame, fields: T.StructType, value: str = "value") -> DataFrame:
    """JSON text lines to columns; blank lines are skipped."""
    return (
        df.where(trimmed(F.col(value)) != "")
        .select(F.from_json(value, fields).alias("record"))
        .select("record.*")
    )


def read_json_lines(spark: SparkSession, path: str, fields: T.StructType | None = None) -> DataFrame:
    """JSON-lines files: columns of ``fields``, or the text in ``value`` when key presence matters."""
    lines = spark.read.text(path)
    if fields is None:
        return lines.where(trimmed(F.col("value")) != "")
    return json_objects(lines, fields)


def read_table(spark: SparkSession, path: str, fields: T.StructType | None = None) -> DataFrame:
    """Parquet by its suffix, anything else as CSV with a header; a missing path raises."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", "true")
    return reader.schema(fields).csv(path) if fields else reader.csv(path)


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded CSV as text columns; without a header it is refused."""
    if not path.lower().rstrip("/").endswith(".csv"):
        raise ValueError(f"not a .csv file: {path}")
    df = spark.read.option("header", "true").csv(path)
    if not [c for c in df.columns if c.strip()]:
        raise ValueError(f"no header row in {path}")
    return df


def json_text(df: DataFrame) -> DataFrame:
    """Rows as JSON text in ``value``; null fields stay in the text."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def export_json_lines(df: DataFrame, path: str, append: bool = False, compression: str | None = None) -> bool:
    """Write JSON lines. Without ``append`` earlier output is replaced, but only by some rows.

    Every reader of lines takes files compressed by gzip as well; each is then read by one task.
    Returns whether anything was written.
    """
    options = {"ignoreNullFields": "false"} | ({"compression": compression} if compression else {})
    if append:
        df.write.mode("append").options(**options).json(path)
        return True
    if df.isEmpty():
        return False
    df.write.mode("overwrite").options(**options).json(path)
    return True


def export_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def export_predictions_csv(numbered: DataFrame, path: str) -> None:
    """Scored rows as CSV with the header row,is_anomaly,confidence.

    Numbered rows come range by range, so the files follow one another and each is in row order; no row moves again.
    """
    numbered.select("row", "is_anomaly", "confidence").write.mode("overwrite").option("header", "true").csv(path)

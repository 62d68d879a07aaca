"""File sources and sinks: tables are written to the shared folder and read back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import query, table
from catalog.bindings import SCORED_SQL, clean_sql, raw_flows, scored_events
from netsluice import schema
from netsluice.operators.clean import clean_flows
from netsluice.operators.detections import numbered_results
from netsluice.operators.digest_store import DigestStore
from netsluice.operators.sampling import stride_lines
from netsluice.plans.landing import ingest_landing, ingested
from netsluice.plans.pipeline import file_verdicts, gate_files, ingest_files
from netsluice.quality.ledger import ledger_verdicts, update_ledger
from netsluice.quality.report import DataQualityError, gate_each
from netsluice.session import stored, work_path
from netsluice.sources.files import (
    export_json_lines,
    export_parquet,
    export_predictions_csv,
    read_cleaned_csv,
    read_json_lines,
    read_raw_flows,
    read_table,
    read_upload,
)
from netsluice.sources.interleave import file_positions
from netsluice.sources.landing import admission, admit_landing, landing_changes, list_landing


@query(
    "typed_scan",
    "select o_orderkey, o_orderstatus from orders where o_totalprice > 300000",
)
def typed_scan(spark, sf_dir):
    df = read_table(spark, f"{sf_dir}/orders.parquet")
    return df.where("o_totalprice > 300000").select("o_orderkey", "o_orderstatus")


def _write_raw(spark, sf_dir):
    """Events as raw flow files in Windows-1252; more files for more events."""
    path = work_path(spark, "raw")
    flows = raw_flows(spark, sf_dir, ())
    # the dash is the one character Latin-1 lacks; as the control byte it is the same byte
    label = F.replace(F.col("Label"), F.lit("–"), F.lit("\x96"))
    flows.withColumn("Label", label).write.option("encoding", "ISO-8859-1").option(
        "header", "true"
    ).option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return path


_BY_LABEL = f"""select case event_type when 'error' then 'DDoS' when 'signup' then ' PortScan '
        when 'purchase' then 'Web Attack – XSS' else 'BENIGN' end as label, count(*) as rows,
        count(*) filter (where user_id % 50 <> 0) as rates from events group by 1"""


@query("raw_file_scan", _BY_LABEL)
def raw_file_scan(spark, sf_dir):
    df = read_raw_flows(spark, _write_raw(spark, sf_dir))
    return df.groupBy(F.col("Label").alias("label")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("`Flow Bytes/s`").alias("rates")
    )


_FILE_ROWS = 2_500


@query(
    "file_line_numbers",
    f"""select event_id // {_FILE_ROWS} as file, row_number() over (partition by event_id // {_FILE_ROWS} order by event_id) as line,
        cast(event_id as varchar) as duration from events""",
)
def file_line_numbers(spark, sf_dir):
    """Files of 2,500 flows each, in order of the events; every line's number beside what stands in it."""
    path = work_path(spark, "numbered")
    flows = raw_flows(spark, sf_dir).withColumns(
        {"Flow Duration": F.col("event_id").cast("string"), "file": F.expr(f"event_id div {_FILE_ROWS}")}
    )
    dealt = flows.repartition("file").sortWithinPartitions("file", "event_id").drop("event_id")
    dealt.write.partitionBy("file").option("header", "true").csv(path)
    lines = file_positions(read_raw_flows(spark, f"{path}/file=*", with_position=True))
    file = F.regexp_extract("source", "/file=([0-9]+)/", 1).cast("bigint")
    return lines.select(file.alias("file"), "line", F.col("Flow Duration").alias("duration"))


@query(
    "stride_sample_files",
    f"select event_id, event_id // {_FILE_ROWS} as file from events where event_id % {_FILE_ROWS} // 50 % 3 = 0",
)
def stride_sample_files(spark, sf_dir):
    """Every third chunk of 50 lines of each file: a filter on the lines' numbers."""
    path = work_path(spark, "strided")
    flows = raw_flows(spark, sf_dir).withColumns(
        {"Flow Duration": F.col("event_id").cast("string"), "file": F.expr(f"event_id div {_FILE_ROWS}")}
    )
    dealt = flows.repartition("file").sortWithinPartitions("file", "event_id").drop("event_id")
    dealt.write.partitionBy("file").option("header", "true").csv(path)
    lines = file_positions(read_raw_flows(spark, f"{path}/file=*", with_position=True))
    number = F.col("Flow Duration").cast("bigint").alias("event_id")
    return stride_lines(lines, "line", 50, 3).select(number, F.regexp_extract("source", "/file=([0-9]+)/", 1).cast("bigint").alias("file"))


@query(
    "ingest_files",
    f"""select count(*) as rows, round(sum({clean_sql('flow_duration')}), 2) as duration,
        count(*) filter (where event_type not in ('click', 'view')) as attacks from events""",
)
def ingest(spark, sf_dir):
    out = work_path(spark, "ingested")
    ingest_files(spark, _write_raw(spark, sf_dir), out)
    cleaned = clean_flows(spark.read.parquet(out))
    return cleaned.agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.sum("flow_duration"), 2).alias("duration"),
        F.sum("is_attack").alias("attacks"),
    )


@query(
    "ingest_files_capped",
    """with f as (select event_id, event_id // 2500 as file, event_id % 2500 as line from events),
        o as (select *, row_number() over (order by line // 50, file, line) as place from f)
    select event_id, file from o where place <= 600""",
)
def ingest_capped(spark, sf_dir):
    """Which rows come through: 50 of each file in turn, up to 600 of all."""
    raw, out = work_path(spark, "raw"), work_path(spark, "ingested")
    flows = raw_flows(spark, sf_dir).withColumns(
        {"Flow Duration": F.col("event_id").cast("string"), "file": F.format_string("%06d", F.expr(f"event_id div {_FILE_ROWS}"))}
    )
    dealt = flows.repartition("file").sortWithinPartitions("file", "event_id").drop("event_id")
    dealt.write.partitionBy("file").option("header", "true").csv(raw)
    ingest_files(spark, f"{raw}/file=*", out, batch=50, max_records=600)
    number = F.col("Flow Duration").cast("bigint")
    return spark.read.parquet(out).select(number.alias("event_id"), F.floor(number / _FILE_ROWS).alias("file"))


@query(
    "json_lines_export",
    "select event_type, count(*) as rows, round(sum(value), 2) as total from events group by event_type",
)
def json_lines_export(spark, sf_dir):
    path = work_path(spark, "lines")
    df = table(spark, sf_dir, "events").select("event_type", "value")
    export_json_lines(df, path)
    export_json_lines(df.limit(0), path)  # no rows: what is there stays
    return read_json_lines(spark, path, df.schema).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("total")
    )


@query("parquet_export", "select o_orderkey, o_totalprice from orders")
def parquet_export(spark, sf_dir):
    path = work_path(spark, "orders") + ".parquet"
    export_parquet(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), path)
    return read_table(spark, path)


@query(
    "predictions_csv",
    f"""with s as ({SCORED_SQL}) select cast(row_number() over (order by event_id) as varchar) as row, is_anomaly,
        round(confidence, 4) as confidence from s""",
)
def predictions_csv(spark, sf_dir):
    path = work_path(spark, "predictions") + ".csv"
    df = scored_events(spark, sf_dir).withColumn("is_anomaly", F.trim("is_anomaly"))
    export_predictions_csv(numbered_results(df, ["event_id"]), path)
    back = read_upload(spark, path)
    return back.select(
        "row",
        F.when(F.col("is_anomaly") == "attack", " attack").otherwise(F.col("is_anomaly")).alias("is_anomaly"),
        F.round(F.col("confidence").cast("double"), 4).alias("confidence"),
    )


@query(
    "cleaned_csv_scan",
    f"select {clean_sql('flow_duration')} as flow_duration, {clean_sql('bwd_iat_min')} as bwd_iat_min from events",
)
def cleaned_csv_scan(spark, sf_dir):
    path = work_path(spark, "cleaned") + ".csv"
    clean_flows(raw_flows(spark, sf_dir, ())).drop("ingested_at").write.option("header", "true").csv(path)
    return read_cleaned_csv(spark, path).select("flow_duration", "bwd_iat_min")



def write_files(rows: DataFrame, folder: str) -> int:
    """Write each row (name, content) as a file of the folder; returns how many. A second attempt writes the same bytes."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(inner, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                with store.open_output_stream(f"{inner}/{name}", compression=None) as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return rows.select("name", "content").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


_PAGE_FILES = "select page_id, case when page_id % 4 = 0 then chr(9) || chr(10) || html when page_id % 4 = 1 then 'x,y' || chr(10) || html else html end as content from pages"


@query(
    "landing_folder",
    f"""with f as ({_PAGE_FILES}), h as (select page_id, strlen(content) as length, lower(ltrim(left(content, 512), ' ' || chr(9) || chr(10))) as head from f)
    select page_id, length, length >= 2000 and not (starts_with(head, '<!doctype') or starts_with(head, '<html')) as admitted,
        case when length < 2000 then 'too small' when starts_with(head, '<!doctype') or starts_with(head, '<html') then 'html page' end as reason,
        case when page_id % 3 = 0 then 'added' end as change from h""",
)
def landing_folder(spark, sf_dir):
    """Pages as files of a real folder: what is let in by its first bytes, and what came since an earlier listing."""
    path = work_path(spark, "landing")
    content = (
        F.when(F.expr("page_id % 4 = 0"), F.concat(F.lit("\t\n"), "html"))
        .when(F.expr("page_id % 4 = 1"), F.concat(F.lit("x,y\n"), "html"))
        .otherwise(F.col("html"))
    )
    pages = table(spark, sf_dir, "pages").select("page_id", F.encode(content, "UTF-8").alias("content"))
    write_files(pages.where("page_id % 3 <> 0").select(F.concat("page_id", F.lit(".csv")).alias("name"), "content"), path)
    before = stored(list_landing(spark, path), "listing")  # the state that an earlier run kept
    write_files(pages.where("page_id % 3 = 0").select(F.concat("page_id", F.lit(".csv")).alias("name"), "content"), path)
    number = F.regexp_extract("name", r"^(\d+)", 1).cast("bigint")
    changes = landing_changes(list_landing(spark, path), before)
    return admit_landing(spark, path, min_bytes=2_000).join(changes, "name", "left").select(
        number.alias("page_id"), "length", "admitted", "reason", "change"
    )


def _deliver(spark, flows, folder, days):
    """Flows as landing files of 2,500 rows each, of some days only."""
    dealt = flows.where(days).repartition("file").sortWithinPartitions("file", "number")
    lines = dealt.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("number", "line"))).alias("rows"))  # 2,500 at most
    header = ",".join(schema.RAW_FIELDS)
    text = F.concat(F.lit(header + "\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n"))
    write_files(lines.select(F.concat(F.lit("f"), "file", F.lit(".csv")).alias("name"), F.encode(text, "UTF-8").alias("content")), folder)


def _landing_flows(spark, sf_dir):
    flows = raw_flows(spark, sf_dir).withColumns({"Flow Duration": F.col("event_id").cast("string"), "Label": F.lit("BENIGN")})
    cells = F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in schema.RAW_FIELDS])
    return flows.select(F.expr(f"event_id div {_FILE_ROWS}").alias("file"), F.col("event_id").alias("number"), cells.alias("line"))


@query(
    "landing_exactly_once",
    f"""select event_id, event_id // {_FILE_ROWS} as file, case when event_id // {_FILE_ROWS} % 2 = 0 then 1 else 2 end as generation from events""",
)
def landing_exactly_once(spark, sf_dir):
    """Half of the files come, then the others; a run between fails at its gate, the one after it takes each file once."""
    folder, root, flows = work_path(spark, "landing"), work_path(spark, "raw"), _landing_flows(spark, sf_dir)
    _deliver(spark, flows, folder, "file % 2 = 0")
    ingest_landing(spark, folder, root, min_bytes=10)
    _deliver(spark, flows, folder, "file % 2 = 1")

    def refuse(rows):
        raise InterruptedError(f"{rows.count()} rows are not committed")

    try:
        ingest_landing(spark, folder, root, min_bytes=10, check=refuse)
    except InterruptedError:
        pass
    ingest_landing(spark, folder, root, min_bytes=10)
    ingest_landing(spark, folder, root, min_bytes=10)
    number = F.col("Flow Duration").cast("bigint")
    first = ingested(spark, root, upto=1).select(number.alias("event_id"), F.lit(1).alias("generation"))
    rows = ingested(spark, root).select(number.alias("event_id"), F.regexp_extract("source_name", "([0-9]+)", 1).cast("bigint").alias("file"))
    return rows.join(first, "event_id", "left").withColumn("generation", F.coalesce("generation", F.lit(2)))


@query(
    "gate_ledger",
    f"""with f as (select event_id // {_FILE_ROWS} as file, count(*) as n, count(*) filter (where event_id % 3 = 0 and event_id // {_FILE_ROWS} % 2 = 1) as http
        from events group by 1),
        r as (select unnest(['row_count_minimum', 'column_count_match', 'critical_columns_present', 'label_null_rate',
            'no_fully_empty_rows', 'destination_port_null_rate', 'port_range_valid', 'label_values_valid', 'no_infinite_values',
            'non_negative_numerics', 'duplicate_row_rate', 'schema_column_match']) as rule_name)
    select cast(file as varchar) as file, rule_name, rule_name <> 'port_range_valid' or http = 0 as passed,
        case rule_name when 'port_range_valid' then http when 'row_count_minimum' then n end as figure from f cross join r
    union all select 'all', rule_name, rule_name <> 'port_range_valid' or sum(http) = 0,
        case rule_name when 'port_range_valid' then sum(http) when 'row_count_minimum' then sum(n) end from f cross join r group by rule_name""",
)
def gate_ledger(spark, sf_dir):
    """Files measured in two runs, judged one by one and all together from the counts that were kept."""
    folder, root = work_path(spark, "gated"), work_path(spark, "ledger")
    flows = raw_flows(spark, sf_dir, by=f"event_id div {_FILE_ROWS}").withColumns(
        {
            "file": F.expr(f"event_id div {_FILE_ROWS}"), "Flow Duration": F.col("event_id").cast("string"), "Label": F.lit("BENIGN"),
            "Destination Port": F.when(F.expr(f"event_id % 3 = 0 and event_id div {_FILE_ROWS} % 2 = 1"), "http").otherwise(F.lit("80")),
        }
    ).drop("event_id")
    for part in ("file % 2 = 0", "file % 2 = 1"):
        flows.where(part).write.mode("append").partitionBy("file").option("header", "true").csv(folder)
        update_ledger(spark, f"{folder}/file=*", root)
    each = ledger_verdicts(spark, f"{folder}/file=*", root).withColumn("file", F.regexp_extract("source", "/file=([0-9]+)/", 1))
    everything = ledger_verdicts(spark, f"{folder}/file=*", root, "all").withColumn("file", F.lit("all"))
    figure = F.coalesce(F.col("details")["invalid_count"], F.col("details")["row_count"]).cast("bigint")
    figure = F.when(F.col("rule_name").isin("port_range_valid", "row_count_minimum"), figure)
    return each.unionByName(everything, allowMissingColumns=True).select("file", "rule_name", "passed", figure.alias("figure"))


@query(
    "duplicates_between_ingests",
    """with t as (select i, user_id % 50 as a, event_type as b from events, range(4) r(i) where event_id % 4 <= i and (i < 3 or event_id % 2 = 0)),
        k as (select i, a, b, count(*) as n from t group by all),
        s as (select *, exists (select 1 from k p where p.i < k.i and p.a = k.a and p.b = k.b) as seen from k)
    select i as ingest, cast(sum(n) as bigint) as rows, cast(sum(n - 1) as bigint) as repeats,
        cast(coalesce(sum(n) filter (where seen), 0) as bigint) as seen_before from s group by i""",
)
def duplicates_between_ingests(spark, sf_dir):
    """Rows of four ingests that were in an earlier one, by the digests that were kept of it; the second is run twice."""
    store = DigestStore(spark, work_path(spark, "digests"), buckets=8).open()
    events = table(spark, sf_dir, "events")
    out = []
    for i in (0, 1, 1, 2, 3):
        part = events.where(f"event_id % 4 <= {i}" + (" and event_id % 2 = 0" if i == 3 else ""))
        found = store.add(part.select(F.expr("user_id % 50").alias("a"), F.col("event_type").alias("b")), str(i))
        out.append((i, found["rows"], found["repeats"], found["seen_before"]))
    spark.sql(f"drop table {store.table}")
    return spark.createDataFrame(sorted(set(out)), "ingest long, rows long, repeats long, seen_before long")


@query(
    "landing_changes",
    """select cast(doc_id as varchar) as name, case when doc_id % 5 = 0 then 'added' when doc_id % 5 = 1 then 'removed'
        else 'changed' end as change from documents where doc_id % 5 in (0, 1, 2, 3)""",
)
def changes(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("name"), F.lit(1).alias("modified"), F.col("n_chars").alias("length")
    )
    part = F.expr("doc_id % 5")
    last = (
        files.where(part != 0)
        .withColumn("length", F.when(part == 2, F.col("length") + 1).otherwise(F.col("length")))
        .withColumn("modified", F.when(part == 3, 0).otherwise(F.col("modified")))
    )
    return landing_changes(files.where(part != 1), last)


@query(
    "html_admission",
    """with f as (select concat('p', page_id) as name, strlen(html) as length, html as content from pages
        union all select concat('d', doc_id), strlen(text), text from documents)
    select name, length >= 2000 and not (starts_with(lower(ltrim(left(content, 512))), '<!doctype')
        or starts_with(lower(ltrim(left(content, 512))), '<html')) as admitted,
        case when length < 2000 then 'too small' when starts_with(lower(ltrim(left(content, 512))), '<!doctype')
        or starts_with(lower(ltrim(left(content, 512))), '<html') then 'html page' end as reason from f""",
)
def html_admission(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("name"), F.col("html").cast("binary").alias("content")
    )
    texts = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("name"), F.col("text").cast("binary").alias("content")
    )
    files = pages.unionByName(texts).withColumn("length", F.octet_length("content").cast("bigint"))
    return admission(files, 2_000).select("name", "admitted", "reason")


@query("gate_files", f"select count(*) as rows, {len(schema.RAW_FIELDS)} as columns from events")
def gated_files(spark, sf_dir):
    """Gate all files in one job, then read them."""
    path = work_path(spark, "gated")
    good = raw_flows(spark, sf_dir, ()).withColumns({"Destination Port": F.lit("80"), "Flow Duration": F.lit("5")})
    good.withColumn("Label", F.trim(F.replace(F.col("Label"), F.lit("–"), F.lit("-")))).write.option("header", "true").csv(path)
    # the driver tables repeat flows once ports and durations are levelled; that is not at issue here
    try:
        gate_files(spark, path)
    except DataQualityError as e:
        if e.report.failures() != ["duplicate_row_rate"]:
            raise
    df = read_raw_flows(spark, path)
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


@query(
    "gate_outcome",
    """with f as (select 'good' as file, 0 as odd, 0 as http union all
            select 'bad', (select count(*) from events where event_id % 2 = 0), (select count(*) from events where event_id % 3 = 0)),
        r as (select unnest(['row_count_minimum', 'column_count_match', 'critical_columns_present', 'label_null_rate',
            'no_fully_empty_rows', 'destination_port_null_rate', 'port_range_valid', 'label_values_valid', 'no_infinite_values',
            'non_negative_numerics', 'duplicate_row_rate', 'schema_column_match']) as rule_name)
    select file, rule_name, case rule_name when 'port_range_valid' then http = 0 when 'label_values_valid' then odd = 0
        else true end as passed, case rule_name when 'port_range_valid' then http when 'label_values_valid' then odd end as invalid,
        case when file = 'bad' and rule_name in ('port_range_valid', 'label_values_valid') then 1 else 0 end as stopped
    from f cross join r""",
)
def gate_outcome(spark, sf_dir):
    """A good and a bad folder of raw files, the verdict on each rule, and the rules for which the gate stopped."""
    path = work_path(spark, "outcome")
    good = raw_flows(spark, sf_dir).withColumns(
        {"Destination Port": F.lit("80"), "Flow Duration": F.col("event_id").cast("string"), "Label": F.lit("BENIGN")}
    )
    bad = good.withColumns(
        {
            "Label": F.when(F.col("event_id") % 2 == 0, "odd").otherwise(F.col("Label")),
            "Destination Port": F.when(F.col("event_id") % 3 == 0, "http").otherwise(F.col("Destination Port")),
        }
    )
    for name, df in (("good", good), ("bad", bad)):
        df.drop("event_id").write.option("header", "true").csv(f"{path}/{name}")
    paths = [f"{path}/good", f"{path}/bad"]
    verdicts = stored(file_verdicts(spark, paths, by_folder=True), "verdicts")  # judged once, gated and shown
    try:
        gate_each(verdicts, "source")
        failed = []
    except DataQualityError as e:
        failed = e.report.failures()
    file = F.element_at(F.split("source", "/"), -1)
    return verdicts.select(
        file.alias("file"), "rule_name", "passed",
        F.when(F.col("rule_name").isin("port_range_valid", "label_values_valid"), F.col("details")["invalid_count"].cast("bigint")).alias("invalid"),
        F.when((file == "bad") & F.col("rule_name").isin(*failed, ""), 1).otherwise(0).alias("stopped"),
    )

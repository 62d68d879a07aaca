"""Streaming stages over the events table, run until their input is used up."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from catalog import query, table
from catalog.bindings import CLEAN_LABEL, IS_ATTACK, LINES_CODEC, OUTCOME, SCORE, SECONDS, broken_records, clean_sql, raw_flows, scored_events
from catalog.boosted_sql import boosted_ctes
from catalog.detecting import RATES_SQL, _attack, _time
from netsluice import schema
from netsluice.functions.text import signal_value
from netsluice.operators import boosting
from netsluice.operators.boosting import BoostParams
from netsluice.operators.clean import clean_flows
from netsluice.plans.registry import load_model, save_model
from netsluice.plans.training import fit_model
from netsluice.session import work_path
from netsluice.sources.files import export_json_lines
from netsluice.streaming.histories import current_histories, source_histories, write_histories
from netsluice.streaming.rates import RANK_ERROR, keep_history, merged_rates, rank_audit, stream_rates
from netsluice.streaming.stages import (
    bounded,
    cleaned_stream,
    json_file_stream,
    raw_file_stream,
    run_gated,
    run_scoring,
    run_to_table,
    scored_stream,
)


def _event_stream(spark, sf_dir):
    fields = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(fields).parquet(f"{sf_dir}/events.parquet*").selectExpr(
        "event_id", "ts", "user_id", f"{OUTCOME} as is_anomaly", f"cast({SCORE} as double) as confidence",
        f"cast({SECONDS} as double) as seconds",
    )


def _record_files(spark, sf_dir, good_ports: bool = False):
    """Events as compressed JSON-lines files of raw flow records."""
    path = work_path(spark, "records")
    flows = raw_flows(spark, sf_dir, ())
    if good_ports:
        flows = flows.withColumn("Destination Port", F.expr("cast(abs(hash(`Flow Duration`)) % 60000 as string)"))
    export_json_lines(flows, path, compression=LINES_CODEC)
    return path


def _part(spark, folder, batches):
    """Files of a batch by which the folder's files, that grow in number with the events, come in so many batches."""
    return -(-len(spark.read.text(folder).inputFiles()) // batches)


def _half(spark, folder):
    return _part(spark, folder, 2)


_SHOWN = ["flow_duration", "total_fwd_packets", "flow_bytes_s"]


@query(
    "stream_clean",
    f"""select {', '.join(f'{clean_sql(f)} as {f}' for f in _SHOWN)}, {CLEAN_LABEL} as label,
        {IS_ATTACK} as is_attack from events""",
)
def stream_clean(spark, sf_dir):
    out, files = work_path(spark, "cleaned"), _record_files(spark, sf_dir)
    stream = cleaned_stream(json_file_stream(spark, files, files_per_trigger=_half(spark, files))).drop("extra")
    run_to_table(stream, out, work_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).select(*_SHOWN, "label", "is_attack")


@query("stream_clean_capped", "select 100 as rows")
def stream_clean_capped(spark, sf_dir):
    out = work_path(spark, "cleaned")
    stream = cleaned_stream(json_file_stream(spark, _record_files(spark, sf_dir)), max_records=100).drop("extra")
    run_to_table(stream, out, work_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "stream_gated",
    f"select {CLEAN_LABEL} as label, count(*) as rows, {len(schema.NUMERIC_FIELDS)} as columns from events group by 1",
)
def stream_gated(spark, sf_dir):
    out, held = work_path(spark, "let-through"), work_path(spark, "quarantine")
    files = _record_files(spark, sf_dir, good_ports=True)
    stream = cleaned_stream(json_file_stream(spark, files, files_per_trigger=_half(spark, files))).drop("extra")
    run_gated(stream, out, held, work_path(spark, "checkpoint")).awaitTermination()
    df = spark.read.parquet(out)
    n = len([c for c in df.columns if c in schema.NUMERIC_FIELDS])
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(n))


@query(
    "stream_gated_bad",
    """select 'quarantined' as what, count(*) as rows from events union all
    select 'refused port', count(*) from events where event_id % 8 = 1 union all
    select 'missing keys', count(*) from events where event_id % 8 in (1, 2) union all
    select 'odd keys', count(*) from events where event_id % 8 = 3 union all
    select 'unknown label', count(*) from events where event_id % 8 = 4 union all
    select 'few fields', count(*) from events where event_id % 8 in (1, 2)""",
)
def stream_gated_bad(spark, sf_dir):
    """A batch with broken records stops the gated stage and lies in the quarantine, with what was wrong beside the rows."""
    out, held, files = (work_path(spark, n) for n in ("let-through", "quarantine", "records"))
    broken_records(spark, sf_dir).select("value").write.text(files)
    stream = cleaned_stream(json_file_stream(spark, files))
    try:
        run_gated(stream, out, held, work_path(spark, "checkpoint")).awaitTermination()
    except StreamingQueryException as e:
        if "DataQualityError" not in str(e):
            raise
    kinds = {
        "quarantined": F.lit(True), "refused port": F.exists("refused", lambda z: z["field"] == "destination_port"),
        "missing keys": F.size("missing_keys") > 0, "odd keys": F.size("odd_keys") > 0,
        "unknown label": F.col("label") == "nonsense", "few fields": F.col("field_count") < schema.MIN_RECORD_FIELDS,
    }
    rows = spark.read.parquet(held).agg(*[F.count(F.when(c, 1)).alias(k) for k, c in kinds.items()])
    return rows.select(F.inline(F.array(*[F.struct(F.lit(k).alias("what"), F.col(f"`{k}`").alias("rows")) for k in kinds])))


@query(
    "stream_raw_files",
    f"""select event_id % 2 as file, count(*) as rows, sum({clean_sql('flow_duration')}) as duration,
        count(*) filter (where event_id % 10 = 3) as refused from events group by 1""",
)
def stream_raw_files(spark, sf_dir):
    """Raw CSV files to records to cleaned flows, by two streams; unreadable ports come through as refused texts."""
    raw, lines, out = (work_path(spark, n) for n in ("raw-files", "lines", "cleaned"))
    flows = raw_flows(spark, sf_dir).withColumns(
        {
            "Destination Port": F.when(F.expr("event_id % 10 = 3"), "http").otherwise(F.lit("80")),
            "Flow IAT Min": F.expr("cast(event_id % 2 as string)"),
        }
    )
    flows.drop("event_id").write.options(header="true", compression=LINES_CODEC).csv(raw)
    records = raw_file_stream(spark, raw, files_per_trigger=_half(spark, raw))
    writer = records.writeStream.format("text").option("compression", LINES_CODEC).outputMode("append")
    bounded(writer, work_path(spark, "checkpoint")).start(lines).awaitTermination()
    cleaned = cleaned_stream(json_file_stream(spark, lines)).drop("extra")
    run_to_table(cleaned, out, work_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).groupBy(F.col("flow_iat_min").cast("bigint").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("flow_duration").alias("duration"),
        F.count(F.when(F.size("refused") > 0, 1)).alias("refused"),
    )


_STREAM_BOOST = BoostParams(trees=2, depth=2, rate=3.0, bins=8)


@query(
    "stream_scores",
    f"""with rows as materialized (select event_id, {IS_ATTACK} as target, 1.0 as weight, {CLEAN_LABEL} as label,
        {', '.join(f'{clean_sql(f)} as {f}' for f in schema.FEATURES)} from events),
    {boosted_ctes('a_', 'rows', schema.FEATURES, 2, 2, 3.0, 8)},
    s as (select label, 1 / (1 + exp(-margin)) as p from a_scores join rows using (event_id))
    select label, round(p, 6) as score, '1.0.0' as version, count(*) as scored, count(*) filter (where p > 0.8) as alerts
    from s group by all""",
)
def stream_scores(spark, sf_dir):
    """Both sinks of the scoring stage, by a model that was fitted in batch and loaded from the registry."""
    flows = clean_flows(raw_flows(spark, sf_dir))
    edges = boosting.even_edges(flows, schema.FEATURES, _STREAM_BOOST.bins)
    root = work_path(spark, "registry")
    save_model(spark, fit_model(flows, _STREAM_BOOST, weight=None, edges=edges), root, "1.0.0")
    model, version = load_model(spark, root)
    out, alerts, files = work_path(spark, "scored"), work_path(spark, "alerts"), _record_files(spark, sf_dir)
    cleaned = cleaned_stream(json_file_stream(spark, files, files_per_trigger=_half(spark, files))).drop("extra")
    run_scoring(scored_stream(cleaned, model, version), out, alerts, work_path(spark, "checkpoint")).awaitTermination()
    by = ["label", F.round("ml_confidence_score", 6).alias("score"), F.col("ml_model_version").alias("version")]
    scored = spark.read.parquet(out).select(*by, F.lit(1).alias("s"), F.lit(0).alias("a"))
    found = spark.read.parquet(alerts).select(*by, F.lit(0).alias("s"), F.lit(1).alias("a"))
    return scored.unionByName(found).groupBy("label", "score", "version").agg(F.sum("s").alias("scored"), F.sum("a").alias("alerts"))


@query(
    "stream_scores_without_model",
    f"select {CLEAN_LABEL} as label, count(*) as scored, count(*) filter (where false) as alerts from events group by 1",
)
def stream_scores_without_model(spark, sf_dir):
    """Without a model every record comes through with no score, and nothing is alerted."""
    out, alerts, files = work_path(spark, "scored"), work_path(spark, "alerts"), _record_files(spark, sf_dir)
    cleaned = cleaned_stream(json_file_stream(spark, files, files_per_trigger=_half(spark, files))).drop("extra")
    run_scoring(scored_stream(cleaned, None), out, alerts, work_path(spark, "checkpoint")).awaitTermination()
    found = spark.read.parquet(alerts).groupBy("label").agg(F.count(F.lit(1)).alias("alerts"))
    scored = spark.read.parquet(out).where("ml_confidence_score is null").groupBy("label").agg(F.count(F.lit(1)).alias("scored"))
    return scored.join(found, "label", "left").select("label", "scored", F.coalesce("alerts", F.lit(0)).alias("alerts"))


@query(
    "stream_resumed",
    f"""select {', '.join(f'{clean_sql(f)} as {f}' for f in _SHOWN)}, {CLEAN_LABEL} as label, event_id % 3 as delivery from events""",
)
def stream_resumed(spark, sf_dir):
    """Three deliveries of records, and a run of the cleaning stage, of three batches, after each: every run goes on where the last one ended."""
    files, out, checkpoint = work_path(spark, "records"), work_path(spark, "cleaned"), work_path(spark, "checkpoint")
    for k in range(3):
        flows = raw_flows(spark, sf_dir).where(F.col("event_id") % 3 == k).withColumn("Flow IAT Min", F.lit(str(k))).drop("event_id")
        export_json_lines(flows, f"{files}/{k}", compression=LINES_CODEC)
        some = _part(spark, f"{files}/{k}", 3)
        stream = cleaned_stream(json_file_stream(spark, f"{files}/*", files_per_trigger=some)).drop("extra")
        run_to_table(stream, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select(*_SHOWN, "label", F.col("flow_iat_min").cast("bigint").alias("delivery"))


def _finished_rates(spark, sf_dir, window_seconds):
    """Event-time windows; complete mode, so that the last window is emitted as well."""
    out = work_path(spark, "rates")
    stream = stream_rates(_event_stream(spark, sf_dir), "ts", _attack(), F.col("seconds"), window_seconds)

    def replace(batch, batch_id):
        batch.write.mode("overwrite").parquet(out)

    bounded(
        stream.writeStream.outputMode("complete").foreachBatch(replace), work_path(spark, "checkpoint")
    ).start().awaitTermination()
    return spark.read.parquet(out)


def _audited(spark, sf_dir, rates, window_seconds):
    """Rates beside the check of their sketched quantile against the exact ranks of the rows."""
    audit = rank_audit(scored_events(spark, sf_dir), "ts", F.col("seconds"), rates, window_seconds)
    within = (F.col("low") - RANK_ERROR <= 0.95) & (F.col("high") + RANK_ERROR >= 0.95)
    shown = rates.select(
        "window_start", "predictions", *[F.round(c, 9).alias(c) for c in ("per_second", "anomaly_ratio", "avg_latency")]
    )
    return shown.join(audit.select("window_start", within.alias("p95_within")), "window_start").withColumn("window_start", _time("window_start"))


@query("stream_rates", f"{RATES_SQL}, true as p95_within from s group by 1")
def rates(spark, sf_dir):
    """Hourly rates of a stream, the 95 % latency from a sketch that keeps to its bound."""
    return _audited(spark, sf_dir, _finished_rates(spark, sf_dir, 3_600), 3_600)


@query(
    "stream_rates_merged",
    f"{RATES_SQL}, true as p95_within from s group by 1".replace("interval 1 hour", "interval 1 day").replace("3600.0", "86400.0"),
)
def daily_rates(spark, sf_dir):
    """Rates of days merged from five-minute windows, by way of hours."""
    hours = merged_rates(_finished_rates(spark, sf_dir, 300), 3_600)
    return _audited(spark, sf_dir, merged_rates(hours, 86_400), 86_400)


@query(
    "stream_histories",
    f"""with r as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as place from events)
    select event_type as source, place, event_id, case when {OUTCOME} = 'BENIGN' then cast({SCORE} as double) else 1.0 end as value
    from r where place <= 50""",
)
def stream_histories(spark, sf_dir):
    """The last 50 signals of every source; the stream stops in the middle and goes on."""
    files, out, checkpoint = work_path(spark, "events"), work_path(spark, "histories"), work_path(spark, "checkpoint")
    events = scored_events(spark, sf_dir)
    for part in ("event_id % 4 in (0, 3)", "event_id % 4 in (1, 2)"):
        events.where(part).repartition(3).write.mode("append").parquet(files)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(files)
        histories = source_histories(stream, "event_type", "ts", ["event_id"], ["is_anomaly", "confidence"], idle="60 days")
        writer = histories.writeStream.outputMode("update").foreachBatch(write_histories(out))
        bounded(writer, checkpoint).start().awaitTermination()
    return current_histories(spark, out).select(
        "source", "place", "event_id", signal_value(_attack(), F.col("confidence")).alias("value")
    )


@query(
    "stream_history",
    f"""select event_id, case when {OUTCOME} = 'BENIGN' then cast({SCORE} as double) else 1.0 end as value from events
    order by ts desc, event_id desc limit 50""",
)
def stream_history(spark, sf_dir):
    out = work_path(spark, "history")
    writer = _event_stream(spark, sf_dir).writeStream.foreachBatch(keep_history(out, "ts", ["event_id"]))
    done = bounded(writer, work_path(spark, "checkpoint")).start()
    done.awaitTermination()
    last = max(p["batchId"] for p in done.recentProgress if p["numInputRows"])
    return spark.read.parquet(f"{out}/{last}").select(
        "event_id", signal_value(_attack(), F.col("confidence")).alias("value")
    )

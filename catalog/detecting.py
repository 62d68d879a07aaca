"""Scored rows: outcomes, alerts, detections, rates."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from catalog import query, table
from catalog.bindings import SCORED_SQL, scored_events
from netsluice.functions.text import is_attack_outcome
from netsluice.operators import detections, metrics, postings
from netsluice.operators.profile import class_split
from netsluice.operators.ranking import number_rows
from netsluice.session import work_path
from netsluice.streaming.rates import signal_history

_S = f"with s as ({SCORED_SQL})"
_ATTACK = "upper(trim(is_anomaly)) = 'ATTACK'"


def _attack():
    return is_attack_outcome(F.col("is_anomaly"))


def _time(c="ts"):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss").alias(c)


@query("attack_rows", f"{_S} select event_id from s where {_ATTACK}")
def attack_rows(spark, sf_dir):
    return detections.by_outcome(scored_events(spark, sf_dir), "attacks").select("event_id")


@query("benign_rows", f"{_S} select event_id from s where not ({_ATTACK})")
def benign_rows(spark, sf_dir):
    return detections.by_outcome(scored_events(spark, sf_dir), "benign").select("event_id")


@query("alerts", f"{_S} select event_id, confidence from s where confidence > 0.8")
def alerts(spark, sf_dir):
    return detections.alerts(scored_events(spark, sf_dir), "confidence").select("event_id", "confidence")


@query(
    "recent_flags",
    f"{_S} select event_id, ts > timestamp '2024-01-15 12:00:00' - interval 5 seconds as is_recent from s",
)
def recent_flags(spark, sf_dir):
    as_of = F.to_timestamp(F.lit("2024-01-15 12:00:00"))
    return scored_events(spark, sf_dir).select("event_id", detections.is_recent(F.col("ts"), as_of).alias("is_recent"))


@query(
    "batch_summary",
    f"""{_S} select count(*) as total_processed, count(*) filter (where {_ATTACK}) as anomalies_found,
        count(*) filter (where user_id % 9 = 0) as failed_count from s""",
)
def batch_summary(spark, sf_dir):
    df = scored_events(spark, sf_dir).withColumn("scored_ok", F.expr("user_id % 9 <> 0"))
    return detections.batch_summary(df, scored_ok="scored_ok")


@query(
    "session_kpis",
    f"""{_S} select count(*) as predictions, count(*) filter (where {_ATTACK}) as attacks,
        round(100.0 * count(*) filter (where {_ATTACK}) / count(*), 6) as attack_rate,
        round(100 - 100.0 * count(*) filter (where {_ATTACK}) / count(*), 6) as benign_rate,
        round(avg(confidence), 6) as avg_confidence, round(avg(seconds * 1000), 6) as avg_millis from s""",
)
def session_kpis(spark, sf_dir):
    kpis = metrics.session_kpis(
        scored_events(spark, sf_dir), _attack(), F.col("confidence"), F.col("seconds") * 1000
    )
    return kpis.select(
        "predictions", "attacks",
        *[F.round(c, 6).alias(c) for c in ("attack_rate", "benign_rate", "avg_confidence", "avg_millis")],
    )


@query(
    "scoring_counters",
    f"""{_S} select concat('v', user_id % 3) as version, count(*) as predictions,
        count(*) filter (where {_ATTACK}) as anomalies from s group by 1""",
)
def scoring_counters(spark, sf_dir):
    df = scored_events(spark, sf_dir).withColumn("version", F.expr("concat('v', user_id % 3)"))
    return metrics.scoring_counters(df, "version", _attack())


@query(
    "latency_histogram",
    _S
    + " union all ".join(
        f" select '{b}' as le, count(*) filter (where seconds <= {b}) as rows from s"
        for b in metrics.LATENCY_BOUNDS
    )
    + " union all select '+Inf', count(*) from s",
)
def latency_histogram(spark, sf_dir):
    return metrics.latency_histogram(scored_events(spark, sf_dir), F.col("seconds"))


RATES_SQL = f"""{_S} select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as window_start,
        count(*) as predictions, round(count(*) / 3600.0, 9) as per_second,
        round(count(*) filter (where {_ATTACK}) / count(*), 9) as anomaly_ratio, round(avg(seconds), 9) as avg_latency"""


@query(
    "window_rates",
    f"{RATES_SQL}, round(quantile_cont(seconds, 0.95), 9) as p95_latency from s group by 1".replace(
        "interval 1 hour", "interval 5 minutes").replace("3600.0", "300.0"),
)
def window_rates(spark, sf_dir):
    rates = metrics.window_rates(scored_events(spark, sf_dir), "ts", _attack(), F.col("seconds"))
    return rates.select(
        _time("window_start"), "predictions",
        *[F.round(c, 9).alias(c) for c in ("per_second", "anomaly_ratio", "avg_latency", "p95_latency")],
    )


@query(
    "running_counts",
    f"""{_S}, b as (select user_id as batch, count(*) as cleaned, count(*) filter (where {_ATTACK}) as attacks
        from s group by 1)
    select batch, cleaned, attacks, sum(cleaned) over (order by batch) as total_cleaned,
        sum(attacks) over (order by batch) as total_attacks from b""",
)
def running_counts(spark, sf_dir):
    df = scored_events(spark, sf_dir).withColumnRenamed("user_id", "batch")
    return metrics.running_counts(df, "batch", _attack())


@query(
    "signal_history",
    f"""{_S} select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, {_ATTACK} as is_anomaly,
        case when {_ATTACK} then 1.0 else confidence end as value from s order by s.ts desc, event_id desc limit 50""",
)
def signal_points(spark, sf_dir):
    points = signal_history(scored_events(spark, sf_dir), "ts", ["event_id"], _attack(), F.col("confidence"))
    return points.withColumn("ts", _time())


@query(
    "detection_log",
    f"""{_S} select sha256(concat('Batch|', event_id)) as id, 'Batch' as source, confidence,
        strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp, value, user_id from s where {_ATTACK}""",
)
def detection_log(spark, sf_dir):
    return _detections(spark, sf_dir).select(
        "id", "source", "confidence", _time("timestamp"), "payload.value", "payload.user_id"
    )


def _detections(spark, sf_dir):
    return detections.detection_rows(
        scored_events(spark, sf_dir), "Batch", ["event_id"], "ts", ["value", "user_id", "event_type"]
    )


@query(
    "detection_log_writers",
    f"""{_S} select sha256(concat('Batch|', event_id)) as id, confidence from s where {_ATTACK} and event_id % 4 <> 3""",
)
def detection_log_writers(spark, sf_dir):
    """A log that is cleared, then written by three threads at once, each in two appends."""
    root, events = work_path(spark, "log"), scored_events(spark, sf_dir)

    def of(condition):
        return detections.detection_rows(events.where(condition), "Batch", ["event_id"], "ts", ["value", "user_id", "event_type"])

    detections.log_detections(of("event_id % 4 = 3"), root)
    detections.clear_log(spark, root)

    def write(k):
        for half in (0, 1):
            detections.log_detections(of(f"event_id % 4 = {k} and event_id div 4 % 2 = {half}"), root)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    return detections.read_detections(spark, root, _detections(spark, sf_dir).schema).select("id", "confidence")


@query(
    "recent_attacks",
    f"""{_S} select sha256(concat('Batch|', event_id)) as id, confidence from s where {_ATTACK}
    order by ts desc, id desc limit 5""",
)
def recent_attacks(spark, sf_dir):
    return detections.recent_attacks(_detections(spark, sf_dir)).select("id", "confidence")


def _js_number(c: str) -> str:
    return f"case when {c} = floor({c}) then cast(cast({c} as bigint) as varchar) else cast({c} as varchar) end"


@query(
    "search_detections",
    f"""{_S} select sha256(concat('Batch|', event_id)) as id, value from s where {_ATTACK}
    and (contains({_js_number('value')}, '7.5') or contains(cast(user_id as varchar), '7.5')
        or contains(lower(event_type), '7.5'))""",
)
def search_numbers(spark, sf_dir):
    found = detections.search_detections(_detections(spark, sf_dir), "Batch", " 7.5 ")
    return found.select("id", "payload.value")


@query("search_detections_words", f"{_S} select sha256(concat('Batch|', event_id)) as id from s where {_ATTACK}")
def search_words(spark, sf_dir):
    return detections.search_detections(_detections(spark, sf_dir), "all", "RRO").select("id")


def _indexed_log(spark, sf_dir):
    """The detections as a log of a file per day, indexed in two runs but for its last day."""
    log, index = work_path(spark, "detection-log"), work_path(spark, "postings")
    found = _detections(spark, sf_dir).withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    for days in ("day < '2024-01-11'", "day >= '2024-01-11' and day < '2024-01-25'", "day >= '2024-01-25'"):
        found.where(days).repartition("day").write.mode("append").partitionBy("day").parquet(log)
        if ">= '2024-01-25'" not in days:
            postings.update_index(spark, log, index)
    return log, index


_DAYS = f"""{_S}, d as (select strftime(ts, '%Y-%m-%d') as day, event_id, value,
        [{_js_number('value')}, cast(user_id as varchar), lower(event_type)] as texts from s where {_ATTACK})"""


def _found_sql(needle: str) -> str:
    """The rows, and how many files an index has to read: those that hold all trigrams, and those not indexed."""
    grams = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})
    held = " and ".join(f"bool_or(len(list_filter(texts, lambda t: contains(t, '{g}'))) > 0)" for g in grams)
    return f"""{_DAYS}, f as (select day, ({held}) or day >= '2024-01-25' as is_read from d group by day)
    select sha256(concat('Batch|', event_id)) as id, day, (select count(*) from f) as files,
        (select count(*) from f where is_read) as files_read
    from d where len(list_filter(texts, lambda t: contains(t, '{needle}'))) > 0"""


def _search(spark, sf_dir, needle):
    found, facts = postings.search_indexed(spark, *_indexed_log(spark, sf_dir), "Batch", needle)
    return found.select("id", F.col("day").cast("string").alias("day"), *[F.lit(v).cast("long").alias(k) for k, v in facts.items()])


@query("search_indexed", _found_sql("61.37"))
def search_indexed(spark, sf_dir):
    """A rare text: the files of most days are never opened."""
    return _search(spark, sf_dir, " 61.37 ")


@query("search_indexed_words", _found_sql("rro"))
def search_indexed_words(spark, sf_dir):
    return _search(spark, sf_dir, "RRO")


@query(
    "sorted_results",
    f"""{_S} select row_number() over (order by confidence desc, event_id) as place, event_id, confidence from s""",
)
def sorted_results(spark, sf_dir):
    df = scored_events(spark, sf_dir).select("event_id", "confidence")
    numbered = number_rows(df.withColumn("_down", -F.col("confidence")), ["_down", "event_id"], "place")
    return detections.sorted_results(numbered.drop("_down"), "confidence", ascending=False, row="event_id")


@query(
    "numbered_results",
    f"""{_S} select row_number() over (order by event_id) as row, is_anomaly, confidence from s""",
)
def numbered_results(spark, sf_dir):
    return detections.numbered_results(scored_events(spark, sf_dir), ["event_id"]).select(
        "row", "is_anomaly", "confidence"
    )


@query(
    "preview",
    "select o_orderkey, o_orderstatus from orders order by o_totalprice desc, o_orderkey limit 5",
)
def preview(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", "o_orderstatus")


@query(
    "outcome_split",
    f"""{_S} select case when {_ATTACK} then 1 else 0 end as is_attack, count(*) as rows,
        round(100.0 * count(*) / sum(count(*)) over (), 2) as percent from s group by 1""",
)
def outcome_split(spark, sf_dir):
    return class_split(scored_events(spark, sf_dir).withColumn("is_attack", _attack().cast("int")))

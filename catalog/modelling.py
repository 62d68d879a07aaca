"""Classifier quality, training and scoring."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from catalog import query, table
from catalog.bindings import CLEAN_LABEL, FLOW_NUMBERS, IS_ATTACK, LINES_CODEC, clean_sql, flow_numbers, raw_flows, spread
from catalog.boosted_sql import boosted_ctes
from netsluice import schema
from netsluice.operators import boosting, evaluation
from netsluice.operators.boosting import BoostParams
from netsluice.operators.clean import clean_flows
from netsluice.operators.detections import batch_summary
from netsluice.operators.features import extract_features
from netsluice.plans.registry import load_model, log_run, promote, save_model, training_runs
from netsluice.plans.scoring import score_flows
from netsluice.plans.training import TreeParams, cross_validate, fit_model, holdout_metrics, pipeline, prepare_data, training_table
from netsluice.session import stored, work_path
from netsluice.sources.files import json_text

# a fixed linear score against the return flag
_SCORE = "round(0.5 * l_quantity / 50 + 2 * l_discount + l_tax, 2)"
_JUDGED = f"""select case when l_returnflag = 'R' then 1 else 0 end as label, {_SCORE} as score,
    case when {_SCORE} > 0.4 then 1 else 0 end as prediction from lineitem"""


def _judged(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "if(l_returnflag = 'R', 1, 0) as label", f"{_SCORE} as score", f"if({_SCORE} > 0.4, 1, 0) as prediction"
    )


@query(
    "confusion",
    f"select label, prediction, count(*) as rows from ({_JUDGED}) group by label, prediction",
)
def confusion(spark, sf_dir):
    return evaluation.confusion(_judged(spark, sf_dir))


_COUNTS = f"""with j as ({_JUDGED}), c as (select
    cast(count(*) filter (where label = 1 and prediction = 1) as double) as tp,
    cast(count(*) filter (where label = 0 and prediction = 1) as double) as fp,
    cast(count(*) filter (where label = 1 and prediction = 0) as double) as fn,
    cast(count(*) filter (where label = 0 and prediction = 0) as double) as tn from j)"""


@query(
    "binary_metrics",
    f"""{_COUNTS} select round((tp + tn) / (tp + tn + fp + fn), 9) as accuracy, round(tp / (tp + fp), 9) as precision,
        round(tp / (tp + fn), 9) as recall, round(2 * tp / (2 * tp + fp + fn), 9) as f1,
        round(fp / (fp + tn), 9) as false_positive_rate from c""",
)
def binary_metrics(spark, sf_dir):
    found = evaluation.binary_metrics(_judged(spark, sf_dir))
    return found.select([F.round(c, 9).alias(c) for c in found.columns])


@query(
    "class_report",
    f"""{_COUNTS}, k as (
        select '1' as class, tp / (tp + fp) as p, tp / (tp + fn) as r, 2 * tp / (2 * tp + fp + fn) as f, tp + fn as s from c
        union all
        select '0', tn / (tn + fn), tn / (tn + fp), 2 * tn / (2 * tn + fn + fp), tn + fp from c),
    l as (select class, p, r, f, s from k
        union all select 'macro avg', avg(p), avg(r), avg(f), sum(s) from k
        union all select 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) from k
        union all select 'accuracy', null, null, sum(r * s) / sum(s), sum(s) from k)
    select class, round(p, 9) as precision, round(r, 9) as recall, round(f, 9) as f1, cast(s as bigint) as support from l""",
)
def class_report(spark, sf_dir):
    found = evaluation.class_report(_judged(spark, sf_dir))
    return found.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "roc_auc",
    f"""with j as ({_JUDGED}), r as (select label,
        rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as r from j),
    s as (select cast(sum(label) as double) as p, cast(sum(1 - label) as double) as n,
        sum(r) filter (where label = 1) as total from r)
    select round((total - p * (p + 1) / 2) / (p * n), 9) as auc from s""",
)
def roc_auc(spark, sf_dir):
    return evaluation.roc_auc(_judged(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


def _flows(spark, sf_dir):
    """Cleaned flows whose attacks last longer, so that there is something to learn."""
    flows = clean_flows(raw_flows(spark, sf_dir))
    longer = F.when(F.col("is_attack") == 1, F.col("flow_duration") + 2_000).otherwise(F.col("flow_duration"))
    return flows.withColumn("flow_duration", longer)


_BOOST = BoostParams(trees=2, depth=2, rate=0.3, bins=8)
_SOME = ["flow_duration", "total_fwd_packets", "total_backward_packets", "flow_bytes_s", "fwd_iat_mean", "active_mean", "idle_std"]
_EVENT_WEIGHT = "1.0 + event_id % 3 / 2.0"


@query(
    "boosted_trees",
    f"""with rows as (select event_id, {IS_ATTACK} as target, {_EVENT_WEIGHT} as weight, {', '.join(f'{FLOW_NUMBERS[f]} as {f}' for f in _SOME)} from events),
    {boosted_ctes('a_', 'rows', _SOME, 3, 3, 0.3, 16)}
    select tree, node, feature, round(threshold, 9) as threshold, missing_left, round(gain, 6) as gain, round(value, 9) as value
    from a_nodes""",
)
def boosted_trees(spark, sf_dir):
    """Every node of three trees over features with gaps."""
    target = spread(table(spark, sf_dir, "events")).selectExpr("event_id as id", f"{IS_ATTACK} as is_attack", f"{_EVENT_WEIGHT} as weight")
    rows = flow_numbers(spark, sf_dir).join(target, F.col("event_id") == F.col("id"))
    edges = boosting.even_edges(rows, _SOME, 16)
    model = boosting.fit(rows, _SOME, params=BoostParams(trees=3, depth=3, rate=0.3, bins=16), edges=edges)
    rounded = {"threshold": F.round("threshold", 9), "gain": F.round("gain", 6), "value": F.round("value", 9)}
    return model.node_table(spark).withColumns(rounded)


def _flow_sql(f: str) -> str:
    longer = f" + case when {IS_ATTACK} = 1 then 2000 else 0 end" if f == "flow_duration" else ""
    return f"{clean_sql(f)}{longer} as {f}"


# flows with the weight of their label, the hold-out and the folds, as training_table makes them
_TRAINING_SQL = f"""f as (select event_id, {IS_ATTACK} as target, {CLEAN_LABEL} as label, md5(concat_ws('|', event_id, '42')) as o,
        {', '.join(_flow_sql(f) for f in schema.FEATURES)} from events),
    lw as (select label, sqrt(sum(count(*)) over () / (count(*) over () * count(*))) as weight from f group by label),
    cs as (select target, count(*) as n from f group by target),
    sh as (select *, n * ceil(sum(n) over () * 0.2) / sum(n) over () as share, ceil(sum(n) over () * 0.2) as total from cs),
    ho as (select target, floor(share) + case when row_number() over (order by round(share - floor(share), 9) desc,
        target) <= total - sum(floor(share)) over () then 1 else 0 end as held from sh),
    sp as (select f.*, weight, row_number() over (partition by target order by o) <= held as is_test
        from f join lw using (label) join ho using (target)),
    rows as materialized (select *, row_number() over (partition by target, is_test order by o) > count(*) over (partition by target, is_test) // 2 as fold
        from sp)"""


def _boosted(prefix: str, train: str) -> str:
    return boosted_ctes(prefix, "rows", schema.FEATURES, _BOOST.trees, _BOOST.depth, _BOOST.rate, _BOOST.bins, train)


def _metrics_sql(name: str, source: str) -> str:
    return f"""{name} as (select (tp + tn) / (tp + tn + fp + fn) as accuracy, tp / (tp + fp) as precision, tp / (tp + fn) as recall,
        2 * tp / (2 * tp + fp + fn) as f1 from (select cast(count(*) filter (where target = 1 and margin > 0) as double) as tp,
        cast(count(*) filter (where target = 0 and margin > 0) as double) as fp,
        cast(count(*) filter (where target = 1 and margin <= 0) as double) as fn,
        cast(count(*) filter (where target = 0 and margin <= 0) as double) as tn from {source}))"""


_NAMES = ("accuracy", "precision", "recall", "f1")


@query(
    "training_metrics",
    f"""with {_TRAINING_SQL},
    {_boosted('x_', 'not is_test and fold')}, {_boosted('y_', 'not is_test and not fold')}, {_boosted('z_', 'not is_test')},
    {_metrics_sql('xm', "(select s.* from x_scores s join rows using (event_id) where not is_test and not fold)")},
    {_metrics_sql('ym', "(select s.* from y_scores s join rows using (event_id) where not is_test and fold)")},
    {_metrics_sql('zm', "(select s.* from z_scores s join rows using (event_id) where is_test)")},
    rk as (select s.target, rank() over (order by round(margin, 12)) + (count(*) over (partition by round(margin, 12)) - 1) / 2.0 as r
        from z_scores s join rows using (event_id) where is_test),
    au as (select (sum(r) filter (where target = 1) - sum(target) * (sum(target) + 1) / 2) / (sum(target) * sum(1 - target)) as auc from rk)
    {' union all '.join(f"select 'cv_mean_{n}' as metric, round((xm.{n} + ym.{n}) / 2, 9) as value from xm, ym" for n in _NAMES)}
    union all {' union all '.join(f"select 'test_{n}', round({n}, 9) from zm" for n in _NAMES)}
    union all select 'test_roc_auc', round(auc, 9) from au""",
)
def training_metrics(spark, sf_dir):
    """Folds and hold-out of boosted trees, each fitted with bins of its own training rows."""
    data = training_table(_flows(spark, sf_dir), ["event_id"], folds=2).cache()
    train = data.where("is_test = 0")
    metrics = {}
    for fold in (0, 1):
        rest = train.where(F.col("fold") != fold)
        model = fit_model(rest, _BOOST, edges=boosting.even_edges(rest, schema.FEATURES, _BOOST.bins))
        for name, value in holdout_metrics(train.where(F.col("fold") == fold), model).items():
            if name != "test_roc_auc":
                metrics[name.replace("test_", "cv_mean_")] = metrics.get(name.replace("test_", "cv_mean_"), 0.0) + value / 2
    model = fit_model(train, _BOOST, edges=boosting.even_edges(train, schema.FEATURES, _BOOST.bins))
    metrics |= holdout_metrics(data.where("is_test = 1"), model)
    data.unpersist()
    rows = [(k, float(v)) for k, v in sorted(metrics.items())]
    return spark.createDataFrame(rows, "metric string, value double").withColumn("value", F.round("value", 9))


@query(
    "score_flows",
    f"""with {_TRAINING_SQL}, {_boosted('z_', 'not is_test')},
    s as (select event_id, event_id % 50 <> 0 as scored_ok, 1 / (1 + exp(-margin)) as p from z_scores)
    select event_id, case when scored_ok and p > 0.5 then 'ATTACK' else 'BENIGN' end as is_anomaly,
        round(case when not scored_ok then 0 when p > 0.5 then p else 1 - p end, 9) as confidence,
        round(case when scored_ok then p end, 9) as ml_confidence_score, '1.0.0' as ml_model_version, scored_ok from s""",
)
def score(spark, sf_dir):
    """Flows scored by boosted trees that were saved and loaded again."""
    flows = stored(_flows(spark, sf_dir).select("event_id", "label", "is_attack", *schema.FEATURES), "flows")  # cleaned once, to train and to score
    train = training_table(flows, ["event_id"], folds=2).where("is_test = 0")
    model = fit_model(train, _BOOST, edges=boosting.even_edges(train, schema.FEATURES, _BOOST.bins))
    root = work_path(spark, "registry")
    save_model(spark, model, root, schema.MODEL_VERSION)
    model, version = load_model(spark, root)
    scored = score_flows(flows, model, version, valid=F.expr("event_id % 50 <> 0"))
    return scored.select(
        "event_id", "is_anomaly", *[F.round(c, 9).alias(c) for c in ("confidence", "ml_confidence_score")],
        "ml_model_version", "scored_ok",
    )


_SMALL = TreeParams(trees=3, depth=3)


@query("score_flows_pipeline")
def score_with_pipeline(spark, sf_dir):
    """The same with Spark ML's trees."""
    flows = stored(_flows(spark, sf_dir).select("event_id", "label", "is_attack", *schema.FEATURES), "flows")
    model = pipeline(_SMALL).fit(training_table(flows, ["event_id"], folds=2).where("is_test = 0"))
    scored = score_flows(flows, model, valid=F.expr("event_id % 50 <> 0"))
    return scored.select(
        "event_id", "is_anomaly", "confidence", "ml_confidence_score", "ml_model_version", "scored_ok"
    )


@query("training_metrics_pipeline")
def training_metrics_with_pipeline(spark, sf_dir):
    data = training_table(_flows(spark, sf_dir), ["event_id"], folds=2).cache()
    train = data.where("is_test = 0")
    metrics = cross_validate(train, _SMALL, 2)
    metrics |= holdout_metrics(data.where("is_test = 1"), pipeline(_SMALL).fit(train))
    data.unpersist()
    rows = [(k, float(v)) for k, v in sorted(metrics.items())]
    return spark.createDataFrame(rows, "metric string, value double")


@query(
    "prepare_json_lines",
    f"select {', '.join(f'{clean_sql(f)} as {f}' for f in schema.FEATURES)}, {IS_ATTACK} as is_attack, {CLEAN_LABEL} as label from events",
)
def prepare_json_lines(spark, sf_dir):
    """Cleaned records as JSON lines, blank lines among them, to the table that training reads."""
    lines, out = work_path(spark, "lines"), work_path(spark, "prepared")
    cleaned = clean_flows(raw_flows(spark, sf_dir, ())).drop("ingested_at")
    text = json_text(cleaned).select(F.explode(F.array("value", F.lit("  "))).alias("value"))
    text.write.option("compression", LINES_CODEC).text(lines)
    return prepare_data(spark, lines, out)


@query(
    "leak_guard",
    f"select event_id, {clean_sql('flow_duration')} as flow_duration, {IS_ATTACK} as is_attack, {len(schema.FEATURES)} as features, 0 as identifiers from events",
)
def leak_guard(spark, sf_dir):
    """Identifier columns never become features, even where one is asked for by name."""
    flows = clean_flows(raw_flows(spark, sf_dir))
    marked = flows.withColumns({c: F.lit(1e9) for c in schema.NEVER_FEATURES if c not in flows.columns})
    data = extract_features(marked, keep=["event_id"]).join(marked.select("event_id", "is_attack"), "event_id")
    kept = [c for c in extract_features(marked).columns if c in schema.NEVER_FEATURES]
    return data.select("event_id", "flow_duration", "is_attack", F.lit(len(extract_features(marked).columns)).alias("features"), F.lit(len(kept)).alias("identifiers"))


def _version_sql(k: int) -> str:
    return boosted_ctes(f"v{k}_", "rows", _SOME, 2, 2, 0.3, 8, f"event_id % 3 = {k}")


@query(
    "registry_order",
    f"""with rows as materialized (select event_id, {IS_ATTACK} as target, 1.0 as weight,
        {', '.join(f'{clean_sql(f)} as {f}' for f in _SOME)} from events), {', '.join(_version_sql(k) for k in range(3))}
    {' union all '.join(f"select '{step}' as step, '{v}' as version, round(sum(1 / (1 + exp(-margin))), 5) as total from v{k}_scores"
        for step, v, k in (("newest", "1.0", 1), ("promoted", "0.0", 0), ("newer", "0.0", 0), ("fallback", "local", 2)))}""",
)
def registry_order(spark, sf_dir):
    """Which model is loaded: the newest, the promoted one though a newer comes, a path where nothing is registered."""
    flows = clean_flows(raw_flows(spark, sf_dir))
    root, out = work_path(spark, "registry"), None

    def fitted(k):
        train = flows.where(F.col("event_id") % 3 == k)
        return fit_model(train, _BOOST, _SOME, weight=None, edges=boosting.even_edges(train, _SOME, _BOOST.bins))

    def loaded(step, folder, fallback=None):
        nonlocal out
        model, version = load_model(spark, folder, fallback)
        total = score_flows(flows, model).agg(F.round(F.sum("ml_confidence_score"), 5).alias("total"))
        row = total.select(F.lit(step).alias("step"), F.lit(version).alias("version"), "total")
        out = row if out is None else out.unionAll(row)

    save_model(spark, fitted(0), root, "0.0")
    save_model(spark, fitted(1), root, "1.0")
    loaded("newest", root)
    promote(spark, root, "0.0")
    loaded("promoted", root)
    last = save_model(spark, fitted(2), root, "2.0")
    loaded("newer", root)
    loaded("fallback", work_path(spark, "nothing"), last)
    return out


@query(
    "training_log",
    f"""{_COUNTS}, m as (select unnest(['accuracy', 'precision', 'recall']) as metric, unnest([(tp + tn) / (tp + tn + fp + fn), tp / (tp + fp), tp / (tp + fn)]) as value from c)
    select run, metric, round(value * run, 9) as value, run * 10 as trees from m, (select unnest([1, 2, 3]) as run)""",
)
def training_log(spark, sf_dir):
    """Three runs logged at once, read back with their parameters and metrics."""
    root = work_path(spark, "registry")
    found = evaluation.binary_metrics(_judged(spark, sf_dir)).first().asDict()

    def run(k):
        log_run(spark, root, str(k), {"trees": 10 * k}, {m: found[m] * k for m in ("accuracy", "precision", "recall")}, None)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(run, (1, 2, 3)))
    runs = training_runs(spark, root).select(F.col("run_id").cast("int").alias("run"), F.explode("metrics").alias("metric", "value"), F.col("params")["trees"].cast("int").alias("trees"))
    return runs.withColumn("value", F.round("value", 9))


@query(
    "score_without_model",
    """select event_id, 'BENIGN' as is_anomaly, 0.0 as confidence, null as ml_confidence_score,
        '1.0.0' as ml_model_version, false as scored_ok from events""",
)
def score_without_model(spark, sf_dir):
    scored = score_flows(clean_flows(raw_flows(spark, sf_dir)), None)
    return scored.select(
        "event_id", "is_anomaly", "confidence", "ml_confidence_score", "ml_model_version", "scored_ok"
    )


@query(
    "failed_batch_summary",
    "select count(*) as total_processed, 0 as anomalies_found, count(*) as failed_count from events",
)
def failed_batch_summary(spark, sf_dir):
    return batch_summary(score_flows(clean_flows(raw_flows(spark, sf_dir)), None), scored_ok="scored_ok")


@query(
    "training_split",
    """with t as (select case when event_type in ('error', 'signup', 'purchase') then 1 else 0 end as is_attack,
        count(*) as n from events group by 1),
    s as (select *, n * ceil(sum(n) over () * 0.2) / sum(n) over () as share, ceil(sum(n) over () * 0.2) as total from t),
    w as (select is_attack, n, floor(share) + case when row_number() over (order by round(share - floor(share), 9) desc,
        is_attack) <= total - sum(floor(share)) over () then 1 else 0 end as test from s)
    select is_attack, 1 as is_test, cast(test as bigint) as rows from w
    union all select is_attack, 0, cast(n - test as bigint) from w""",
)
def training_split(spark, sf_dir):
    data = training_table(clean_flows(raw_flows(spark, sf_dir)), ["event_id"])
    return data.groupBy("is_attack", "is_test").agg(F.count(F.lit(1)).alias("rows"))

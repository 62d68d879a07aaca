"""Balanced samples, splits, folds, weights, interleaving."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, table
from netsluice.operators import sampling
from netsluice.operators.ranking import position_by_number
from netsluice.sources.interleave import first_rows, interleave

_ERROR = "case when event_type = 'error' then 1 else 0 end"


def _order(key: str) -> str:
    return f"md5(concat_ws('|', {key}, '42'))"


def _flagged(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.expr(_ERROR).alias("is_attack"))


@query(
    "undersample",
    f"""with r as (select doc_id, toxic, row_number() over (partition by toxic order by {_order('doc_id')}) as n from labels)
    select doc_id, toxic from r where toxic = 1 or n <= (select count(*) from labels where toxic = 1)""",
)
def undersample(spark, sf_dir):
    return sampling.under_sample(table(spark, sf_dir, "labels"), ["doc_id"], "toxic").select("doc_id", "toxic")


@query(
    "undersample_events",
    f"""with r as (select event_id, {_ERROR} as is_attack,
        row_number() over (partition by {_ERROR} order by {_order('event_id')}) as n from events)
    select event_id, is_attack from r where is_attack = 1 or n <= (select sum({_ERROR}) from events)""",
)
def undersample_events(spark, sf_dir):
    return sampling.under_sample(_flagged(spark, sf_dir), ["event_id"]).select("event_id", "is_attack")


@query(
    "undersample_unkeyed",
    """select flag, case when flag = 1 then n else (select count(*) from lineitem where l_returnflag = 'R') end as rows
    from (select case when l_returnflag = 'R' then 1 else 0 end as flag, count(*) as n from lineitem group by 1)""",
)
def undersample_unkeyed(spark, sf_dir):
    """Rows without a key, copies included: cut to the columns that repeat."""
    df = table(spark, sf_dir, "lineitem").select(
        "l_linenumber", "l_quantity", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("flag")
    )
    keyed = sampling.with_row_key(df)
    return sampling.under_sample(keyed, ["row_key"], "flag").groupBy("flag").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "row_keys",
    """select count(*) as rows, count(*) as keys from lineitem""",
)
def row_keys(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", "l_returnflag")
    keyed = sampling.with_row_key(df, chunk=100)
    return keyed.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("row_key").alias("keys"))


_SIZES = """s as (select event_type, count(*) as n from events group by 1),
    t as (select event_type, n, sum(n) over () as total, n * ceil(sum(n) over () * 0.2) / sum(n) over () as share from s),
    b as (select *, floor(share) as base, round(share - floor(share), 9) as rest,
        ceil(total * 0.2) - sum(floor(share)) over () as open from t),
    w as (select event_type, n as rows,
        cast(base + case when row_number() over (order by rest desc, event_type) <= open then 1 else 0 end as bigint)
        as wanted from b)"""


@query("holdout_sizes", f"with {_SIZES} select event_type, rows, wanted from w")
def holdout_sizes(spark, sf_dir):
    return sampling.holdout_sizes(table(spark, sf_dir, "events"), "event_type")


@query(
    "stratified_split",
    f"""with {_SIZES}, r as (select event_id, event_type,
        row_number() over (partition by event_type order by {_order('event_id')}) as n from events)
    select event_id, event_type, case when n <= wanted then 1 else 0 end as is_test from r join w using (event_type)""",
)
def stratified_split(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.stratified_split(df, ["event_id"], "event_type")


@query(
    "approximate_split",
    f"""select event_id, case when cast(concat('0x', substr({_order('event_id')}, 1, 8)) as bigint) < 858993459
        then 1 else 0 end as is_test from events""",
)
def approximate_split(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", sampling.approximate_split(["event_id"]).alias("is_test")
    )


@query(
    "stratified_folds",
    f"""with r as (select event_id, row_number() over (partition by event_type order by {_order('event_id')}) as p,
            count(*) over (partition by event_type) as n from events)
    select event_id, cast({' + '.join(f'(n * {j} // 5 < p)::int' for j in range(1, 5))} as int) as fold from r""",
)
def stratified_folds(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.stratified_folds(df, ["event_id"], "event_type").select("event_id", "fold")


@query(
    "class_weights",
    """select label, count(*) as rows,
        round(sqrt(sum(count(*)) over () / (count(*) over () * count(*))), 9) as weight from embeddings group by label""",
)
def class_weights(spark, sf_dir):
    return sampling.class_weights(table(spark, sf_dir, "embeddings")).withColumn("weight", F.round("weight", 9))


@query(
    "sample_weights",
    """with w as (select event_type, sqrt(sum(count(*)) over () / (count(*) over () * count(*))) as weight
        from events group by event_type)
    select event_id, round(weight, 9) as weight from events join w using (event_type)""",
)
def sample_weights(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.with_weights(df, "event_type").select("event_id", F.round("weight", 9).alias("weight"))


@query(
    "seeded_sample",
    f"select o_orderkey, o_orderstatus from orders order by {_order('o_orderkey')} limit 500",
)
def seeded_sample(spark, sf_dir):
    return sampling.sample_rows(table(spark, sf_dir, "orders"), 500, ["o_orderkey"]).select(
        "o_orderkey", "o_orderstatus"
    )


_LINES = "select event_id, event_type, row_number() over (partition by event_type order by event_id) as line from events"


def _lines(spark, sf_dir, width):
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    return position_by_number(df, ["event_type"], "event_id", "line", width)


@query("positions", _LINES)
def positions(spark, sf_dir):
    return _lines(spark, sf_dir, 700)


@query(
    "stride_sample",
    f"with l as ({_LINES}) select event_id from l where floor((line - 1) / 50) % 3 = 0",
)
def stride_sample(spark, sf_dir):
    return sampling.stride_sample(table(spark, sf_dir, "events"), "event_type", "event_id", 50, 3).select("event_id")


@query(
    "interleave",
    f"""with l as ({_LINES}) select event_id, event_type, line, cast(floor((line - 1) / 100) as bigint) as round from l""",
)
def interleaved(spark, sf_dir):
    return interleave(_lines(spark, sf_dir, 5_000), "event_type", "line", 100)


@query(
    "interleave_capped",
    f"""with l as ({_LINES}) select event_id, event_type, line, cast(floor((line - 1) / 100) as bigint) as round from l
    order by round, event_type, line limit 777""",
)
def interleaved_capped(spark, sf_dir):
    return interleave(_lines(spark, sf_dir, 5_000), "event_type", "line", 100, max_records=777)


@query("first_rows_per_source", f"with l as ({_LINES}) select event_id, event_type, line from l where line <= 40")
def first_rows_per_source(spark, sf_dir):
    return first_rows(_lines(spark, sf_dir, 5_000), n=40)

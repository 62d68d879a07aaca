"""Column profiles and class comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, table
from catalog.bindings import FLOW_NUMBERS, IS_ATTACK, clean_sql, flow_numbers, spread
from netsluice import schema
from netsluice.functions.numbers import log10_from_one
from netsluice.operators import distribution, fingerprints, profile
from netsluice.operators.gram import correlation_matrix
from netsluice.operators.quantiles import exact_quantiles
from netsluice.operators.ranking import top_by_count

_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _each(template: str, columns: list[str]) -> str:
    return " union all ".join(template.format(c=c) for c in columns)


def _flagged(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("is_attack", F.expr(IS_ATTACK))


@query("shape", "select count(*) as rows, 11 as columns from lineitem")
def shape(spark, sf_dir):
    return profile.shape(table(spark, sf_dir, "lineitem"))


@query(
    "column_info",
    """select 'event_id' as "column", 'bigint' as type, count(event_id) as non_null from events
    union all select 'event_type', 'string', count(nullif(event_type, 'error')) from events
    union all select 'value', 'double', count(value) from events""",
)
def column_info(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(
        "event_id", F.nullif("event_type", F.lit("error")).alias("event_type"), "value"
    )
    return profile.column_info(df)


@query(
    "describe",
    _each(
        """select '{c}' as "column", count({c}) as count, round(avg({c}) + 1e-7, 5) as mean, round(stddev_samp({c}), 6) as std,
        min({c}) as min, round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50,
        round(quantile_cont({c}, 0.75), 6) as p75, max({c}) as max from lineitem""",
        _NUMERIC,
    ),
)
def describe(spark, sf_dir):
    df = profile.describe(table(spark, sf_dir, "lineitem").select(*_NUMERIC))
    rounded = [F.round(c, 6).alias(c) for c in ("std", "p25", "p50", "p75")]
    # a mean of cents may end in an exact half, where the order of the sum would decide the rounding
    mean = F.round(F.col("mean") + 1e-7, 5).alias("mean")
    return df.select("column", "count", "min", "max", mean, *rounded)


@query(
    "null_counts",
    """select * from (select 'l_tax' as "column", count(*) as nulls from lineitem where l_linenumber = 1
    union all select 'l_discount', count(*) from lineitem where l_linenumber in (2, 3)) where nulls > 0""",
)
def null_counts(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return profile.null_counts(
        df.withColumn("l_tax", F.when(F.col("l_linenumber") != 1, F.col("l_tax"))).withColumn(
            "l_discount", F.when(F.col("l_linenumber").isin(2, 3), F.lit(float("nan"))).otherwise(F.col("l_discount"))
        )
    )


@query(
    "duplicate_rows",
    """select count(*) as rows, count(*) - (select count(*) from (select distinct * from lineitem)) as duplicates,
        100.0 * (count(*) - (select count(*) from (select distinct * from lineitem))) / count(*) as percent
    from lineitem""",
)
def duplicate_rows(spark, sf_dir):
    return profile.duplicate_rows(table(spark, sf_dir, "lineitem"))


@query(
    "duplicate_keys",
    """with k as (select distinct l_orderkey, l_linenumber from lineitem), n as (select count(*) as n from lineitem)
    select n as rows, n - (select count(*) from k) as duplicates,
        round(100.0 * (n - (select count(*) from k)) / n, 6) as percent from n""",
)
def duplicate_keys(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    found = profile.duplicate_rows(df, ["l_orderkey", "l_linenumber"], by_digest=False)
    return found.withColumn("percent", F.round("percent", 6))


@query(
    "duplicate_texts",
    """select lang, count(*) as rows, count(*) - count(distinct text) as duplicates,
        round(100.0 * (count(*) - count(distinct text)) / count(*), 6) as percent from documents group by lang""",
)
def duplicate_texts(spark, sf_dir):
    found = profile.duplicate_rows(table(spark, sf_dir, "documents"), ["text"], ["lang"])
    return found.withColumn("percent", F.round("percent", 6))


@query("constant_columns", """select 'region' as "column" union all select 'zero'""")
def constant_columns(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumns(
        {"zero": F.col("l_linenumber") * 0, "region": F.when(F.col("l_tax") > 0.01, F.lit("x"))}
    )
    return profile.constant_columns(df)


@query("distinct_estimates")
def distinct_estimates(spark, sf_dir):
    return profile.distinct_estimates(table(spark, sf_dir, "lineitem"))


@query(
    "redundant_columns",
    """select 'l_tax' as "left", 'tax_again' as "right", true as identical
    union all select 'l_tax', 'l_discount', (select count(*) = 0 from lineitem where l_tax <> l_discount)
    union all select 'l_tax', 'tax_some', false""",
)
def redundant_columns(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumns(
        {"tax_again": F.col("l_tax") * 1.0, "tax_some": F.when(F.col("l_linenumber") > 1, F.col("l_tax"))}
    )
    return profile.columns_equal(df, [("l_tax", "tax_again"), ("l_tax", "l_discount"), ("l_tax", "tax_some")])


@query(
    "label_distribution",
    """select event_type, count(*) as rows, round(100.0 * count(*) / sum(count(*)) over (), 3) as percent
    from events group by event_type""",
)
def label_distribution(spark, sf_dir):
    return profile.label_distribution(table(spark, sf_dir, "events"), "event_type")


@query(
    "class_split",
    f"""select {IS_ATTACK} as is_attack, count(*) as rows, round(100.0 * count(*) / sum(count(*)) over (), 2) as percent
    from events group by 1""",
)
def class_split(spark, sf_dir):
    return profile.class_split(_flagged(spark, sf_dir))


@query("distinct_labels", "select distinct trim(o_orderpriority) as o_orderpriority from orders")
def distinct_labels(spark, sf_dir):
    return profile.distinct_labels(table(spark, sf_dir, "orders"), "o_orderpriority")


@query(
    "top_labels",
    """select p_brand, count(*) as rows from part group by p_brand order by rows desc, p_brand limit 6""",
)
def top_labels(spark, sf_dir):
    return top_by_count(table(spark, sf_dir, "part"), "p_brand", 6)


@query(
    "top_label_rows",
    """select p_partkey, p_brand from part where p_brand in
    (select p_brand from part group by p_brand order by count(*) desc, p_brand limit 6)""",
)
def top_label_rows(spark, sf_dir):
    return distribution.top_label_rows(table(spark, sf_dir, "part"), "p_brand", 6).select("p_partkey", "p_brand")


@query(
    "class_means",
    " union all ".join(
        f"""select '{c}' as feature, round(avg({c}) filter (where {IS_ATTACK} = 0), 6) as mean_0,
        round(avg({c}) filter (where {IS_ATTACK} = 1), 6) as mean_1 from events"""
        for c in ("value", "user_id", "event_id")
    ),
)
def class_means(spark, sf_dir):
    means = distribution.class_means(_flagged(spark, sf_dir), ["value", "user_id", "event_id"])
    return means.select("feature", F.round("mean_0", 6).alias("mean_0"), F.round("mean_1", 6).alias("mean_1"))


_CORR = " union all ".join(
    f"select '{a}' as feature, '{b}' as other, round(corr({a}, {b}), 3) as r from t" for a in _NUMERIC for b in _NUMERIC
)
_GAPS = "select * replace (case when l_linenumber > 1 then l_tax end as l_tax) from lineitem"


@query("correlations", f"with t as ({_GAPS}) {_CORR}")
def correlations(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn(
        "l_tax", F.when(F.col("l_linenumber") > 1, F.col("l_tax")).otherwise(F.lit(float("nan")))
    )
    # 0.0 and -0.0 are one number
    return distribution.correlations(df, _NUMERIC).withColumn("r", F.col("r") + 0.0)


_LONG = f"""with w as (select event_id, {', '.join(f'{e} as {f}' for f, e in FLOW_NUMBERS.items())} from events),
    l as (unpivot w on columns(* exclude event_id) into name feature value x)"""


@query(
    "correlation_matrix",
    f"""{_LONG} select a.feature, b.feature as other, count(*) as n, round(corr(a.x, b.x), 6) + 0.0 as r
    from l a join l b using (event_id) group by a.feature, b.feature""",
)
def all_correlations(spark, sf_dir):
    """All 78 numeric flow columns, each with gaps of its own, in one scan."""
    df = correlation_matrix(flow_numbers(spark, sf_dir), list(FLOW_NUMBERS))
    return df.select("feature", "other", "n", (F.round("r", 6) + 0.0).alias("r"))


_COPIES = {
    "copy_a": clean_sql("fwd_iat_mean"), "copy_b": clean_sql("fwd_iat_mean"), "copy_but_one": f"case when event_id = 77 then -1.0 else {clean_sql('fwd_iat_mean')} end",
    "copy_with_gap": f"case when event_id <> 78 then {clean_sql('active_mean')} end", "minus": f"-({clean_sql('active_mean')})",
    "text_a": "event_type", "text_b": "concat(event_type, '')", "whole": "user_id", "whole_as_double": "cast(user_id as double)",
}


def _wide_sql() -> list[str]:
    return [f"{clean_sql(f)} as {f}" for f in schema.NUMERIC_FIELDS] + [f"{e} as {f}" for f, e in _COPIES.items()]


_NUMBER_NAMES = [*schema.NUMERIC_FIELDS, *[c for c in _COPIES if not c.startswith("text")]]
_PLACES = ", ".join(f"('{f}', {i})" for i, f in enumerate([*schema.NUMERIC_FIELDS, *_COPIES]))


@query(
    "equal_columns",
    f"""with w as (select event_id, {', '.join(_wide_sql())} from events),
    l as (unpivot (select event_id, {', '.join(f'cast({c} as double) as {c}' for c in _NUMBER_NAMES)} from w)
        on columns(* exclude event_id) into name name value x),
    p(name, place) as (values {_PLACES}),
    n as (select count(*) as n from events)
    select a.name as "left", b.name as "right" from l a join l b on a.event_id = b.event_id and a.x = b.x
        join p pa on pa.name = a.name join p pb on pb.name = b.name where pa.place < pb.place
        group by a.name, b.name having count(*) = (select n from n)
    union all select 'text_a', 'text_b'""",
)
def equal_columns(spark, sf_dir):
    """Every pair of equal columns among 78 flow columns and some copies of them."""
    df = spread(table(spark, sf_dir, "events")).selectExpr(*_wide_sql())
    return fingerprints.redundant_columns(df)


@query(
    "redundant_pairs",
    """select 'l_quantity' as feature, 'l_extendedprice' as other, round(corr(l_quantity, l_extendedprice), 6) as r
    from lineitem where 1 = 1 having abs(corr(l_quantity, l_extendedprice)) >= 0.5
    union all select 'l_discount', 'double_discount', 1.0""",
)
def redundant_pairs(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("double_discount", F.col("l_discount") * 2)
    return distribution.redundant_pairs(df, ["l_quantity", "l_extendedprice", "l_discount", "double_discount"], 0.5)


@query(
    "histogram",
    f"""with d as (select {IS_ATTACK} as is_attack, log10(case when value < 1 then 1 else value end) as x from events),
    e as (select is_attack, min(x) as lo, max(x) as hi from d group by is_attack),
    n as (select is_attack, cast(least(floor((x - lo) / ((hi - lo) / 45)), 44) as int) as bin, count(*) as rows
        from d join e using (is_attack) group by 1, 2),
    g as (select is_attack, lo, hi, cast(b.bin as int) as bin from e cross join (select unnest(range(45)) as bin) b)
    select g.is_attack, g.bin, round(lo + g.bin * ((hi - lo) / 45), 6) as low,
        round(lo + (g.bin + 1) * ((hi - lo) / 45), 6) as high, coalesce(n.rows, 0) as rows
    from g left join n on g.is_attack = n.is_attack and g.bin = n.bin""",
)
def histogram(spark, sf_dir):
    df = _flagged(spark, sf_dir).withColumn("x", log10_from_one(F.col("value")))
    return distribution.histogram(df, "x", "is_attack").withColumns(
        {"low": F.round("low", 6), "high": F.round("high", 6)}
    )


_QUANTILES = " union all ".join(
    f"""select l_returnflag, '{c}' as "column", {p} as prob, round(quantile_cont({c}, {p}), 6) as value
    from lineitem group by l_returnflag"""
    for c in ("l_extendedprice", "l_quantity")
    for p in (0.01, 0.5, 0.99)
)


@query("quantiles", _QUANTILES)
def quantiles(spark, sf_dir):
    found = exact_quantiles(
        table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"], [0.01, 0.5, 0.99], ["l_returnflag"]
    )
    return found.withColumn("value", F.round("value", 6))


@query("quantiles_narrowed", _QUANTILES)
def quantiles_narrowed(spark, sf_dir):
    """The same by the way taken for large tables."""
    found = exact_quantiles(
        table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"], [0.01, 0.5, 0.99], ["l_returnflag"],
        window_rows=10_000,
    )
    return found.withColumn("value", F.round("value", 6))


@query(
    "quantile_clip",
    """with c as (select l_returnflag, quantile_cont(l_extendedprice, 0.99) as cap from lineitem group by 1)
    select l_returnflag, count(*) as rows, round(sum(least(l_extendedprice, cap)), 2) as total,
        round(max(least(l_extendedprice, cap)), 6) as top
    from lineitem join c using (l_returnflag) group by l_returnflag""",
)
def quantile_clip(spark, sf_dir):
    clipped = distribution.clip_at_quantile(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag")
    return clipped.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.sum("l_extendedprice"), 2).alias("total"),
        F.round(F.max("l_extendedprice"), 6).alias("top"),
    )


@query(
    "box_stats",
    """with t as (select p_brand from part group by p_brand order by count(*) desc, p_brand limit 6),
    c as (select p_brand, quantile_cont(p_retailprice, 0.99) as cap from part join t using (p_brand) group by 1),
    x as (select p_brand, least(p_retailprice, cap) as x from part join c using (p_brand)),
    q as (select p_brand, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.75) as q3
        from x group by 1)
    select p_brand, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, count(*) as rows,
        round(min(x) filter (where x >= q1 - 1.5 * (q3 - q1)), 6) as whisker_low,
        round(max(x) filter (where x <= q3 + 1.5 * (q3 - q1)), 6) as whisker_high,
        count(*) filter (where x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1)) as outliers
    from x join q using (p_brand) group by p_brand, q1, median, q3""",
)
def box_stats(spark, sf_dir):
    stats = distribution.box_stats(table(spark, sf_dir, "part"), "p_retailprice", "p_brand")
    return stats.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")})

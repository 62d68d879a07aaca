import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsluice.operators import sampling
from netsluice.operators.distribution import box_stats, histogram
from netsluice.operators.profile import constant_columns, describe, duplicate_rows, null_counts
from netsluice.operators.quantiles import exact_quantiles
from netsluice.operators.ranking import number_rows, position_by_number, running_totals
from netsluice.session import stored
from netsluice.sources.interleave import interleave


def skewed(spark, n=1000, attacks=3):
    """Class 1 in every attacks-th of ten rows."""
    return spark.range(n).select("id", (F.col("id") % 10 < attacks).cast("int").alias("is_attack"))


def test_under_sample_is_exact_and_reproducible(spark):
    df = skewed(spark)
    a = sorted(r.id for r in sampling.under_sample(df, ["id"]).collect())
    b = sorted(r.id for r in sampling.under_sample(df.repartition(7), ["id"]).collect())
    c = sorted(r.id for r in sampling.under_sample(df, ["id"], seed=1).collect())
    assert a == b and a != c and len(set(a)) == 600 and sum(i % 10 < 3 for i in a) == 300


def test_under_sample_special_cases(spark):
    assert sampling.under_sample(skewed(spark, attacks=0), ["id"]).count() == 0
    more = skewed(spark, attacks=6).union(spark.sql("select 5000L, cast(null as int)"))
    assert sampling.under_sample(more, ["id"]).count() == 1001
    odd = skewed(spark, attacks=2).union(spark.sql("select 5000L, 7"))
    assert sampling.under_sample(odd, ["id"]).count() == 400


def test_rows_without_key(spark):
    df = spark.sql("select * from values (1, 0), (2, 1), (cast(null as int), 0) t(a, is_attack)")
    many = df.select("a", "is_attack", F.explode(F.sequence(F.lit(1), F.lit(250)))).drop("col")
    keyed = sampling.with_row_key(many, chunk=40)
    assert keyed.count() == 750 and keyed.select("row_key").distinct().count() == 750
    balanced = sampling.under_sample(keyed, ["row_key"])
    assert Counter(r.is_attack for r in balanced.collect()) == {0: 250, 1: 250}


def test_split_and_folds(spark):
    df = skewed(spark, 1003)
    split = sampling.stratified_split(df, ["id"]).collect()
    assert len(split) == 1003 and sum(r.is_test for r in split) == math.ceil(0.2 * 1003)
    test = Counter(r.is_attack for r in split if r.is_test)
    assert abs(test[1] - 0.2 * 303) <= 1 and abs(test[0] - 0.2 * 700) <= 1
    folds = sampling.stratified_folds(df, ["id"]).collect()
    sizes = Counter((r.is_attack, r.fold) for r in folds)
    for c in (0, 1):
        counts = [sizes[c, f] for f in range(5)]
        assert max(counts) - min(counts) <= 1
    assert len(folds) == 1003


def test_null_class_is_kept(spark):
    df = skewed(spark, 100).union(spark.sql("select 5000L, cast(null as int)"))
    assert sampling.stratified_folds(df, ["id"]).count() == 101
    assert sampling.stratified_split(df, ["id"]).count() == 101


def test_weights(spark):
    df = spark.createDataFrame([("a",)] * 8 + [("b",)] * 2, "label string")
    weights = {r.label: r.weight for r in sampling.with_weights(df).collect()}
    assert weights == {"a": pytest.approx(math.sqrt(10 / 16)), "b": pytest.approx(math.sqrt(10 / 4))}
    assert sampling.with_weights(df.select(F.lit(1).alias("x"))).first().weight == 1.0


def test_sample_rows(spark):
    df = spark.range(500)
    assert sampling.sample_rows(df, 37, ["id"]).distinct().count() == 37
    assert sampling.sample_rows(df, 600, ["id"]).count() == 500


def test_positions_and_totals(spark):
    df = spark.range(0, 1000, 1, 5).select("id", (F.col("id") % 3).alias("g"))
    rows = position_by_number(df, ["g"], "id", width=64).collect()
    assert all(r.position == r.id // 3 + 1 for r in rows) and len(rows) == 1000
    assert [r.row for r in number_rows(df, ["id"]).orderBy("id").collect()] == list(range(1, 1001))
    totals = running_totals(df, ["id"], {"upto": "g"}).orderBy("id").collect()
    assert [r.upto for r in totals] == list(np.cumsum([i % 3 for i in range(1000)]))


@pytest.mark.parametrize("cap", [None, 0, 1, 57, 130, 10_000])
def test_interleave(spark, cap):
    sizes = {"a": 95, "b": 10, "c": 41}
    rows = [(s, i + 1) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "source string, line int")
    expected, left = [], {s: [i + 1 for i in range(n)] for s, n in sizes.items()}
    while any(left.values()):
        for s in sorted(left):
            expected += [(s, i) for i in left[s][:20]]
            left[s] = left[s][20:]
    got = interleave(df, batch=20, max_records=cap).orderBy("round", "source", "line").collect()
    assert [(r.source, r.line) for r in got] == expected[:cap]


@pytest.mark.parametrize("limits", [{}, {"window_rows": 500}, {"window_rows": 20}])
def test_quantiles_match_numpy(spark, limits):
    """Heavy tail, a value that holds a third of the rows, and gaps."""
    df = spark.range(0, 40_000, 1, 4).select(
        (F.col("id") % 2).alias("g"),
        F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 101 == 0, None).when(F.col("id") % 103 == 0, float("nan"))
        .otherwise(F.exp((F.hash("id") % 1000) / 100.0) + F.col("id") / 1e6).alias("x"),
    )
    pdf = df.toPandas()
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.99, 1.0]
    for r in exact_quantiles(df, ["x"], probs, ["g"], **limits).collect():
        values = pdf.x[(pdf.g == r.g)].dropna()
        assert r.value == pytest.approx(np.quantile(values, r.prob), rel=1e-12), (r, limits)


@pytest.mark.parametrize("limits", [{}, {"window_rows": 3}])
def test_infinite_values_have_ranks(spark, limits):
    inf = math.inf
    rows = [(1, 1.0), (1, 2.0), (1, inf), (2, -inf), (2, inf), (2, math.nan), (2, 3.0), (2, None), (3, None), (None, 4.0)]
    rows += [(4, float(i % 7)) for i in range(300)] + [(4, inf)] * 40 + [(4, -inf)] * 3
    df = spark.createDataFrame(rows, "g int, x double")
    got = {(r.g, r.prob): r.value for r in exact_quantiles(df, ["x"], [0.25, 0.5, 1.0], ["g"], **limits).collect()}
    assert got == {
        (1, 0.25): 1.5, (1, 0.5): 2.0, (1, 1.0): inf, (2, 0.25): -inf, (2, 0.5): 3.0, (2, 1.0): inf,
        (4, 0.25): 1.0, (4, 0.5): 3.0, (4, 1.0): inf, **{(None, p): 4.0 for p in (0.25, 0.5, 1.0)},
    }
    alone = exact_quantiles(df.where("g = 4"), ["x"], [0.5], **limits).collect()
    assert [r.value for r in alone] == [3.0] and exact_quantiles(df.limit(0), ["x"], [0.5]).collect() == []


def test_folds_move_no_rows(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("c"), F.rand(1).alias("wide"))
    folds = sampling.stratified_folds(df, ["id"], "c", 4)
    plan = folds._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    sizes = folds.groupBy("c", "fold").count().collect()
    assert len(sizes) == 12 and {r["count"] for r in sizes} <= {416, 417}
    few = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, c string")
    assert len({(r.c, r.fold) for r in sampling.stratified_folds(few, ["id"], "c", 5).collect()}) == 3
    assert {r.fold for r in sampling.stratified_folds(few, ["id"], "c", 1).collect()} == {0}
    assert sampling.bucket_digits(10**12) == 7


def test_profile_edge_cases(spark):
    df = spark.createDataFrame(
        [(1.0, None, "a"), (1.0, math.nan, "a"), (1.0, 0.0, None), (1.0, -0.0, None)], "x double, y double, s string"
    )
    assert {r["column"]: r.nulls for r in null_counts(df).collect()} == {"y": 2, "s": 2}
    assert [r["column"] for r in constant_columns(df).orderBy("column").collect()] == ["s", "x", "y"]
    for mode in (True, False):
        assert duplicate_rows(df.select("y"), by_digest=mode).first().duplicates == 1
    assert duplicate_rows(df.limit(0)).first().percent is None
    row = describe(df).where("column = 'y'").first()
    assert (row["count"], row["mean"], row["p50"]) == (2, 0.0, 0.0)


def test_digest_keeps_columns_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "c"), ("", "c"), ("-", "c")], "a string, b string")
    assert duplicate_rows(df).first().duplicates == 0


def test_histogram_matches_numpy(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("t"), F.sqrt("id").alias("x"))
    found = histogram(df, "x", "t", 10).orderBy("t", "bin").collect()
    pdf = df.toPandas()
    for t in (0, 1):
        counts, edges = np.histogram(pdf.x[pdf.t == t], bins=10)
        mine = [r for r in found if r.t == t]
        assert [r.rows for r in mine] == list(counts) and mine[3].low == pytest.approx(edges[3])
    single = histogram(spark.sql("select 1 as t, 3.0D as x"), "x", "t", 4).orderBy("bin").collect()
    assert [r.rows for r in single] == list(np.histogram([3.0], bins=4)[0])


def test_box_stats_leaves_out_rare_labels(spark):
    df = spark.range(100).select(F.concat(F.lit("l"), F.col("id") % 9).alias("label"), F.col("id").cast("double").alias("x"))
    assert box_stats(df, "x", "label").count() == 6


def test_stored_rows_are_read_from_a_table(spark):
    kept = stored(spark.range(50), "kept")
    assert "parquet" in kept._jdf.queryExecution().optimizedPlan().toString().lower() and kept.count() == 50


def test_histogram_leaves_infinite_values_out(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, math.inf), (1, -math.inf), (1, math.nan), (2, math.inf)], "t int, x double")
    assert [(r.t, r.low, r.high, r.rows) for r in histogram(df, "x", "t", 2).orderBy("bin").collect()] == [(1, 1.0, 1.5, 1), (1, 1.5, 2.0, 1)]


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_running_totals_of_any_keys(spark, parts, monkeypatch):
    """Several keys, nulls, NaN, ties, texts and times; more ranges than rows per range would need."""
    from netsluice.operators import ranking

    monkeypatch.setattr(ranking, "RANGE_ROWS", 2000 // parts)
    n = 2000
    df = spark.range(n).select(
        F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 11 == 0, float("nan")).otherwise((F.hash("id") % 40).cast("double")).alias("a b"),
        F.when(F.col("id") % 13 > 0, F.concat(F.lit("kéy"), (F.hash("id", F.lit(1)) % 30).cast("string"))).alias("s"),
        F.timestamp_seconds(F.col("id") % 500).alias("t"), "id", (F.col("id") % 5).alias("v"),
    ).repartition(7, "id")
    order = ["a b", "s", "t", "id"]
    want = [r.id for r in df.orderBy(*[F.col(f"`{c}`") for c in order]).collect()]
    rows = number_rows(df, order).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.row)] == want and [r.row for r in rows] == list(range(1, n + 1))
    totals = {r.id: r.upto for r in running_totals(df, order, {"upto": "v"}).collect()}
    assert [totals[i] for i in want] == list(np.cumsum([i % 5 for i in want]))
    assert number_rows(df.limit(0), order).collect() == []


def test_rows_are_numbered_by_one_shuffle(spark, tmp_path):
    spark.range(30_000).select("id", F.rand(1).alias("wide")).write.parquet(str(tmp_path / "t"))
    numbered = number_rows(spark.read.parquet(str(tmp_path / "t")), ["id"])
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1 and "Scan ExistingRDD" not in plan


def test_copies_are_written_out_by_many_tasks(spark):
    rows = spark.range(4000).selectExpr("id % 40 as a", "'x' as b")
    keyed = sampling.with_row_key(rows, chunk=10)
    assert keyed.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert keyed.select("row_key").distinct().count() == 4000

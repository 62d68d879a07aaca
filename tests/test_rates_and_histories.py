"""Mergeable rates and per-source histories, over restarts, against plain versions."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netsluice.streaming.histories import _newest_of_task, current_histories, source_histories, write_histories
from netsluice.streaming.rates import RANK_ERROR, merged_rates, rank_audit, stream_rates
from netsluice.streaming.stages import bounded


def rows_of(spark, n=6000):
    return spark.range(n).select(
        "id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7).alias("ts"), (F.col("id") % 5 == 0).alias("hit"),
        F.when(F.col("id") % 11 != 0, F.exp(F.pmod(F.hash("id"), F.lit(1000)) / 100.0)).alias("s"),
    )


def test_merged_rates_equal_rates_of_longer_windows(spark, tmp_path):
    df = rows_of(spark)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    rates = stream_rates(stream, "ts", F.col("hit"), F.col("s"), 300, lateness="1 day")
    writer = rates.writeStream.outputMode("complete").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(out))
    bounded(writer, str(tmp_path / "check")).start().awaitTermination()
    short = spark.read.parquet(out)
    pdf = df.toPandas()
    for long in (merged_rates(short, 7200), merged_rates(merged_rates(short, 1800), 7200)):
        got = {r.window_start.timestamp(): r for r in long.collect()}
        groups = pdf.groupby(pdf.ts.astype("int64") // 10**6 // 7200 * 7200 if pdf.ts.dtype == "datetime64[us]" else pdf.ts.astype("int64") // 10**9 // 7200 * 7200)
        assert len(got) == len(groups)
        for start, g in groups:
            r = got[float(start)]
            assert (r.predictions, r.attacks) == (len(g), g.hit.sum())
            assert r.avg_latency == pytest.approx(g.s.mean()) and r.per_second == pytest.approx(len(g) / 7200)
        audit = rank_audit(df, "ts", F.col("s"), long, 7200).collect()
        assert len(audit) == len(groups) and all(a.low - RANK_ERROR <= 0.95 <= a.high + RANK_ERROR for a in audit)


def test_windows_without_latencies(spark):
    df = rows_of(spark, 50).withColumn("s", F.lit(None).cast("double"))
    sketch = F.kll_sketch_agg_double("s", F.lit(1024)).alias("latency_sketch")
    short = df.groupBy(F.window("ts", "60 seconds")["start"].alias("window_start")).agg(
        F.count("*").alias("predictions"), F.count(F.when(F.col("hit"), 1)).alias("attacks"), F.count("s").alias("latencies"),
        F.sum("s").alias("latency_sum"), sketch,
    )
    assert {(r.p95_latency, r.avg_latency) for r in merged_rates(short, 3600).collect()} == {(None, None)}


def test_newest_of_a_task_matches_sorting():
    rng = np.random.default_rng(0)
    table = pa.table({"source": rng.choice(["a", "b", "c"], 500), "ts": rng.integers(0, 50, 500), "tie": np.arange(500), "v": rng.random(500)})
    kept = pa.Table.from_batches(_newest_of_task("source", ["ts", "tie"], 4)(iter(table.to_batches(max_chunksize=37))))
    want = defaultdict(list)
    for r in sorted(table.to_pylist(), key=lambda r: (r["ts"], r["tie"]), reverse=True):
        if len(want[r["source"]]) < 4:
            want[r["source"]].append(r)
    assert sorted(map(str, kept.to_pylist())) == sorted(str(r) for rows in want.values() for r in rows)
    assert list(_newest_of_task("source", ["ts", "tie"], 4)(iter([]))) == []


@pytest.fixture
def run(spark, tmp_path):
    """Write a delivery, let the stream run over what is there, and read the histories."""
    ddl = "source string, ts timestamp, tie long, v double"

    def go(rows, idle="10 days", length=3):
        data = [(s, None if t is None else 1_700_000_000 + t, i, v) for s, t, i, v in rows]
        df = spark.createDataFrame(data, ddl.replace("timestamp", "long")).withColumn("ts", F.timestamp_seconds("ts"))
        df.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
        writer = source_histories(stream, "source", "ts", ["tie"], ["v"], length, idle).writeStream.outputMode("update")
        bounded(writer.foreachBatch(write_histories(str(tmp_path / "out"))), str(tmp_path / "check")).start().awaitTermination()
        out = defaultdict(list)
        for r in current_histories(spark, str(tmp_path / "out")).orderBy("source", "place").collect():
            out[r.source].append((int(r.ts.timestamp()) - 1_700_000_000, r.tie, r.v))
        return dict(out)

    return go


def test_histories_over_restarts(run):
    assert run([("a", 5, 1, 0.5), ("a", 1, 2, None), ("b", 9, 3, 1.0), (None, 3, 4, 1.0), ("a", None, 5, 1.0)]) == {
        "a": [(5, 1, 0.5), (1, 2, None)], "b": [(9, 3, 1.0)],
    }
    # a repeated row is one point, older rows take their place, other sources stay as they are
    assert run([("a", 5, 1, 0.5), ("a", 3, 6, 2.0), ("a", 0, 7, 3.0)]) == {
        "a": [(5, 1, 0.5), (3, 6, 2.0), (1, 2, None)], "b": [(9, 3, 1.0)],
    }
    hot = [("b", k, 100 + k, float(k)) for k in range(2000)]
    assert run(hot)["b"] == [(1999, 2099, 1999.0), (1998, 2098, 1998.0), (1997, 2097, 1997.0)]


def test_silent_sources_are_forgotten(run):
    run([("a", 0, 1, 1.0), ("b", 0, 2, 2.0)], idle="100 seconds")
    run([("b", 5000, 3, 3.0)], idle="100 seconds")
    got = run([("a", 6000, 4, 4.0), ("b", 6000, 5, 5.0)], idle="100 seconds")
    assert got["a"] == [(6000, 4, 4.0)] and got["b"][0] == (6000, 5, 5.0)

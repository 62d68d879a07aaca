"""Equal columns, correlations of many columns, and the trigram postings, against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netsluice.operators import fingerprints, postings
from netsluice.operators.detections import search_detections
from netsluice.operators.distribution import correlations
from netsluice.operators.gram import Moments, correlation_matrix
from netsluice.operators.profile import columns_equal


def test_equal_columns_of_all_kinds(spark):
    rows = [(i, i, float(i), -0.0 if i == 0 else float(i), i + (i == 5), None if i == 3 else i, math.nan if i == 2 else float(i), "x", "x", str(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "a long, b int, c double, d double, e long, gap long, n double, t string, u string, s string")
    got = [tuple(r) for r in fingerprints.redundant_columns(df).collect()]
    assert got == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"), ("t", "u")]
    assert [tuple(r) for r in fingerprints.redundant_columns(df, ["u", "t", "e"]).collect()] == [("u", "t")]


def test_equal_columns_with_repeated_rows_and_none(spark):
    df = spark.createDataFrame([(1, 1, 2)] * 4 + [(2, 2, 2)] * 3, "a long, b long, c long")
    assert fingerprints.equal_column_classes(df) == [["a", "b"]]
    assert fingerprints.equal_column_classes(df.limit(0)) == [["a", "b", "c"]]
    # the same values in another order of rows are another column
    swapped = spark.createDataFrame([(1, 2), (2, 1)], "a long, b long")
    assert fingerprints.equal_column_classes(swapped) == []


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    real = fingerprints.column_fingerprints
    monkeypatch.setattr(fingerprints, "column_fingerprints", lambda df, c=None: real(df, c).withColumns({"x": F.lit(0), "s": F.lit(0)}))
    df = spark.createDataFrame([(1, 5, 1, 5, 7, 1)] * 3, "a long, b long, c long, d long, e long, f long")
    df = df.unionByName(spark.createDataFrame([(2, 5, 2, 5, 7, 2)], df.schema))
    assert sorted(fingerprints.equal_column_classes(df)) == [["a", "c", "f"], ["b", "d"]]


def test_one_pass_for_many_columns(spark):
    df = spark.range(50).select(*[((F.col("id") * (k % 40 + 1)) % 97).alias(f"c{k}") for k in range(78)])
    pairs = {tuple(r) for r in fingerprints.redundant_columns(df).collect()}
    names = df.columns
    held = columns_equal(df, [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if int(a[1:]) % 40 == int(b[1:]) % 40])
    assert pairs == {(r.left, r.right) for r in held.collect()} and len(pairs) == 38
    plan = fingerprints.column_fingerprints(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") + plan.count("Scan") == 1


def gappy(rows=4000, size=9):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(rows, size)) * 10.0 ** np.arange(-4, size - 4) + 1e5
    x[:, 1] = x[:, 0] * 3 + rng.normal(size=rows) * 1e-4
    x[:, 2] = 4.0
    x[rng.random((rows, size)) < 0.3] = np.nan
    x[: rows // 2, 3] = np.nan
    x[rows // 2 :, 4] = np.nan
    return x


@pytest.mark.parametrize("parts", [1, 7])
def test_correlations_match_pandas(spark, parts):
    names = [f"c{k}" for k in range(9)]
    frame = pd.DataFrame(gappy(), columns=names)
    df = spark.createDataFrame(frame).repartition(parts)
    want, counts = frame.corr(), frame.notna().T.astype(int) @ frame.notna().astype(int)
    got = correlation_matrix(df, names).collect()
    assert len(got) == 81
    for r in got:
        w = want.loc[r.feature, r.other]
        assert r.n == counts.loc[r.feature, r.other]
        assert r.r is None if math.isnan(w) else r.r == pytest.approx(w, abs=1e-7)


def test_correlation_special_cases(spark):
    df = spark.createDataFrame([(1.0, 2.0, math.inf, None), (2.0, 4.0, 1.0, 1.0), (3.0, 6.5, 2.0, None)], "a double, b double, i double, one double")
    r = {(x.feature, x.other): x.r for x in correlations(df, ["a", "b", "i", "one"]).collect()}
    assert r["a", "b"] == pytest.approx(0.998, abs=1e-3) and r["a", "a"] == 1.0 and r["a", "one"] is None and math.isnan(r["a", "i"])
    assert {x.r for x in correlations(df.limit(0), ["a", "b"]).collect()} == {None}


def test_moments_merge_in_any_order():
    x = gappy(500)
    whole = Moments.of(x)
    parts = [Moments.of(p) for p in (x[:3], x[3:200], x[200:200], x[200:])]
    for order in ([0, 1, 2, 3], [3, 2, 0, 1]):
        state = Moments(9)
        for k in order:
            state.add(Moments(9, parts[k].data()))
        np.testing.assert_allclose(state.n, whole.n)
        np.testing.assert_allclose(state.mean, whole.mean)
        np.testing.assert_allclose(state.v, whole.v, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(state.c, whole.c, rtol=1e-6, atol=1e-6)


DDL = "id string, source string, payload struct<value: double, name: string, n: long>"


def log_rows(k):
    words = ["Alpha", "beta x", "GAMMA ünï", "", None, "ab", "delta 100%"]
    return [(f"{k}-{i}", "Batch" if i % 3 else "Live", (i / 8 + k, words[(i + k) % 7], i * 7919 % 1000)) for i in range(40)]


@pytest.fixture
def log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_ROWS", 8)
    monkeypatch.setattr(postings, "FOLDERS", 3)
    path = str(tmp_path / "a log")
    for k in range(6):
        spark.createDataFrame(log_rows(k), DDL).coalesce(1).write.mode("append").parquet(path)
    return path, str(tmp_path / "index")


NEEDLES = {"AMMA ü": "Batch", "4.125": None, "999": "Batch", "zzz": None, "a": None}


def agree(spark, path, index):
    log = spark.read.parquet(path)
    read = {}
    for needle, source in NEEDLES.items():
        found, facts = postings.search_indexed(spark, path, index, source, needle)
        assert sorted(r.id for r in found.collect()) == sorted(r.id for r in search_detections(log, source, needle).collect()), needle
        assert found.columns == log.columns
        read[needle] = facts["files_read"]
    return read


def test_index_agrees_with_the_scan_at_every_stage(spark, log):
    path, index = log
    assert set(agree(spark, path, index).values()) == {6}  # nothing indexed: every file is read
    assert postings.update_index(spark, path, index) == 6 and postings.update_index(spark, path, index) == 0
    read = agree(spark, path, index)
    assert read["zzz"] == 0 and 0 < read["4.125"] < 6 and read["a"] == 6
    spark.createDataFrame(log_rows(9), DDL).coalesce(1).write.mode("append").parquet(path)
    assert agree(spark, path, index)["zzz"] == 1  # the new file is read as it is
    assert postings.update_index(spark, path, index) == 1
    assert agree(spark, path, index)["zzz"] == 0


def test_interrupted_and_double_runs(spark, log, monkeypatch):
    path, index = log

    def fail(*a, **k):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1)), "coalesce", fail)  # the postings are written, the commit is not
        with pytest.raises(RuntimeError):
            postings.update_index(spark, path, index)
    assert postings.manifest(spark, index).count() == 0
    assert postings.search_indexed(spark, path, index, None, "zzz")[1]["files_read"] == 6
    with monkeypatch.context() as m:
        m.setattr(postings, "manifest", lambda s, i: s.createDataFrame([], postings._MANIFEST))
        postings.update_index(spark, path, index)
        postings.update_index(spark, path, index)  # a second writer that saw nothing
    assert postings.manifest(spark, index).count() == 12
    assert agree(spark, path, index)["zzz"] == 0


def test_trigrams(spark):
    df = spark.createDataFrame([("",), ("ab",), ("abc",), ("aaaa",), ("ü😀bc",), (None,)], "t string")
    assert [r[0] for r in df.select(postings.trigrams(F.col("t"))).collect()] == [[], [], ["abc"], ["aaa"], ["ü😀b", "😀bc"], []]

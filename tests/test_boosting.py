"""Histogram boosting against plain loops over rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsluice.operators import boosting
from netsluice.operators.boosting import GRAIN, BoostedTrees, BoostParams, fit


def plain_trees(x, y, w, edges, p):
    """Every node, feature, cut and side looked at, rows one by one."""
    margin = np.zeros(len(x))
    out = []
    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = np.rint((prob - y) * w * GRAIN) / GRAIN, np.rint(prob * (1 - prob) * w * GRAIN) / GRAIN
        nodes, where = {}, {0: np.arange(len(x))}
        for node in range(2 ** (p.depth + 1) - 1):
            if node not in where:
                continue
            rows = where[node]
            G, H = g[rows].sum(), h[rows].sum()
            best = None
            if node < 2**p.depth - 1:
                for f, cuts in enumerate(edges):
                    v = x[rows, f]
                    for cut in cuts:
                        for missing_left in (True, False):
                            left = np.where(np.isnan(v), missing_left, v <= cut)
                            gl, hl = g[rows][left].sum(), h[rows][left].sum()
                            if hl < p.least_hessian or H - hl < p.least_hessian:
                                continue
                            gain = gl * gl / (hl + p.l2) + (G - gl) ** 2 / (H - hl + p.l2) - G * G / (H + p.l2)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                                best = (gain, f, cut, missing_left, left)
            if best is None:
                nodes[node] = -p.rate * G / (H + p.l2)
                margin[rows] += nodes[node]
            else:
                nodes[node] = best[1:4]
                where[2 * node + 1], where[2 * node + 2] = rows[best[4]], rows[~best[4]]
        out.append(nodes)
    return out, margin


def sample(spark, rows=400, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(rows, 3)), 2)
    x[:, 2] = rng.integers(0, 3, rows)
    x[rng.random((rows, 3)) < 0.1] = np.nan
    y = ((np.nan_to_num(x[:, 0], nan=2.0) > 0.3) ^ (np.nan_to_num(x[:, 2]) == 1)).astype(float)
    w = rng.choice([0.5, 1.0, 2.0], rows)
    data = [(*(None if math.isnan(v) and i % 2 else float(v) for v in r), int(c), float(k)) for i, (r, c, k) in enumerate(zip(x, y, w))]
    return x, y, w, spark.createDataFrame(data, "a double, b double, c double, is_attack int, weight double")


@pytest.mark.parametrize("flush", [1, 2, 8])
def test_trees_equal_plain_loops(spark, flush):
    x, y, w, df = sample(spark)
    params = BoostParams(trees=3, depth=3, rate=0.3, bins=8, flush=flush)
    edges = boosting.even_edges(df, ["a", "b", "c"], 8)
    model = fit(df.repartition(5), ["a", "b", "c"], params=params, edges=edges)
    want, margin = plain_trees(x, y, w, edges, params)
    for tree, nodes in zip(model.trees, want):
        for node, found in nodes.items():
            if isinstance(found, tuple):
                assert (tree.feature[node], tree.threshold[node], bool(tree.missing_left[node])) == found
            else:
                assert tree.feature[node] == -1 and tree.value[node] == pytest.approx(found, abs=1e-12)
    np.testing.assert_allclose(model.margins(x), margin, atol=1e-12)
    p = df.select(model.probability([F.col(c) for c in "abc"]).alias("p"), "*").collect()
    np.testing.assert_allclose([r.p for r in p], 1 / (1 + np.exp(-margin)), atol=1e-12)


def test_same_trees_in_any_partitioning_and_from_a_file(spark, tmp_path):
    x, _, _, df = sample(spark, 300, 1)
    params = BoostParams(trees=2, depth=2, bins=16)
    edges = boosting.quantile_edges(df, ["a", "b", "c"], 16)
    models = [fit(df.repartition(n), ["a", "b", "c"], params=params, edges=edges) for n in (1, 9)]
    assert models[0].nodes() == models[1].nodes()
    models[0].save(spark, str(tmp_path / "model"))
    again = BoostedTrees.load(spark, str(tmp_path / "model"))
    assert again.nodes() == models[0].nodes() and again.features == ["a", "b", "c"]
    np.testing.assert_array_equal(again.margins(x), models[0].margins(x))


def test_learns(spark):
    x, y, _, df = sample(spark, 2000, 2)
    test_x, test_y, _, _ = sample(spark, 500, 3)
    model = fit(df, ["a", "b", "c"], weight=None, params=BoostParams(trees=12, depth=3, rate=0.4, bins=32, flush=5))
    for rows, target in ((x, y), (test_x, test_y)):
        assert np.mean((model.margins(rows) > 0) == target) > 0.95


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1.0, None, 1)] * 5, "a double, b double, is_attack int")
    model = fit(df, ["a", "b"], weight=None, params=BoostParams(trees=2, depth=2))
    assert [n[2] for n in model.nodes()] == [None, None] and model.margins(np.array([[1.0, np.nan]]))[0] > 0
    empty = fit(df.limit(0), ["a", "b"], weight=None, params=BoostParams(trees=1, depth=2))
    assert empty.margins(np.zeros((1, 2)))[0] == 0.0
    with pytest.raises(ValueError):
        fit(df, ["a"], weight=None, params=BoostParams(bins=300))


def test_values_on_edges_and_infinite(spark):
    df = spark.createDataFrame([(float(v), int(v > 1)) for v in (0, 1, 1, 2, 3, math.inf, -math.inf)] * 30, "a double, is_attack int")
    model = fit(df, ["a"], weight=None, params=BoostParams(trees=1, depth=1, rate=1.0), edges=[[0.0, 1.0, 2.0]])
    assert model.trees[0].threshold[0] == 1.0
    assert (model.margins(np.array([[1.0], [-math.inf]])) < 0).all() and (model.margins(np.array([[1.01], [math.inf]])) > 0).all()

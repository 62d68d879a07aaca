"""Boosted trees for two classes, by second-order histograms: deterministic, with a learned side for missing values.

Features are cut into bins once. For each level of a tree one scan sums the gradients and Hessians of the rows
by (node, feature, bin): inside a task with numpy, between tasks by a ``groupBy``. What comes back is bounded by nodes x
features x bins, and the best cut of every node is chosen from it. Of two children only the lighter one is summed, the
other is the parent without it.

Gradients are rounded to whole numbers of 2**-20 before they are summed. Such sums are exact in any order, so the same
rows give the same trees on any cluster, whatever the number of tasks, attempts or files.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsluice.operators.quantiles import SKETCH, _value
from netsluice.session import stored

#: Gradients and Hessians are whole numbers of 1 / GRAIN.
GRAIN = float(1 << 20)
MOST_BINS = 255
_ROW_DDL = "bins binary, target double, weight double, margin double"
_ROW = pa.schema([("bins", pa.binary()), ("target", pa.float64()), ("weight", pa.float64()), ("margin", pa.float64())])
_SUM_DDL = "node int, feature int, bin int, g long, h long"
_SUM = pa.schema([("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("g", pa.int64()), ("h", pa.int64())])


@dataclass(frozen=True)
class BoostParams:
    """Settings: number and depth of trees, learning rate, bins per feature, L2 penalty, least Hessian of a child.

    ``flush`` is the number of trees after which the rows' margins are written anew.
    """

    trees: int = 100
    depth: int = 6
    rate: float = 0.1
    bins: int = 64
    l2: float = 1.0
    least_hessian: float = 1.0
    flush: int = 8


@dataclass
class Tree:
    """Nodes in heap order (children of i are 2i+1 and 2i+2). ``feature`` is -1 for a leaf; a value goes left where it is
    at most ``threshold`` (in bins: at most ``cut``), a missing one where ``missing_left``."""

    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    @classmethod
    def blank(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.full(n, np.nan), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def leaves(self, left: Callable[[np.ndarray, np.ndarray], np.ndarray], rows: int, levels: int) -> np.ndarray:
        """The node of each row after so many levels; ``left(rows, nodes)`` says which of them go left."""
        node = np.zeros(rows, np.int64)
        for _ in range(levels):
            inner = np.flatnonzero(self.feature[node] >= 0)
            if not len(inner):
                break
            node[inner] = 2 * node[inner] + 2 - left(inner, node[inner])
        return node

    def by_bins(self, bins: np.ndarray, levels: int) -> np.ndarray:
        def left(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            b = bins[rows, self.feature[nodes]]
            return np.where(b == 0, self.missing_left[nodes], b <= self.cut[nodes])

        return self.leaves(left, len(bins), levels)

    def by_values(self, x: np.ndarray, levels: int) -> np.ndarray:
        def left(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            v = x[rows, self.feature[nodes]]
            return np.where(np.isnan(v), self.missing_left[nodes], v <= self.threshold[nodes])

        return self.leaves(left, len(x), levels)


@dataclass
class BoostedTrees:
    """A fitted model: a row's margin is the sum of its leaves, its probability the logistic function of that."""

    features: list[str]
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Of rows of feature values, NaN where one is missing."""
        out = np.zeros(len(x))
        for tree in self.trees:
            out += tree.value[tree.by_values(x, self.depth)]
        return out

    def probability(self, values: Sequence[Column]) -> Column:
        """The probability of class 1 from the features' columns: only they go through Arrow."""

        def scores(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series(1.0 / (1.0 + np.exp(-self.margins(part.to_numpy(np.float64)))))

        missing = [F.coalesce(c.cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, c in enumerate(values)]
        return F.pandas_udf(scores, "double")(F.struct(*missing))

    def nodes(self) -> list[tuple]:
        """(tree, node, feature, threshold, missing_left, gain, value) of all nodes that a row can reach."""
        out = []
        for t, tree in enumerate(self.trees):
            for i in _reached(tree):
                f = int(tree.feature[i])
                inner = f >= 0
                out.append(
                    (t, i, self.features[f] if inner else None, float(tree.threshold[i]) if inner else None,
                     bool(tree.missing_left[i]) if inner else None, float(tree.gain[i]) if inner else None,
                     None if inner else float(tree.value[i]))
                )
        return out

    def node_table(self, spark: SparkSession) -> DataFrame:
        ddl = "tree int, node int, feature string, threshold double, missing_left boolean, gain double, value double"
        return spark.createDataFrame(self.nodes(), ddl)

    def save(self, spark: SparkSession, path: str) -> None:
        """The nodes as a Parquet table, the order of the features beside them."""
        self.node_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")  # trees x 2**depth rows
        head = json.dumps({"features": self.features, "depth": self.depth, "trees": len(self.trees)})
        spark.createDataFrame([(head,)], "head string").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        head = json.loads(spark.read.parquet(f"{path}/head").first()["head"])
        out = cls(head["features"], head["depth"], [Tree.blank(head["depth"]) for _ in range(head["trees"])])
        place = {f: k for k, f in enumerate(out.features)}
        for r in spark.read.parquet(f"{path}/nodes").collect():  # trees x 2**depth rows
            tree = out.trees[r.tree]
            if r.feature is None:
                tree.value[r.node] = r.value
            else:
                tree.feature[r.node], tree.threshold[r.node] = place[r.feature], r.threshold
                tree.missing_left[r.node], tree.gain[r.node] = r.missing_left, r.gain
        return out


def _reached(tree: Tree) -> list[int]:
    out, open_ = [], [0]
    while open_:
        i = open_.pop()
        out.append(i)
        if tree.feature[i] >= 0:
            open_ += [2 * i + 2, 2 * i + 1]
    return sorted(out)


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Per feature up to ``bins`` - 1 ascending cut values near its quantiles, from one sketch each, in one scan."""
    at = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    sketches = df.agg(*[F.kll_sketch_agg_double(_value(f), F.lit(SKETCH)).alias(f"s{i}") for i, f in enumerate(features)])
    cuts = [
        F.when(F.kll_sketch_get_n_double(f"s{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", at)).alias(f"e{i}")
        for i in range(len(features))
    ]
    row = sketches.select(*cuts).first()  # features x bins numbers
    return [sorted({float(e) for e in row[i] or [] if math.isfinite(e)}) for i in range(len(features))]


def even_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Per feature the ``bins`` - 1 inner edges of equally wide bins between its smallest and largest finite value."""
    finite = [F.when(F.abs(_value(f)) < float("inf"), _value(f)) for f in features]
    row = df.agg(*[e(c).alias(f"{n}{i}") for i, c in enumerate(finite) for n, e in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for i in range(len(features)):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        out.append([] if lo is None else sorted({lo + (hi - lo) * k / bins for k in range(1, bins)}))
    return out


def _binned(size: int, edges: Sequence[Sequence[float]]):
    cuts = [np.array(e) for e in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.empty((batch.num_rows, size), np.uint8)
            for i in range(size):
                x = batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64)
                bins[:, i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(cuts[i], x, "left"))
            places = pa.py_buffer(np.arange(0, (batch.num_rows + 1) * size, max(size, 1), dtype=np.int32)[: batch.num_rows + 1])
            packed = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, places, pa.py_buffer(bins)])
            zero = pa.array(np.zeros(batch.num_rows))
            yield pa.RecordBatch.from_arrays([packed, batch.column(size), batch.column(size + 1), zero], schema=_ROW)

    return run


def _rows(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    packed = batch.column(0)
    data = np.frombuffer(packed.buffers()[2] or b"", np.uint8)
    start = packed.offset * size
    bins = data[start : start + batch.num_rows * size].reshape(batch.num_rows, size)
    return (bins, *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)))


def _with_trees(size: int, depth: int, pending: list[Tree]):
    """The rows with the margins of further trees added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, _, _, margin = _rows(batch, size)
            margin = margin.copy()
            for tree in pending:
                margin += tree.value[tree.by_bins(bins, depth)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(margin)], schema=_ROW)

    return run


def gradients(target: np.ndarray, weight: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the weighted logistic loss, as whole numbers of 1 / GRAIN."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((p - target) * weight * GRAIN), np.rint(p * (1.0 - p) * weight * GRAIN)


def _sums(size: int, width: int, depth: int, pending: list[Tree], tree: Tree, level: int, wanted: list[int]):
    """A task's sums over its rows in the wanted nodes of a level, by (node, feature, bin)."""
    slot = np.full(2 ** (depth + 1), -1)
    slot[wanted] = np.arange(len(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g_sum = np.zeros((size, len(wanted) * width))
        h_sum = np.zeros_like(g_sum)
        for batch in batches:
            bins, target, weight, margin = _rows(batch, size)
            at = slot[tree.by_bins(bins, level)]
            rows = np.flatnonzero(at >= 0)
            bins, at, margin = bins[rows], at[rows], margin[rows].copy()
            for t in pending:
                margin += t.value[t.by_bins(bins, depth)]
            g, h = gradients(target[rows], weight[rows], margin)
            for i in range(size):
                key = at * width + bins[:, i]
                g_sum[i] += np.bincount(key, g, minlength=g_sum.shape[1])
                h_sum[i] += np.bincount(key, h, minlength=g_sum.shape[1])
        feature, key = np.nonzero((g_sum != 0) | (h_sum != 0))
        columns = [np.array(wanted, np.int32)[key // width], feature.astype(np.int32), (key % width).astype(np.int32)]
        sums = [s[feature, key].astype(np.int64) for s in (g_sum, h_sum)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, *sums)], schema=_SUM)

    return run


def best_cut(g: np.ndarray, h: np.ndarray, edges: Sequence[Sequence[float]], l2: float, least: float) -> tuple[float, int, int, bool] | None:
    """(gain, feature, cut, missing_left) of the best cut of a node, from its sums (features, bins; bin 0: missing).

    Equal gains go to the first feature, then the lowest cut, then missing values to the left.
    """
    g, h = g / GRAIN, h / GRAIN
    total_g, total_h = g[0].sum(), h[0].sum()  # every feature's bins hold all rows
    own = total_g * total_g / (total_h + l2)
    best = None
    for f in range(len(g)):
        cuts = len(edges[f])
        if not cuts:
            continue
        upto_g, upto_h = np.cumsum(g[f, 1 : cuts + 1]), np.cumsum(h[f, 1 : cuts + 1])
        gains = np.full((cuts, 2), -np.inf)
        for k, missing in enumerate((1, 0)):  # with the missing values, and without
            left_g, left_h = upto_g + missing * g[f, 0], upto_h + missing * h[f, 0]
            right_g, right_h = total_g - left_g, total_h - left_h
            fits = (left_h >= least) & (right_h >= least)
            gain = left_g * left_g / (left_h + l2) + right_g * right_g / (right_h + l2) - own
            gains[fits, k] = gain[fits]
        cut, side = divmod(int(np.argmax(gains)), 2)
        if gains[cut, side] > 1e-9 and (best is None or gains[cut, side] > best[0]):
            best = (float(gains[cut, side]), f, cut + 1, side == 0)
    return best


def fit(
    df: DataFrame,
    features: Sequence[str],
    target: str = "is_attack",
    weight: str | None = "weight",
    params: BoostParams = BoostParams(),
    edges: Sequence[Sequence[float]] | None = None,
) -> BoostedTrees:
    """Fit boosted trees; ``edges`` are the ascending cut values per feature, by default from quantile sketches.

    Null and NaN features are missing, a null target is class 0, a null weight 1. Without a row, or where no cut gains
    anything, the trees are single leaves. Each level is one scan of the binned rows, which are kept, with their
    margins, in a table of the shared folder; the driver holds sums of 2**depth x features x bins at most.
    """
    if not 2 <= params.bins <= MOST_BINS:
        raise ValueError(f"2 to {MOST_BINS} bins")
    features = list(features)
    edges = [list(e) for e in (quantile_edges(df, features, params.bins) if edges is None else edges)]
    size, width = len(features), max((len(e) for e in edges), default=0) + 2
    if width > MOST_BINS + 1:
        raise ValueError(f"more than {MOST_BINS - 1} edges")
    row_weight = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    rows = df.select(
        *[F.coalesce(_value(f), F.lit(float("nan"))).alias(f"x{i}") for i, f in enumerate(features)],
        F.coalesce(F.col(target).cast("double"), F.lit(0.0)).alias("target"), row_weight.alias("weight"),
    )
    rows = stored(rows.mapInArrow(_binned(size, edges), _ROW_DDL), "binned")
    model, pending = BoostedTrees(features, params.depth), []
    for _ in range(params.trees):
        tree = _grow(rows, pending, edges, width, params)
        model.trees.append(tree)
        pending.append(tree)
        if len(pending) == params.flush:
            rows = stored(rows.mapInArrow(_with_trees(size, params.depth, pending), _ROW_DDL), "margins")
            pending = []
    return model


def _level_sums(rows: DataFrame, pending: list[Tree], tree: Tree, level: int, wanted: list[int], size: int, width: int, depth: int):
    """{node: (g, h)} of the wanted nodes, summed by Spark."""
    scanned = rows.mapInArrow(_sums(size, width, depth, pending, tree, level, wanted), _SUM_DDL)
    out = {n: (np.zeros((size, width)), np.zeros((size, width))) for n in wanted}
    for r in scanned.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        out[r.node][0][r.feature, r.bin] = r.g
        out[r.node][1][r.feature, r.bin] = r.h
    return out


def _grow(rows: DataFrame, pending: list[Tree], edges: list[list[float]], width: int, params: BoostParams) -> Tree:
    size, tree = len(edges), Tree.blank(params.depth)
    sums = _level_sums(rows, pending, tree, 0, [0], size, width, params.depth)
    for level in range(params.depth + 1):
        light, heavy = [], []
        for node in sorted(sums):
            g, h = sums[node]
            total_g, total_h = (g[0].sum() / GRAIN, h[0].sum() / GRAIN) if size else (0.0, 0.0)
            found = best_cut(g, h, edges, params.l2, params.least_hessian) if level < params.depth else None
            if found is None:
                tree.value[node] = -params.rate * total_g / (total_h + params.l2) if total_h or total_g else 0.0
                continue
            gain, f, cut, missing_left = found
            tree.feature[node], tree.cut[node], tree.threshold[node] = f, cut, edges[f][cut - 1]
            tree.missing_left[node], tree.gain[node] = missing_left, gain
            left = h[f, 1 : cut + 1].sum() + missing_left * h[f, 0]
            smaller = 2 * node + 1 if 2 * left <= h[f].sum() else 2 * node + 2
            light.append(smaller)
            heavy.append((4 * node + 3 - smaller, node, smaller))
        if not light:
            break
        below = _level_sums(rows, pending, tree, level + 1, light, size, width, params.depth)
        for other, node, smaller in heavy:
            below[other] = (sums[node][0] - below[smaller][0], sums[node][1] - below[smaller][1])
        sums = below
    return tree

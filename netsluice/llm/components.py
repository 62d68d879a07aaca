"""Connected components of edges between long ids, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsluice.llm.common import written


def _forest(edges: DataFrame) -> DataFrame:
    """A spanning forest of each partition's edges, as stars: at most one edge per node and partition."""

    def run(batches):
        import pyarrow as pa

        root: dict[int, int] = {}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(root.setdefault(u, u)), find(root.setdefault(v, v))
                if a != b:
                    root[max(a, b)] = min(a, b)
        nodes = [x for x in root if root[x] != x]
        for i in range(0, len(nodes), 100_000):
            part = nodes[i : i + 100_000]
            yield pa.RecordBatch.from_pydict({"u": part, "v": [find(x) for x in part]})

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and component (smallest id reachable) of every node that an edge (u, v) touches.

    Loops and repeated edges do no harm; edges without both ends are left out. Each round is written to
    the shared folder. Only sums leave the executors.
    """
    edges = edges.select("u", "v").dropna().filter("u <> v")
    state = written(_forest(edges).distinct(), name)
    before = None
    while True:
        both = state.select("u", "v").union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
        large = both.join(low, both["u"] == low["c"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = down.join(low, down["u"] == low["c"])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
        state = written(small.filter("u <> v").distinct(), name)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.countDistinct("u")).first()
        if now == before or now[0] == 0:
            break
        before = now
    roots = state.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

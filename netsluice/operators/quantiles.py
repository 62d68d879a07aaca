"""Exact quantiles with linear interpolation, by one way at every size and bounded in memory.

A first scan sketches each column; a sketch gives a bracket around each wanted rank. A second scan counts, in one
aggregation, the copies of every value inside a bracket and the rows of every stretch between brackets. From these
counts alone follow the ranks of all values inside, a proof that a bracket holds its rank, and the two order
statistics. A bracket that does not hold its rank is opened and the second scan repeated; one with many different
values inside is cut down among the counted values, the data is not read again for it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsluice.functions.keys import quoted
from netsluice.session import stored

#: Different values of one bracket that a task sorts; more are cut down first.
WINDOW_ROWS = 1_000_000
SKETCH = 4096
_MARGIN = 0.002  #: twice the rank error that a sketch of this size stays below in 99 of 100 cases
_DOUBLINGS = 10  #: of the margin, up to more than 1
_MARKS = 1000
_LOW, _HIGH = float("-inf"), float("inf")


def _value(name: str) -> Column:
    c = quoted(name).cast("double")
    return F.when(F.isnan(c), None).otherwise(c)


class _Ranks:
    """The wanted ranks of ``columns`` at ``probs`` (ascending) within the groups ``by``.

    Group keys are named ``_0``, ``_1``, ... on the way. A cell (i, j) is a column and a probability.
    """

    def __init__(self, columns: Sequence[str], probs: Sequence[float], by: Sequence[str]):
        self.columns, self.probs, self.by = list(columns), sorted(set(probs)), list(by)
        self.keys = [f"_{k}" for k in range(len(self.by))]
        self.cell = [*self.keys, "i", "j"]

    def grouped(self, df: DataFrame) -> DataFrame:
        """Group keys and the values as ``x0``, ``x1``, ..."""
        keys = [quoted(b).alias(k) for b, k in zip(self.by, self.keys)]
        return df.select(*keys, *[_value(c).alias(f"x{i}") for i, c in enumerate(self.columns)])

    def same_group(self, left: DataFrame, right: DataFrame, also: Sequence[str] = ()) -> DataFrame:
        """Both sides by group, null groups too, and by the columns of ``also``."""
        renamed = right.withColumnsRenamed({c: f"of{c}" for c in [*self.keys, *also]})
        on = F.lit(True)
        for c in [*self.keys, *also]:
            on = on & F.col(c).eqNullSafe(F.col(f"of{c}"))
        return left.join(renamed, on).drop(*[f"of{c}" for c in [*self.keys, *also]])

    def brackets(self, values: DataFrame) -> DataFrame:
        """Per group and column the ascending lower and upper edges ``l{i}`` and ``h{i}``, outer ones open."""
        sketches = [F.kll_sketch_agg_double(f"x{i}", F.lit(SKETCH)).alias(f"s{i}") for i in range(len(self.columns))]
        edges = []
        for i in range(len(self.columns)):
            edges += [e.alias(f"{side}{i}") for side, e in zip("lh", _edges(F.col(f"s{i}"), self.probs))]
        return values.groupBy(*self.keys).agg(*sketches).select(*self.keys, *edges)

    def counted(self, values: DataFrame, brackets: DataFrame) -> DataFrame:
        """(keys, i, a, b, x, copies): rows by the number a of lower edges up to the value and the number b of upper edges
        below it, and inside a bracket (a > b) by the value itself."""
        if self.by:
            beside = self.same_group(values, brackets)
        else:
            row = brackets.first()  # two numbers for each column and probability
            beside = values.withColumns({c: F.array(*[F.lit(e).cast("double") for e in row[c]]) for c in brackets.columns})
        cells = []
        for i in range(len(self.columns)):
            x = F.col(f"x{i}")
            a, b = F.lit(0), F.lit(0)
            for j in range(len(self.probs)):
                a = a + (F.col(f"l{i}")[j] <= x).cast("int")
                b = b + (F.col(f"h{i}")[j] < x).cast("int")
            cells.append(F.struct(F.lit(i).alias("i"), a.alias("a"), b.alias("b"), F.when(a > b, x).alias("x")))
        rows = beside.select(*self.keys, F.inline(F.array(*cells))).where(F.col("a").isNotNull())
        return rows.groupBy(*self.keys, "i", "a", "b", "x").agg(F.count(F.lit(1)).alias("copies"))

    def per_cell(self, counts: DataFrame) -> DataFrame:
        """The counts once for each probability of their column, with ``inside``: whether the value lies in its bracket."""
        every = counts.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(self.probs) - 1))))
        return every.withColumn("inside", (F.col("a") > F.col("j")) & (F.col("b") <= F.col("j")))

    def cells(self, counts: DataFrame) -> DataFrame:
        """(keys, i, j, n, below, held, kinds, first, second): rows, rows below the bracket, rows and values inside it, and
        the two wanted ranks from 0."""
        sums = self.per_cell(counts).groupBy(*self.cell).agg(
            F.sum("copies").alias("n"),
            F.coalesce(F.sum(F.when(F.col("a") <= F.col("j"), F.col("copies"))), F.lit(0)).alias("below"),
            F.coalesce(F.sum(F.when(F.col("inside"), F.col("copies"))), F.lit(0)).alias("held"),
            F.count(F.when(F.col("inside"), 1)).alias("kinds"),
        )
        first = F.floor(self.rank())
        return sums.withColumns({"first": first, "second": F.least(first + 1, F.col("n") - 1)})

    def rank(self) -> Column:
        return F.element_at(F.array(*map(F.lit, self.probs)), F.col("j") + 1) * (F.col("n") - 1)

    def opened(self, brackets: DataFrame, cells: DataFrame) -> DataFrame:
        """Brackets without their rank opened on both sides, along with the edges further out, so that edges stay ascending."""
        wrong = cells.where(~_proven()).groupBy(*self.keys, "i").agg(F.max("j").alias("last"), F.min("j").alias("first"))
        if not self.by:
            opened = brackets.first().asDict()  # one row
            for r in wrong.collect():  # a row per column at most
                lows, highs = opened[f"l{r.i}"], opened[f"h{r.i}"]
                opened[f"l{r.i}"] = [_LOW if j <= r.last else e for j, e in enumerate(lows)]
                opened[f"h{r.i}"] = [_HIGH if j >= r.first else e for j, e in enumerate(highs)]
            return brackets.sparkSession.createDataFrame([tuple(opened.values())], brackets.schema)
        spans = wrong.groupBy(*self.keys).agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("last", "first")))).alias("w"))
        renamed = spans.withColumnsRenamed({k: f"of{k}" for k in self.keys})
        on = F.lit(True)
        for k in self.keys:
            on = on & F.col(k).eqNullSafe(F.col(f"of{k}"))
        beside = brackets.join(renamed, on, "left").drop(*[f"of{k}" for k in self.keys])
        out = []
        for i in range(len(self.columns)):
            span = F.try_element_at("w", F.lit(i))
            out.append(_open_to(F.col(f"l{i}"), lambda j, last=span["last"]: j <= last, _LOW).alias(f"l{i}"))
            out.append(_open_to(F.col(f"h{i}"), lambda j, first=span["first"]: j >= first, _HIGH).alias(f"h{i}"))
        return beside.select(*self.keys, *out)

    def cut(self, inside: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What lies near the wanted ranks among (cell, x, copies), and the cells with the rows below that.

        Marks part a cell's values in a thousand about equal portions; the portions of both ranks are kept.
        """
        marks = F.array(*[F.lit(k / _MARKS) for k in range(_MARKS + 1)])
        grid = inside.groupBy(*self.cell).agg(F.percentile_approx("x", marks, F.lit(10 * _MARKS)).alias("g"))
        dealt = self.same_group(inside, grid, ["i", "j"]).withColumn("k", F.size(F.filter("g", lambda m: m < F.col("x")))).drop("g")
        dealt = stored(dealt, "dealt")
        sums = dealt.groupBy(*self.cell, "k").agg(F.sum("copies").alias("c"))
        upto = Window.partitionBy(*self.cell).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        ranked = self.same_group(sums, cells, ["i", "j"]).withColumn("upto", F.col("below") + F.sum("c").over(upto))
        near = ranked.where((F.col("upto") > F.col("first")) & (F.col("upto") - F.col("c") <= F.col("second")))
        kept = stored(near.groupBy(*self.cell).agg(F.min(F.col("upto") - F.col("c")).alias("below"), F.min("k").alias("from"), F.max("k").alias("to")), "kept")
        part = self.same_group(dealt, kept.drop("below"), ["i", "j"]).where(F.col("k").between(F.col("from"), F.col("to"))).drop("k", "from", "to")
        return part, self.same_group(cells.drop("below"), kept.drop("from", "to"), ["i", "j"])

    def read_off(self, inside: DataFrame, cells: DataFrame) -> DataFrame:
        """(by..., column, prob, value) from the copies of each value around the ranks."""
        upto = Window.partitionBy(*self.cell).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        ranked = self.same_group(inside, cells, ["i", "j"]).withColumn("upto", F.col("below") + F.sum("copies").over(upto))
        found = ranked.groupBy(*self.cell, "n", "first").agg(
            F.min(F.when(F.col("upto") > F.col("first"), F.col("x"))).alias("a"),
            F.min(F.when(F.col("upto") > F.col("second"), F.col("x"))).alias("b"),
        )
        weight = self.rank() - F.col("first")
        a, b = F.col("a"), F.col("b")
        # an infinite neighbour of no weight must not be multiplied
        value = F.when((a == b) | (weight == 0), a).otherwise(a * (1 - weight) + b * weight)
        return found.select(
            *[F.col(k).alias(name) for k, name in zip(self.keys, self.by)],
            F.element_at(F.array(*map(F.lit, self.columns)), F.col("i") + 1).alias("column"),
            F.element_at(F.array(*map(F.lit, self.probs)), F.col("j") + 1).alias("prob"),
            value.alias("value"),
        )


def _edges(sketch: Column, probs: Sequence[float]) -> tuple[Column, Column]:
    """Ascending sketched values below and above each probability; null without a value.

    They are so far away that the rank error and, in a small group, two ranks more lie between: the distance is doubled
    until it is enough. A distance beyond 0 or 1 opens the bracket.
    """
    ranks = [[p + side * _MARGIN * 2**k for k in range(_DOUBLINGS)] for side in (-1, 1) for p in probs]
    asked = F.array(*[F.lit(min(max(r, 0.0), 1.0)) for row in ranks for r in row])
    n = F.kll_sketch_get_n_double(sketch)
    values = F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, asked))
    wanted = F.greatest(F.lit(0), F.ceil(F.log2((F.lit(_MARGIN / 2) + 2 / F.nullif(n, F.lit(0))) / _MARGIN))).cast("int")

    def side(rows: range, open_: float) -> Column:
        out = []
        for row in rows:
            shut = sum(0 < r < 1 for r in ranks[row])  # the first ones are inside
            place = F.lit(row * _DOUBLINGS) + wanted
            out.append(F.when(n > 0, F.when(wanted < shut, F.get(values, place)).otherwise(F.lit(open_))))
        return F.array(*out)

    return side(range(len(probs)), _LOW), side(range(len(probs), 2 * len(probs)), _HIGH)


def _open_to(edges: Column, which: Callable[[Column], Column], open_: float) -> Column:
    return F.transform(edges, lambda e, j: F.when(which(j), F.lit(open_)).otherwise(e))


def _proven() -> Column:
    """The bracket of a cell holds both order statistics around the rank."""
    return (F.col("below") <= F.col("first")) & (F.col("second") < F.col("below") + F.col("held"))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), window_rows: int | None = None
) -> DataFrame:
    """Rows (by..., column, prob, value); null and NaN are left out, infinities count as values.

    A column without a value has no row. The data is read twice, and once more for each round in which some
    bracket missed its rank. Where a bracket holds over ``window_rows`` different values, they are cut down first.
    """
    window_rows = WINDOW_ROWS if window_rows is None else window_rows
    ranks = _Ranks(columns, probs, by)
    values = ranks.grouped(df)
    brackets = ranks.brackets(values)
    brackets = stored(brackets, "brackets") if by else brackets.sparkSession.createDataFrame(brackets.collect(), brackets.schema)  # one row
    while True:
        counts = stored(ranks.counted(values, brackets), "counts")
        cells = ranks.cells(counts)
        state = cells.agg(F.count(F.when(~_proven(), 1)).alias("wrong"), F.coalesce(F.max("kinds"), F.lit(0)).alias("kinds")).first()
        if not state["wrong"]:
            break
        opened = ranks.opened(brackets, cells)
        brackets = stored(opened, "brackets") if by else opened
    inside, kinds = ranks.per_cell(counts).where("inside").select(*ranks.cell, "x", "copies"), state["kinds"]
    while kinds > window_rows:
        inside, cells = ranks.cut(inside, cells)
        most = inside.groupBy(*ranks.cell).agg(F.count(F.lit(1)).alias("kinds")).agg(F.max("kinds")).first()[0]
        if most >= kinds:  # fewer values than marks
            break
        kinds = most
    return ranks.read_off(inside, cells)


def quantile_caps(df: DataFrame, column: str, by: str, prob: float = 0.99) -> DataFrame:
    """Per group the quantile of a column, as (by, cap)."""
    return exact_quantiles(df, [column], [prob], [by]).select(by, F.col("value").alias("cap"))

"""The newest signals of every source, kept as state of its key.

Each task first keeps the newest rows of a source among its own, so a source that sends a third of all rows brings a
few rows per task to its key. The state of a key is at most ``length`` rows and a timeout; a source that is silent
for ``idle`` is forgotten. A restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netsluice.streaming.rates import HISTORY_LENGTH


def _newest_of_task(source: str, order: Sequence[str], length: int):
    """The newest rows of each source among the rows of a task, in bounded memory per source."""

    def top(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(source, "ascending"), *[(c, "descending") for c in order]]))
        codes = table.column(source).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        place = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
        return table.filter(pa.array(place < length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            kept = top(part if kept is None else pa.concat_tables([kept, part]))
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    return run


def _held(data: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_pandas()


def _data(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _kept(names: Sequence[str], order: Sequence[str], length: int):
    """The state of a source: its newest rows, until the watermark passes the newest of them."""

    def newest(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.drop_duplicates(list(order)).sort_values(list(order), ascending=False).head(length)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _held(state.get[0]) if state.exists else None
        for part in parts:
            if part.empty:
                continue
            rows = newest(part[list(names)] if rows is None else pd.concat([rows, part[list(names)]], ignore_index=True))
        state.update((_data(rows),))
        newest_ms = int(pd.Timestamp(rows[order[0]].iloc[0]).timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest_ms, state.getCurrentWatermarkMs()) + 1)
        yield rows.assign(source=key[0], place=range(1, len(rows) + 1))[["source", "place", *names]]

    return run


def source_histories(
    stream: DataFrame, source: str, ts: str, tie: Sequence[str], columns: Sequence[str], length: int = HISTORY_LENGTH, idle: str = "1 day"
) -> DataFrame:
    """(source, place, ts, tie..., columns...): for each source that a batch touches, its newest rows, newest first.

    Rows are ordered by ``ts``, then ``tie``; of rows equal in both one is kept, rows without source or time are left
    out. ``idle`` is event time: a row that comes later than that is left out, and a source whose newest row is that
    old is forgotten. (Timeouts in processing time would keep a run over what is there from ending.)
    """
    order = [ts, *tie]
    named = [*order, *[c for c in columns if c not in order]]
    rest = [c for c in named if c != ts]
    rows = stream.select(F.col(source).cast("string").alias("source"), F.col(ts).cast("timestamp").alias(ts), *rest)
    rows = rows.where(F.col("source").isNotNull() & F.col(ts).isNotNull())
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = T.StructType([rows.schema.fields[0], T.StructField("place", T.IntegerType()), *rows.schema.fields[1:]])
    return (
        rows.mapInArrow(_newest_of_task("source", order, length), ddl)
        .withWatermark(ts, idle)
        .groupBy("source")
        .applyInPandasWithState(
            _kept(named, order, length), out, "rows binary", "update", GroupStateTimeout.EventTimeTimeout
        )
    )


def write_histories(path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer: a folder per batch, overwritten on a repeat."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def current_histories(spark: SparkSession, path: str) -> DataFrame:
    """Each source's rows as of the last batch that touched it."""
    rows = spark.read.parquet(path)
    newest = F.max("batch_id").over(Window.partitionBy("source"))
    return rows.withColumn("_newest", newest).where(F.col("batch_id") == F.col("_newest")).drop("_newest", "batch_id")

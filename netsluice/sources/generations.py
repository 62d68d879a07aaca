"""Tables that several writers extend at once: folders of data, and commits that name them.

A commit is a small file with the next free number. It is written beside its place and then put there in one step
that fails if the place is taken, so of two writers with the same number one tries the next. Readers see the folders
that commits name, up to one generation: never half of an append, and nothing of a writer that died before its commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_COMMITS = "commits"


class Conflict(Exception):
    """Another writer committed the generation first."""


@dataclass(frozen=True)
class Commit:
    """Generation ``number``: what it adds (``folder``, none for a pure note), whether all before it is dropped, and notes."""

    number: int
    folder: str | None
    clears: bool
    note: dict


def _taken(error: Py4JJavaError) -> bool:
    return "FileAlreadyExists" in error.java_exception.getClass().getName()


def _put(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text unless one is there; never visible in part."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    stream = files.create(beside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if files.getScheme() == "file":  # a rename over a file would succeed here, a link does not
            local = [jvm.java.nio.file.Path.of(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (target, beside)]
            jvm.java.nio.file.Files.createLink(*local)
            return True
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
        context.rename(beside, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Py4JJavaError as e:
        if not _taken(e):
            raise
        return False
    finally:
        files.delete(beside, False)


def commits(spark: SparkSession, root: str, upto: int | None = None) -> list[Commit]:
    """The commits in order, from the last one that dropped all before it; one per append, as the driver lists files."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/{_COMMITS}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(folder))
    numbered = [int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")]
    out: list[Commit] = []
    for number in sorted(numbered, reverse=True):
        if upto is not None and number > upto:
            continue
        stream = files.open(jvm.org.apache.hadoop.fs.Path(folder, _name(number)))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        found = json.loads(text)
        out.append(Commit(number, found["folder"], found["clears"], found["note"]))
        if found["clears"]:
            break
    return out[::-1]


def _name(number: int) -> str:
    return f"{number:010d}.json"


def generation(spark: SparkSession, root: str) -> int:
    """The number of the last commit, 0 before the first."""
    found = commits(spark, root)
    return found[-1].number if found else 0


def commit(
    spark: SparkSession, root: str, folder: str | None = None, clears: bool = False, note: dict | None = None, after: int | None = None
) -> int:
    """Commit the next generation and return its number.

    With ``after`` it must be the one that follows: if another writer was first, Conflict is raised and nothing is
    committed. Without it the next free number is taken.
    """
    text = json.dumps({"folder": folder, "clears": clears, "note": note or {}})
    number = (generation(spark, root) if after is None else after) + 1
    while not _put(spark, f"{root}/{_COMMITS}/{_name(number)}", text):
        if after is not None:
            raise Conflict(f"generation {number} of {root}")
        number += 1
    return number


def append(df: DataFrame, root: str, note: dict | None = None, after: int | None = None) -> int:
    """Add rows as one generation; they become visible by the commit alone."""
    folder = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    return commit(df.sparkSession, root, folder, note=note, after=after)


def replace(df: DataFrame, root: str, note: dict | None = None, after: int | None = None) -> int:
    """The rows instead of all earlier ones, as one generation."""
    folder = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    return commit(df.sparkSession, root, folder, True, note, after)


def read(
    spark: SparkSession, root: str, fields: str | T.StructType, upto: int | None = None, which: Callable[[Commit], bool] | None = None
) -> DataFrame:
    """The rows of one generation, by default the last; of chosen commits, where ``which`` is given."""
    chosen: Sequence[Commit] = [c for c in commits(spark, root, upto) if c.folder and (which is None or which(c))]
    reader = spark.read.schema(fields)
    if not chosen:
        return spark.createDataFrame([], fields)
    return reader.parquet(*[f"{root}/{c.folder}" for c in chosen])

"""Trees of files as tables: listing on the executors, contents only of files that a reader asks for.

Spark's own file source leaves out names that begin with '.' or '_', and reads what no rule selects. Here a frontier of folders is listed
by tasks, level by level, folders of ignored names pruned before descent; executors need to see the tree's path.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.select import DEFAULT_IGNORED
from ..schema import LISTING
from ..storage import kept
from .contents import opened

#: Rows of a listing per batch, folders that a task lists before it hands the rest on.
BATCH_ROWS, TASK_FOLDERS = 10_000, 2000


def entries(root: str, folders: Iterator[str], ignored: frozenset[str], most: int) -> Iterator[tuple[str, bool]]:
    """(path, whether it is a folder still to be listed) below some folders of root, `most` folders being listed here. Links are files, whatever they lead to."""
    todo, listed = deque(folders), 0
    while todo:
        folder = todo.popleft()
        if listed >= most:
            yield folder, True
            continue
        listed += 1
        with os.scandir(os.path.join(root, folder)) as found:
            for entry in found:
                path = f"{folder}/{entry.name}" if folder else entry.name
                if not entry.is_dir(follow_symlinks=False):
                    yield path, False
                elif entry.name not in ignored:
                    todo.append(path)


def list_tree(spark: SparkSession, root: str | list[str], ignored: tuple[str, ...] = DEFAULT_IGNORED, task_folders: int = TASK_FOLDERS) -> DataFrame:
    """LISTING of one or more trees: all their files, hidden ones included, without contents. A folder that cannot be listed ends the job."""
    roots = [os.path.abspath(r) for r in ([root] if isinstance(root, str) else root)]
    for r in roots:
        if not os.path.isdir(r):
            raise ValueError(f"not a directory: {r}")
    skip = frozenset(ignored)

    def run(batches):
        for batch in batches:
            by_root: dict[str, list[str]] = {}
            for r, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_root.setdefault(r, []).append(folder)
            for r, folders in by_root.items():
                rows: list[tuple[str, bool]] = []
                for row in entries(r, iter(folders), skip, task_folders):
                    rows.append(row)
                    if len(rows) == BATCH_ROWS:
                        yield listed(r, rows)
                        rows = []
                yield listed(r, rows)

    def listed(r: str, rows: list[tuple[str, bool]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r] * len(rows), pa.string()), pa.array([p for p, _ in rows], pa.string()), pa.array([f for _, f in rows], pa.bool_())], ["root", "path", "folder"])

    frontier, levels = spark.createDataFrame([(r, "") for r in dict.fromkeys(roots)], "root string, path string"), []
    tasks = 4 * spark.sparkContext.defaultParallelism
    while True:
        level = kept(frontier.repartition(tasks, "root", "path").mapInArrow(run, "root string, path string, folder boolean"))
        # the path as it is on disk opens a file; a backslash in it counts as a slash elsewhere
        levels.append(level.where("not folder").select("root", "path", F.substring_index("path", "/", -1).alias("name")))
        frontier = level.where("folder").select("root", "path")
        if frontier.isEmpty():
            return reduce(lambda a, b: a.union(b), levels)


def read_tree(spark: SparkSession, root: str | list[str], ignored: tuple[str, ...] = DEFAULT_IGNORED) -> DataFrame:
    """FILES of one or more trees, every file read. detect() takes a listing as well, and then reads only what its rules ask for."""
    return opened(list_tree(spark, root, ignored), F.lit(None)).drop("unread")


def files_from_table(table: DataFrame, path: Column, content: Column, root: Column | None = None) -> DataFrame:
    """FILES from any table with a path and a text or binary column."""
    p = F.regexp_replace(path, r"\\", "/")
    return table.select((F.lit("") if root is None else root).alias("root"), p.alias("path"), F.substring_index(p, "/", -1).alias("name"), content.cast("binary").alias("content"))


def files_from_objects(spark: SparkSession, path: str) -> DataFrame:
    """FILES of a store that Spark reads (object stores, HDFS); names that begin with '.' or '_' are not listed there. path is relative to the folder given."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = path.rstrip("/")
    tail = F.regexp_replace("path", r"^[a-zA-Z0-9+.-]+:/*(?=/)", "")
    cut = F.substring_index(F.lit(base), ":", -1)
    rel = F.regexp_replace(F.expr("substring(tail, greatest(1, instr(tail, base) + length(base)))"), "^/+", "")
    return raw.withColumn("tail", tail).withColumn("base", F.regexp_replace(cut, "^/{2,}", "/")).select(F.lit(base).alias("root"), rel.alias("path"), F.substring_index(rel, "/", -1).alias("name"), "content")

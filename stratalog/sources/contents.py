"""Contents of listed files, read by the tasks that need them."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import BinaryType, StringType, StructType

#: Bytes of content per Arrow batch.
BATCH_BYTES = 16_000_000


def opened(rows: DataFrame, most: Column) -> DataFrame:
    """rows (root, path and more) with content and unread: the first `most` bytes of each file (null: all, 0: the file is not
    opened and content is null), or why it could not be read."""
    asked = rows.withColumn("most", most.cast("long"))
    schema = StructType([f for f in rows.schema.fields]).add("content", BinaryType()).add("unread", StringType())
    names = rows.columns
    at_root, at_path = names.index("root"), names.index("path")

    def run(batches):
        for batch in batches:
            roots, paths, limits = (batch.column(i).to_pylist() for i in (at_root, at_path, len(names)))
            start, held, contents, unread = 0, 0, [], []
            for n, (root, path, limit) in enumerate(zip(roots, paths, limits, strict=True)):
                content = why = None
                if limit != 0:
                    try:
                        with open(os.path.join(root, path), "rb") as f:
                            content = f.read() if limit is None else f.read(limit)
                    except OSError as e:
                        why = f"read candidate file {path!r}: {e.strerror}"
                contents.append(content)
                unread.append(why)
                held += len(content or b"")
                if held >= BATCH_BYTES or n == batch.num_rows - 1:
                    part = batch.slice(start, n + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(contents, pa.binary()), pa.array(unread, pa.string())], [*names, "content", "unread"])
                    start, held, contents, unread = n + 1, 0, [], []

    return asked.mapInArrow(run, schema)

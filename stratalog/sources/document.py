"""One JSON document written by many tasks.

Every task writes its manifests, already rendered, to a part of its own beside the document; the commit joins the parts in path order by copying
bytes, and puts the document in its place in one step. Executors and driver need to see the folder. A job that fails leaves nothing.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..plans.report import entry
from ..schema import MANIFESTS


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    rows: int


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.root = options["path"], options.get("root", "")
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"
        os.makedirs(self.parts)

    def write(self, iterator) -> Part:
        task = TaskContext.get()
        path, rows = f"{self.parts}/{task.partitionId()}-{task.taskAttemptId()}", 0
        with open(path, "w", encoding="utf-8", newline="") as f:
            for row in iterator:
                # strings hold no line ends once they are written as JSON, so lines can be indented
                f.write((",\n    " if rows else "    ") + json.dumps(entry(row), indent=2, ensure_ascii=False).replace("\n", "\n    "))
                rows += 1
        return Part(task.partitionId(), path, rows)

    def commit(self, messages: list) -> None:
        some = sorted((m for m in messages if m and m.rows), key=lambda m: m.number)
        whole = f"{self.parts}/whole"
        with open(whole, "wb") as f:
            f.write(f'{{\n  "root": {json.dumps(self.root, ensure_ascii=False)},\n  "manifests": {"[" if some else "null"}'.encode())
            for i, m in enumerate(some):
                f.write(b",\n" if i else b"\n")
                with open(m.path, "rb") as part:
                    shutil.copyfileobj(part, f)
            f.write(b"\n  ]\n}\n" if some else b"\n}\n")
        os.replace(whole, self.path)
        shutil.rmtree(self.parts)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class DocumentSink(DataSource):
    """manifests.write.format('manifest_document') with options path (of the document) and root (as the document names it)."""

    @classmethod
    def name(cls) -> str:
        return "manifest_document"

    def schema(self) -> str:
        return MANIFESTS

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options)


def write_document(manifests: DataFrame, path: str, root: str) -> None:
    """manifests as the JSON document of json_report at a path, which is replaced: tasks render ranges of paths, nothing is gathered."""
    manifests.sparkSession.dataSource.register(DocumentSink)
    ranges = manifests.repartitionByRange("path", "type").sortWithinPartitions("path", "type")
    ranges.write.format("manifest_document").option("path", path).option("root", root).mode("append").save()

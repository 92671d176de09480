"""Reports as a Spark data source: tasks write parts, the commit publishes them by one manifest that replaces the last one."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType, _parse_datatype_json_string

MANIFEST = "manifest.json"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that all executors share, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _put(path: str, data: bytes) -> None:
    store, at = _store(path)
    with store.open_output_stream(at) as out:
        out.write(data)


def manifest_of(path: str) -> dict | None:
    """The published manifest of a report: run, kind, schema, types and files with rows and digests; None before the first."""
    store, at = _store(f"{path}/{MANIFEST}")
    if store.get_file_info(at).type != fs.FileType.File:
        return None
    with store.open_input_stream(at) as source:
        return json.loads(source.read())


@dataclass
class Part(WriterCommitMessage):
    """A file that a task has written."""

    number: int
    file: str
    rows: int
    sha256: str


def _cell(value) -> str:
    return "" if value is None else str(value).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


class ReportWriter(DataSourceWriter):
    """A run of a report. Its files lie in a folder of their own until the commit names them in the manifest."""

    def __init__(self, path: str, kind: str, schema: StructType, overwrite: bool):
        if kind not in ("json", "markdown"):
            raise ValueError(f"a report is json or markdown, not {kind}")
        self.path, self.kind, self.overwrite, self.run = path.rstrip("/"), kind, overwrite, uuid.uuid4().hex
        self.names, self.schema, self.types = schema.names, schema.json(), schema.simpleString()
        store, at = _store(f"{self.path}/{self.run}")
        store.create_dir(at, recursive=True)

    def _line(self, row: Row) -> str:
        if self.kind == "json":
            return json.dumps(row.asDict(True), default=str, ensure_ascii=False)
        return f"| {' | '.join(_cell(row[n]) for n in self.names)} |"

    def write(self, iterator: Iterator[Row]) -> Part:
        number = TaskContext.get().partitionId()
        name = f"{self.run}/part-{number:05d}-{uuid.uuid4().hex}"
        digest, n = hashlib.sha256(), 0
        store, at = _store(f"{self.path}/{name}")
        with store.open_output_stream(at) as out:
            for row in iterator:
                line = (self._line(row) + "\n").encode()
                digest.update(line)
                out.write(line)
                n += 1
        return Part(number, name, n, digest.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        before = manifest_of(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        files = [{"file": m.file, "rows": m.rows, "sha256": m.sha256} for m in parts]
        if before and not self.overwrite:
            if (before["kind"], before["types"]) != (self.kind, self.types):
                raise ValueError("a report is continued by rows of its own kind and schema")
            files = before["files"] + files
        new = {"run": self.run, "kind": self.kind, "schema": self.schema, "types": self.types, "files": files}
        _put(f"{self.path}/{self.run}/{MANIFEST}", json.dumps(new, indent=1).encode())
        store, at = _store(f"{self.path}/{self.run}/{MANIFEST}")
        # a rename replaces the manifest at once: readers see all of the last run or all of this one
        store.move(at, _store(f"{self.path}/{MANIFEST}")[1])

    def abort(self, messages: list[Part | None]) -> None:
        store, at = _store(f"{self.path}/{self.run}")
        store.delete_dir(at)


class ReportSource(DataSource):
    """df.write.format("report").option("kind", "json" or "markdown").mode("overwrite" or "append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"], self.options.get("kind", "json"), schema, overwrite)


def publish_report(df: DataFrame, path: str, kind: str = "json", append: bool = False) -> None:
    """Write a report whole or not at all. A task or commit that fails leaves the report before as it was, and no files of
    the failed run; files of runs that are no longer named stay until clear_report, for readers that have begun."""
    df.sparkSession.dataSource.register(ReportSource)
    df.write.format("report").option("kind", kind).mode("append" if append else "overwrite").save(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the published JSON report; its lines in order, as a table's rows with head, of a Markdown one (line)."""
    m = manifest_of(path)
    if m is None:
        raise FileNotFoundError(f"no report is published in {path}")
    schema = _parse_datatype_json_string(m["schema"])
    files = [f"{path}/{f['file']}" for f in m["files"] if f["rows"]]
    if m["kind"] == "json":
        return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
    head = [f"| {' | '.join(schema.names)} |", f"|{'---|' * len(schema.names)}"]
    lines = spark.createDataFrame([(x,) for x in head], "line string")
    return lines.union(spark.read.text(files).withColumnRenamed("value", "line")) if files else lines


def clear_report(path: str) -> int:
    """Delete the folders of runs that the manifest does not name; their number."""
    m = manifest_of(path)
    named = {f["file"].split("/")[0] for f in m["files"]} if m else set()
    store, at = _store(path)
    old = [x for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.Directory and x.base_name not in named]
    for x in old:
        store.delete_dir(x.path)
    return len(old)

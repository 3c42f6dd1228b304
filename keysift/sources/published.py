"""Documents that appear at once: a sink whose commit publishes all parts, and whose abort leaves none.

Tasks write their lines below a folder of the job, in one folder per attempt whose name Spark's readers skip. The commit
gives the folders of the attempts that count their names and then puts the manifest in place, in one rename;
readers go by the manifest, so until then the documents before are the ones there. The folder must be one that the driver and
all workers mount.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from keysift.plans.documents import ORDER
from keysift.plans.report import flatten_lines

FORMAT = "keysift_documents"
MANIFEST = "manifest.json"
#: The folder of reports without a repository, as Spark names it.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"
#: Rows and characters of a batch that is read.
ROWS, CHARS = 10_000, 1 << 23


def _local(path: str) -> str:
    found = urlparse(path)
    if found.scheme not in ("", "file"):
        raise ValueError(f"documents are published in a folder that every worker mounts, not in {path}")
    return found.path.rstrip("/")


def folder_name(repository: str | None) -> str:
    """``repository=…`` as Spark reads it back."""
    if repository is None:
        return f"repository={NO_NAME}"
    return "repository=" + re.sub(r"[^A-Za-z0-9_.\- \u0080-\U0010ffff]", lambda m: f"%{ord(m[0]):02X}", repository)


@dataclass
class Written(WriterCommitMessage):
    """One task's attempt: its number, its folder, and how much is there."""

    task: int
    attempt: str
    lines: int


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.job = _local(path), f"job-{uuid.uuid4().hex}"
        if not overwrite and os.path.exists(f"{self.path}/{MANIFEST}"):
            raise FileExistsError(f"documents are there already: {path}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task, attempt, lines, out, now = TaskContext.get().partitionId(), f"_attempt-{uuid.uuid4().hex}", 0, None, None
        try:
            for batch in iterator:
                for repository, line in zip(batch.column("repository").to_pylist(), batch.column("line").to_pylist()):
                    if out is None or repository != now:
                        if out:
                            out.close()
                        folder = f"{self.path}/{self.job}/{attempt}/{folder_name(repository)}"
                        os.makedirs(folder, exist_ok=True)
                        out, now = open(f"{folder}/part-{task:06d}.txt", "a", encoding="utf-8", newline=""), repository
                    out.write(line + "\n")
                    lines += 1
        finally:
            if out:
                out.close()
        return Written(task, attempt, lines)

    def commit(self, messages: list[Written | None]) -> None:
        job = f"{self.path}/{self.job}"
        os.makedirs(job, exist_ok=True)
        for m in messages:
            if m is not None and m.lines:
                os.rename(f"{job}/{m.attempt}", f"{job}/task={m.task:06d}")
        told = {"folder": self.job, "lines": sum(m.lines for m in messages if m is not None)}
        new = f"{self.path}/.{self.job}.tmp"
        with open(new, "w", encoding="utf-8") as f:
            json.dump(told, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(new, f"{self.path}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(f"{self.path}/{self.job}", ignore_errors=True)


class Documents(DataSource):
    """``df.write.format("keysift_documents").option("path", …)`` for rows ``repository, line`` in order."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "repository string, line string"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        if [f.name for f in schema.fields] != ["repository", "line"]:
            raise ValueError(f"documents have the columns repository and line, not {schema.fieldNames()}")
        return DocumentWriter(self.options["path"], overwrite)


def publish_documents(document: DataFrame, path: str, overwrite: bool = False) -> str:
    """Publishes the documents of ``report_document`` or ``sarif_document`` at ``path``: all of them at once, or, if a
    task fails for good, none. With ``overwrite`` they take the place of those before, which stay on disk until
    ``remove_unpublished``. Returns the path."""
    spark = document.sparkSession
    spark.dataSource.register(Documents)
    (document.orderBy(*ORDER).select("repository", "line").write.format(FORMAT).option("path", path)
     .mode("overwrite" if overwrite else "append").save())
    return path


def published_folder(spark: SparkSession, path: str) -> str:
    """The folder whose parts are published at ``path``; raises if nothing is."""
    told = spark.read.option("wholetext", True).text(f"{path}/{MANIFEST}").first()
    return f"{path}/{json.loads(told.value)['folder']}"


def _listed(folder: str):
    """Lists the repositories' folders below those of the writer's tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column("task").to_pylist():
                names = sorted(os.listdir(f"{folder}/{task}"))
                for at in range(0, len(names), ROWS):
                    part = names[at:at + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([task] * len(part)), pa.array(part)], ["task", "name"])

    return work


def _lines(folder: str):
    """The lines of the part files in repositories' folders."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_folder", pa.string()), ("_file", pa.string()), ("_at", pa.int32()), ("_line", pa.string())])
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for task, name in zip(batch.column("task").to_pylist(), batch.column("name").to_pylist()):
                value = name.removeprefix("repository=")
                repository = None if value == NO_NAME else unquote(value)
                for file in sorted(f for f in os.listdir(f"{folder}/{task}/{name}") if f.endswith(".txt")):
                    with open(f"{folder}/{task}/{name}/{file}", encoding="utf-8", newline="\n") as f:
                        for at, line in enumerate(f):
                            rows.append((repository, file, at, line.removesuffix("\n")))
                            size += len(line)
                            if len(rows) >= ROWS or size >= CHARS:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return work


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The findings of published reports, as ``read_documents`` gives them.

    Tasks list the folders and open the files, which are small if there are many repositories: Spark's own reader
    would list them all on the driver and plan a task for a few of them each.
    """
    published = published_folder(spark, path)
    folder = _local(published)
    tasks = spark.createDataFrame([(t,) for t in sorted(os.listdir(folder)) if t.startswith("task=")], "task string")
    count = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = tasks.repartition(count, "task").mapInArrow(_listed(folder), "task string, name string")
    return flatten_lines(names.repartition(count, "task", "name").mapInArrow(
        _lines(folder), "_folder string, _file string, _at int, _line string"), published)


def remove_unpublished(spark: SparkSession, path: str) -> None:
    """Removes what earlier jobs left, when no reader or writer is at work."""
    keep = published_folder(spark, path).rsplit("/", 1)[1]
    folder = _local(path)
    for name in os.listdir(folder):
        if name.startswith("job-") and name != keep:
            shutil.rmtree(f"{folder}/{name}")

"""A table of model answers that lasts: bucketed by key, appended to, compacted.

Its files are dealt to buckets by the key's hash, so joins and counts by key read a bucket where it is
and shuffle the other side only. Appending may repeat a key; compaction writes a new version with
one row for each. The versions are folders; the newest that was written to the end counts.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift import schemas

BUCKETS = 64


class AnswerCache:
    """The answers under ``path``, a folder that all executors reach.

    ``buckets`` is fixed when the first answers are written and must stay. One writer at a time; readers go on with the
    version they began with.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _versions(self) -> list[int]:
        """The versions that were written to the end."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [re.fullmatch(r"v(\d+)-(\d+)", s.getPath().getName()) for s in files.listStatus(folder)]
        found = {int(m[1]): int(m[2]) for m in names if m}
        done = {v: b for v, b in found.items()
                if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}-{b}/_SUCCESS"))}
        if any(b != self.buckets for b in done.values()):
            raise ValueError(f"the cache has {set(done.values())} buckets, not {self.buckets}")
        return sorted(done)

    def _declared(self, version: int) -> str:
        """The version as a table of this session: its files say in which bucket they are."""
        folder = f"{self.path}/v{version}-{self.buckets}"
        name = "keysift_cache_" + hashlib.md5(folder.encode()).hexdigest()
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.RESPONSES.fields)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
                       f"CLUSTERED BY (cache_key) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
        self.spark.catalog.refreshTable(name)
        return name

    def _write(self, rows: DataFrame, version: int) -> None:
        # as many tasks as buckets, by the same hash: each writes one file
        rows.select(*schemas.RESPONSES.names).repartition(self.buckets, "cache_key").write.insertInto(self._declared(version))

    def table(self) -> DataFrame:
        """``cache_key, response``; a key may occur more than once."""
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], schemas.RESPONSES)
        return self.spark.table(self._declared(versions[-1]))

    def extend(self, answers: DataFrame) -> None:
        """Appends the answers that did not fail; null keys or answers are left out."""
        versions = self._versions()
        kept = answers.where(F.col("error").isNull()) if "error" in answers.columns else answers
        self._write(kept.where("cache_key is not null and response is not null"), versions[-1] if versions else 0)

    def compact(self) -> None:
        """A new version with one row per key, the least of its answers, in one file per bucket. Nothing is shuffled."""
        versions = self._versions()
        if versions:
            once = self.spark.table(self._declared(versions[-1])).groupBy("cache_key").agg(F.min("response").alias("response"))
            once.write.insertInto(self._declared(versions[-1] + 1))

    def drop_old(self) -> None:
        """Removes all versions but the newest, when nothing reads them any more."""
        for v in self._versions()[:-1]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._declared(v)}")
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}-{self.buckets}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

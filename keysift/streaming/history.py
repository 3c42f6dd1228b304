"""The scan over streams of commits and patches.

Commits and patches arrive in any order and in any batch. What is kept is, of each repository and part of
its commits, the newest N commits of the part, and the patches whose commit has not been seen.
A repository's newest N are among those of its parts, so a hot repository is spread over PARTS
parts, and which commits count in the end is decided when the table is read, from the few that were
ever among a part's newest. The parts of all repositories share KEYS state keys: a key's state is packed, so the
calls to the state store do not grow with the commits or repositories.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, ValueState

from keysift import schemas
from keysift.operators.dedup import dedup_findings
from keysift.operators.diff import date_string, message_units, patch_units, with_origin
from keysift.operators.history import last_n
from keysift.operators.match import regex_findings
from keysift.operators.rules import RuleSet
from keysift.plans.scan import DEFAULT_COMMITS, redact_findings

PARTS = 64
#: State keys, each with the parts of many repositories.
KEYS = 1024
STORE = ("spark.sql.streaming.stateStore.providerClass",
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_EVENTS = ("kind string, repository string, commit_hash string, author string, commit_date string, message string, "
           "origin string, file_path string, patch string")
_COLUMNS = [c.strip().split(" ")[0] for c in _EVENTS.split(",")]
_KNOWN = pa.schema([("repository", pa.string()), ("commit_hash", pa.string()), ("part", pa.int32()), ("commit_date", pa.string()),
                    ("through", pa.bool_()), ("changed", pa.int64())])
_WAITING = pa.schema([("repository", pa.string()), ("commit_hash", pa.string()), ("file_path", pa.string()), ("copy", pa.string()),
                      ("patch", pa.large_string()), ("changed", pa.int64())])


class NewestCommits(StatefulProcessor):
    """Lets through the commits that are among the newest ``n`` of their repository and part when they arrive, and the
    patches of commits that still are; other patches of known commits are dropped, those of unknown ones wait.

    A key has many repositories and parts, and its state is two packed tables: the commits that are known, with their
    dates and whether they are let through, and the waiting patches. So a batch reads and writes each key's state
    once, not once for each commit. ``ttl_ms`` forgets what has not changed for so long; None keeps it.
    """

    def __init__(self, n: int, ttl_ms: int | None = None):
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "data binary", self.ttl_ms)
        self.waiting = handle.getValueState("waiting", "data binary", self.ttl_ms)

    def _rows(self, state: ValueState, now: int) -> list[tuple]:
        """The rows of a packed table, without those that have not changed for too long (their last column)."""
        found = state.get() if state.exists() else None
        if found is None:
            return []
        with pa.ipc.open_stream(bytes(found[0])) as f:
            rows = list(zip(*(c.to_pylist() for c in f.read_all().columns)))
        return [r for r in rows if r[-1] > now - self.ttl_ms] if self.ttl_ms else rows

    @staticmethod
    def _save(state: ValueState, rows: list[tuple], schema: pa.Schema) -> None:
        if not rows:
            state.clear()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
            f.write_table(pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema))
        state.update((sink.getvalue().to_pybytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        # by repository and hash: part, date, whether it is let through, last change
        known = {r[:2]: r[2:] for r in self._rows(self.known, now)}
        arrived: dict[tuple, tuple] = {}
        later: dict[tuple, tuple] = {}
        for frame in rows:
            commits = frame[frame["kind"] == "commit"]
            for r in commits[[*_COLUMNS, "part"]].astype(object).where(commits[[*_COLUMNS, "part"]].notna(), None).itertuples(index=False, name=None):
                commit = r[1:3]
                if commit not in known and (commit not in arrived or (r[4] or "") > (arrived[commit][4] or "")):
                    arrived[commit] = r
            patches = frame[frame["kind"] == "patch"]
            patches = patches[_COLUMNS].astype(object).where(patches[_COLUMNS].notna(), None)
            state = [known.get(c) for c in zip(patches["repository"], patches["commit_hash"])]
            through = patches[np.array([s is not None and s[2] for s in state], bool)]
            if len(through):
                yield through
            for r in patches[np.array([s is None for s in state], bool)].itertuples(index=False, name=None):
                later[(r[1], r[2], r[7], hashlib.md5(r[8].encode()).hexdigest())] = (r[8], now)
        if arrived:
            let_in = self._merge(known, arrived, now)
            if let_in:
                yield pd.DataFrame(let_in, columns=_COLUMNS)
            self._save(self.known, [(*k, *v) for k, v in known.items()], _KNOWN)
        if not later and not (arrived and self.waiting.exists()):
            return
        waiting = {r[:4]: r[4:] for r in self._rows(self.waiting, now)} | later
        done = [k for k in waiting if k[:2] in arrived]
        out = [("patch", k[0], k[1], None, None, None, "commit", k[2], waiting[k][0]) for k in done if known[k[:2]][2]]
        for k in done:
            del waiting[k]
        self._save(self.waiting, [(*k, *v) for k, v in waiting.items()], _WAITING)
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def _merge(self, known: dict[tuple, tuple], arrived: dict[tuple, tuple], now: int) -> list[tuple]:
        """Adds the arrived commits to the known ones; returns those that are let in."""
        groups: dict[tuple, dict[tuple, str]] = {}
        for commit, r in arrived.items():
            groups.setdefault((commit[0], r[-1]), {})[commit] = r[4] or ""
        for commit, (part, date, through, _) in known.items():
            if through and (commit[0], part) in groups:
                groups[(commit[0], part)][commit] = date
        let_in = []
        for (_, part), dates in groups.items():
            # the newest first; of equal dates the smaller hash
            order = sorted(sorted(dates, key=lambda c: c[1] or ""), key=lambda c: dates[c], reverse=True)
            for place, commit in enumerate(order):
                if commit in arrived:
                    known[commit] = (part, dates[commit], place < self.n, now)
                    if place < self.n:
                        let_in.append(arrived[commit][:-1])
                elif place >= self.n:
                    known[commit] = (part, dates[commit], False, now)
        return let_in

    def close(self) -> None:
        pass


def newest_commits(commits: DataFrame, patches: DataFrame, n: int = DEFAULT_COMMITS, parts: int = PARTS,
                   ttl_ms: int | None = None, keys: int = KEYS) -> DataFrame:
    """Streams of commits and patches as one of ``kind`` commit or patch: what a scan of the newest ``n`` commits looks
    at, and everything not committed yet.

    The state grows with the commits seen (a hash, a date and a flag each, packed in ``keys`` pieces that a batch rewrites where it touches them) and with patches whose commit never comes. ``ttl_ms``
    bounds that; a query with it goes by the clock, so it has to be started with a ``processingTime`` trigger: with
    ``availableNow`` it would never be done.
    """
    patches = with_origin(patches).where(F.col("patch").isNotNull())
    none = F.lit(None).cast("string")
    of_commits = commits.select(
        F.lit("commit").alias("kind"), "repository", "commit_hash", "author", F.col("commit_date").cast("string").alias("commit_date"),
        "message", none.alias("origin"), none.alias("file_path"), none.alias("patch"))
    of_patches = patches.select(
        F.lit("patch").alias("kind"), "repository", "commit_hash", none.alias("author"), none.alias("commit_date"),
        none.alias("message"), "origin", "file_path", "patch")
    events = of_commits.unionByName(of_patches.where("origin = 'commit'"))
    keyed = events.withColumn("part", F.pmod(F.xxhash64("commit_hash"), F.lit(parts)).cast("int"))
    kept = keyed.withColumn("key", F.pmod(F.xxhash64("repository", "part"), F.lit(keys)).cast("int")).groupBy("key").transformWithStateInPandas(
        NewestCommits(n, ttl_ms), _EVENTS, "append", "ProcessingTime" if ttl_ms else "None")
    return kept.unionByName(of_patches.where("origin <> 'commit'"))


def _findings(events: DataFrame, rules: RuleSet, redaction: bool) -> DataFrame:
    """Commits and findings of some events, in one table by ``kind``: their ranks, authors and dates are not known yet."""
    unranked = events.withColumns({
        "commit_rank": F.lit(0), "commit_date": F.col("commit_date").cast("timestamp_ntz"), "date": F.lit(None).cast("string")})
    commits = unranked.where("kind = 'commit'")
    patches = unranked.where("kind = 'patch'").withColumn(
        "commit_hash", F.when(F.col("origin") == "commit", F.col("commit_hash")).otherwise(schemas.UNCOMMITTED))
    found = regex_findings(patch_units(patches).unionByName(message_units(commits)), rules)
    found = redact_findings(found, rules) if redaction else found
    listed = F.struct(*schemas.COMMITS.names)
    row = F.struct(*schemas.FINDINGS.names)
    return commits.select(F.lit("commit").alias("kind"), listed.alias("commit"), F.lit(None).alias("finding")).unionByName(
        found.select(F.lit("finding").alias("kind"), F.lit(None).alias("commit"), row.alias("finding")))


def write_history_stream(events: DataFrame, rules: RuleSet, path: str, checkpoint: str, redaction: bool = True,
                         trigger: dict | None = None) -> StreamingQuery:
    """Scans the events of ``newest_commits`` and appends commits and findings to a table, one ``batch`` folder per
    micro-batch; a batch that is run again replaces its own. State is kept in RocksDB."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # commits and findings are read from it; the state is gone through once
        try:
            _findings(batch, rules, redaction).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()

    spark = events.sparkSession
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)  # the query keeps the settings that it is started with
    try:
        return (events.writeStream.foreachBatch(save).outputMode("append")
                .option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())
    finally:
        if before is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], before)


def history_findings(spark: SparkSession, path: str, n: int = DEFAULT_COMMITS) -> DataFrame:
    """The findings of a stream's table as a scan of all that has arrived would give them: of each repository's newest
    ``n`` commits, with their rank, author and date, and of what is not committed."""
    table = spark.read.schema(
        f"batch int, kind string, commit struct<{_ddl(schemas.COMMITS)}>, finding struct<{_ddl(schemas.FINDINGS)}>").parquet(path)
    window = last_n(table.where("kind = 'commit'").select("commit.*"), n).select(
        "repository", "commit_hash", "commit_rank", "author", date_string(F.col("commit_date")).alias("date"))
    found = table.where("kind = 'finding'").select("finding.*")
    late = ["commit_rank", "author", "date"]
    committed = found.where("not is_uncommitted").drop(*late).join(window, ["repository", "commit_hash"])
    return dedup_findings(committed.unionByName(found.where("is_uncommitted")).select(*schemas.FINDINGS.names))


def _ddl(schema) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in schema.fields)

"""Counts over a stream of findings, without going over all of them again.

A batch writes how many findings it has of each kind. These partial counts are few and can be added
up, so a summary reads a row per batch and kind. They add up to the findings' number only if a finding
is in one batch: the stream drops those it has had before it counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keysift.operators.dedup import KEY, dedup_findings

KINDS = ["repository", "finding_type", "confidence", "is_uncommitted"]


def first_findings(findings: DataFrame, arrival: str | None = None, delay: str = "1 hour") -> DataFrame:
    """A stream's findings, each when it is first seen. Without ``arrival``, a timestamp column, the state has a key
    for each finding; with it, only those seen within ``delay``, and a finding seen later counts again."""
    if arrival is None:
        return findings.dropDuplicates(KEY)
    return findings.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(KEY)


def partial_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy(*KINDS).agg(F.count("*").alias("findings"))


def write_summary_stream(findings: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends the partial counts of each batch of ``first_findings``, one ``batch`` folder each; a batch that is run
    again replaces its own."""
    def save(batch: DataFrame, batch_id: int) -> None:
        partial_counts(dedup_findings(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (findings.writeStream.foreachBatch(save).outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _partial(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("repository string, finding_type string, confidence string, is_uncommitted boolean, findings long").parquet(path)


def stream_summary(spark: SparkSession, path: str) -> DataFrame:
    """``scan_summary`` of all batches so far, from their counts."""
    n, c = F.col("findings"), F.col("confidence")
    of = {"total_findings": F.sum("findings"), **{
        f"{level}_confidence": F.sum(F.when(c == level, n).otherwise(0)) for level in ("high", "medium", "low")}}
    return _partial(spark, path).groupBy("repository").agg(F.lit(0).cast("long").alias("commits_scanned"), *(
        x.alias(name) for name, x in of.items()))


def stream_type_counts(spark: SparkSession, path: str) -> DataFrame:
    """``type_counts`` of all batches so far."""
    return _partial(spark, path).groupBy("repository", "finding_type").agg(F.sum("findings").alias("findings"))


def stream_uncommitted_counts(spark: SparkSession, path: str) -> DataFrame:
    """Findings that are not committed, by repository, of all batches so far."""
    return _partial(spark, path).where("is_uncommitted").groupBy("repository").agg(F.sum("findings").alias("findings"))

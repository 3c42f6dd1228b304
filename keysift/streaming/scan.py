"""The regex scan over a stream of new units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from keysift.operators.dedup import KEY, dedup_findings
from keysift.operators.match import regex_findings
from keysift.operators.rules import RuleSet
from keysift.plans.scan import redact_findings


def stream_findings(units: DataFrame, rules: RuleSet, redaction: bool = True,
                    arrival: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Findings in a stream of units. The scan keeps no state; with ``arrival``, a
    timestamp column, a finding seen again within ``delay`` is dropped, whichever is better. ``stream_table``
    gives the best of each over all batches."""
    if arrival is None:
        findings = regex_findings(units, rules)
    else:
        findings = (regex_findings(units.withWatermark(arrival, delay), rules, (arrival,))
                    .dropDuplicatesWithinWatermark(KEY))
    return redact_findings(findings, rules) if redaction else findings


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """The findings of all batches so far, each once: the best of those that several batches found."""
    return dedup_findings(spark.read.parquet(path).drop("batch"))


def write_stream(findings: DataFrame, path: str, checkpoint: str,
                 trigger: dict | None = None) -> StreamingQuery:
    """Appends findings to a Parquet table, one ``batch`` partition per micro-batch. A
    batch that is run again after a failure replaces its own partition."""
    def save(batch: DataFrame, batch_id: int) -> None:
        dedup_findings(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (findings.writeStream.foreachBatch(save)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())

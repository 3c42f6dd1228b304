"""De-duplication of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.functions.levels import confidence_order

KEY = ["repository", "commit_hash", "file_path", "line_number", "finding_type", "secret_sha256"]


def dedup_findings(findings: DataFrame) -> DataFrame:
    """One finding per KEY: the highest confidence, then ``regex`` over the model.

    A minimum over a struct combines before the shuffle, so copies of one finding
    shrink to a row per task however many there are.
    """
    rest = [c for c in findings.columns if c not in KEY]
    best = F.min(F.struct(
        confidence_order(F.col("confidence")).alias("_confidence"),
        F.when(F.col("detector") == "regex", 0).otherwise(1).alias("_detector"),
        *rest)).alias("_best")
    return (findings.groupBy(*KEY).agg(best)
            .select(*KEY, *[F.col("_best")[c].alias(c) for c in rest])
            .select(*findings.columns))

"""Reading and writing the engine's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysift import schemas
from keysift.operators.rules import RuleSet


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    return spark.read.format(fmt).schema(schema).load(path)


def read_commits(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, fmt, schemas.COMMITS)


def read_patches(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Committed, staged and unstaged diffs and whole untracked files, by ``origin``."""
    return _read(spark, path, fmt, schemas.PATCHES)


def read_rules(spark: SparkSession, path: str, fmt: str = "parquet") -> RuleSet:
    return RuleSet.from_df(_read(spark, path, fmt, schemas.RULES))


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Known model answers, for instance of a batch job, as a cache."""
    return _read(spark, path, fmt, schemas.RESPONSES)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """JSON reports, one row per file, with the file's ``report_path``. A broken file raises.

    A file is one row, however large; reports that ``write_documents`` made are read by
    ``plans.report.read_documents``, which splits them."""
    return (spark.read.schema(schemas.REPORT).option("multiLine", True)
            .option("mode", "FAILFAST").json(path).withColumn("report_path", F.col("_metadata.file_path")))


def write_findings(findings: DataFrame, path: str) -> DataFrame:
    """Saves the findings and reads them back: a scan runs once, reports run from here."""
    findings.write.mode("errorifexists").parquet(path)
    return findings.sparkSession.read.parquet(path)

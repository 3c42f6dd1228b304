"""Counts over a findings table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift import schemas
from keysift.operators.diff import date_string
from keysift.operators.rules import RuleSet
from keysift.session import cut_lineage


def counts_by_repository(findings: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return findings.groupBy("repository").agg(
        F.count("*").alias("total_findings"),
        F.count_if(c == "high").alias("high_confidence"),
        F.count_if(c == "medium").alias("medium_confidence"),
        F.count_if(c == "low").alias("low_confidence"))


def commits_scanned(window: DataFrame) -> DataFrame:
    """Commits in the window per repository, with or without findings."""
    return (window.where(F.col("commit_hash") != schemas.UNCOMMITTED)
            .groupBy("repository").agg(F.countDistinct("commit_hash").alias("commits_scanned")))


def scan_summary(findings: DataFrame, window: DataFrame | None = None) -> DataFrame:
    """One row per repository that was scanned or has findings."""
    counts = counts_by_repository(findings)
    if window is None:
        joined = counts.withColumn("commits_scanned", F.lit(0).cast("long"))
    else:
        joined = counts.join(commits_scanned(window), "repository", "full_outer")
    zero = F.lit(0).cast("long")
    return joined.select("repository", *[F.coalesce(name, zero).alias(name) for name in (
        "commits_scanned", "total_findings", "high_confidence", "medium_confidence", "low_confidence")])


def type_counts(findings: DataFrame) -> DataFrame:
    """Findings per repository and type."""
    return findings.groupBy("repository", "finding_type").agg(F.count("*").alias("findings"))


def uncommitted(findings: DataFrame) -> DataFrame:
    """Findings in working-tree changes. The filter is on a key of the de-duplication, so it is
    applied before that, where the units are read."""
    return findings.where(F.col("commit_hash") == schemas.UNCOMMITTED)


def with_commit_details(findings: DataFrame, commits: DataFrame) -> DataFrame:
    """Author and date of each finding's commit; null for uncommitted ones.

    The commits, each once, are written first: Spark splits a commit with very many findings in a join with a
    table, not in one with an aggregate over the same key."""
    details = commits.select("repository", "commit_hash", "author",
                             date_string(F.col("commit_date")).alias("date"))
    once = details.groupBy("repository", "commit_hash").agg(F.min(F.struct("author", "date")).alias("_d"))
    once = cut_lineage(once.select("repository", "commit_hash", "_d.author", "_d.date"))
    return findings.drop("author", "date").join(once, ["repository", "commit_hash"], "left").select(*findings.columns)


def with_rules(findings: DataFrame, rules: RuleSet) -> DataFrame:
    """Findings with their rule's ``keywords``, ``description`` and ``confidence_boost``,
    null for a type that is no rule. Of several rules with one name, the first."""
    fields = ["keywords", "description", "confidence_boost"]
    first = (rules.to_df(findings.sparkSession).groupBy(F.col("name").alias("finding_type"))
             .agg(F.min(F.struct("rule_ord", *fields)).alias("_r"))
             .select("finding_type", *[f"_r.{c}" for c in fields]))
    return findings.join(F.broadcast(first), "finding_type", "left")

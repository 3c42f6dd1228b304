"""Findings of one large report.

A report is a single JSON document, as its writer indents it. The start of a finding is the only
line with a brace at its depth, so with that as the separator Spark's text source splits a file of any
size at findings. Which commit a finding belongs to stands before its commit's first finding: within a split it is carried
on in a window, and from split to split by a row for each split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keysift import schemas

KEY = r'("(?:[^"\\]|\\.)*"): \['


def read_large_reports(spark: SparkSession, path: str, indent: int = 2) -> DataFrame:
    """The findings of reports written with ``indent`` spaces per level, one row each, as
    ``plans.report.flatten_reports`` gives them: ``report`` is the file.

    Any file is read in splits (``spark.sql.files.maxPartitionBytes``). A finding that is no JSON raises; a report
    written otherwise (on one line, or with another indent) has no such finding, and none results: ``read_reports`` reads it.
    """
    pad = " " * indent
    separator, end = f"\n{pad * 3}{{", f"\n{pad * 3}}}"
    records = spark.read.option("lineSep", separator).text(path).select(
        "value", F.col("_metadata.file_path").alias("report"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"))  # in the order of the file, within a split
    is_head = F.col("value").startswith("{")
    empty = F.col("value").startswith("}")
    inside = F.when(empty, "").otherwise(F.substring_index("value", end, 1))
    after = F.when(empty, F.col("value")).otherwise(F.col("value").substr(F.length(inside) + F.lit(len(end) + 1), F.length("value")))
    opening = f'"findings_by_commit": {{'
    started = F.locate(opening, "value")
    tail = F.when(~is_head, after).when(started > 0, F.col("value").substr(started, F.length("value"))).otherwise("")
    info = F.regexp_extract("value", rf'(?s)\n{pad}"scan_info": (\{{.*?\n{pad}\}})', 1)
    parts = records.select(
        "report", "_block", "_id", F.when(~is_head, F.concat(F.lit("{"), inside, F.lit("}"))).alias("_finding"),
        F.regexp_extract_all(tail, F.lit(rf"\n{pad * 2}{KEY}"), F.lit(1)).alias("_keys"),
        F.when(info != "", info).alias("_info"))

    # in a split: how many findings and commits up to here, and what was opened last
    here = W.partitionBy("report", "_block").orderBy("_id")
    earlier = here.rowsBetween(W.unboundedPreceding, -1)
    opens = F.size("_keys") > 0
    placed = parts.withColumn("_at", F.count("_finding").over(here)).withColumns({
        "_opened": F.coalesce(F.sum(F.size("_keys")).over(earlier), F.lit(0)),
        "_key": F.last(F.when(opens, F.element_at("_keys", -1)), ignorenulls=True).over(earlier),
        "_first": F.last(F.when(opens, F.col("_at")), ignorenulls=True).over(earlier)})

    # from split to split
    per_split = parts.withColumn("_at", F.count("_finding").over(here)).groupBy("report", "_block").agg(
        F.count("_finding").alias("_findings"), F.sum(F.size("_keys")).alias("_commits"),
        F.max_by(F.element_at("_keys", -1), F.when(opens, F.col("_id"))).alias("_last"),
        F.max(F.when(opens, F.col("_at"))).alias("_open"))
    before = W.partitionBy("report").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    per_split = per_split.withColumn("_base", F.coalesce(F.sum("_findings").over(before), F.lit(0)))
    carried = per_split.select(
        "report", "_block", "_base", F.coalesce(F.sum("_commits").over(before), F.lit(0)).alias("_commits"),
        F.last("_last", ignorenulls=True).over(before).alias("_last"),
        F.last(F.col("_base") + F.col("_open"), ignorenulls=True).over(before).alias("_begun"))
    named = parts.where("_info is not null").select("report", F.from_json("_info", "repository string").alias("_i")).select(
        "report", F.col("_i.repository").alias("repository"))

    found = placed.where("_finding is not null").join(carried, ["report", "_block"]).join(named, "report", "left")
    ord_ = F.when(F.col("_key").isNotNull(), F.col("_at") - 1 - F.col("_first")).otherwise(
        F.col("_base") + F.col("_at") - 1 - F.col("_begun"))
    commit = F.get(F.from_json(F.concat(F.lit("["), F.coalesce("_key", "_last"), F.lit("]")), "array<string>"), F.lit(0))
    return found.select(
        "repository", "report", (F.col("_commits") + F.col("_opened") - 1).cast("int").alias("commit_ord"), commit.alias("commit_hash"),
        ord_.cast("int").alias("finding_ord"),
        F.from_json("_finding", schemas.REPORT_FINDING, {"mode": "FAILFAST"}).alias("_f")).select(
        "repository", "report", "commit_ord", "commit_hash", "finding_ord", "_f.*")

"""The JSON report: scan info, findings by commit, and counts by type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keysift import schemas
from keysift.plans import documents as doc
from keysift.plans.summary import scan_summary, type_counts

INFO = ["repository", "commits_scanned", "total_findings",
        "high_confidence", "medium_confidence", "low_confidence"]


def report_document(findings: DataFrame, window: DataFrame | None = None) -> DataFrame:
    """The report of each repository as document lines (see ``documents``).

    ``findings`` must be de-duplicated. Commits come newest first after uncommitted
    changes, findings by file, line and type.
    """
    repo, rank, commit = F.col("repository"), F.col("commit_rank"), F.col("commit_hash")
    info = scan_summary(findings, window)
    commits = doc.mark_first(
        findings.select("repository", "commit_rank", "commit_hash").distinct(),
        ["repository"], ["commit_rank", "commit_hash"])
    items = doc.mark_first(findings, ["repository", "commit_rank", "commit_hash"], doc.ITEM)
    types = doc.mark_first(type_counts(findings), ["repository"], ["finding_type"])
    item_json = doc.json(F.struct(*schemas.REPORT_FINDING.names))
    type_json = F.concat(doc.json_text(F.col("finding_type")), F.lit(":"), F.col("findings").cast("string"))
    return doc.union(
        doc.lines(info, F.concat(F.lit('{"scan_info":'), doc.json(F.struct(*INFO)),
                                 F.lit(',"findings_by_commit":{')),
                  repository=repo, block=F.lit(0)),
        doc.lines(commits, F.concat(doc.comma(F.col("is_first")), doc.json_text(commit), F.lit(":[")),
                  repository=repo, block=F.lit(1), commit_rank=rank, commit_hash=commit, part=F.lit(0)),
        doc.lines(items, F.concat(doc.comma(F.col("is_first")), item_json),
                  repository=repo, block=F.lit(1), commit_rank=rank, commit_hash=commit, part=F.lit(1),
                  **{c: F.col(c) for c in doc.ITEM}),
        doc.lines(commits, F.lit("]"),
                  repository=repo, block=F.lit(1), commit_rank=rank, commit_hash=commit, part=F.lit(2)),
        doc.lines(info, F.lit('},"summary":{"finding_types":{'), repository=repo, block=F.lit(2)),
        doc.lines(types, F.concat(doc.comma(F.col("is_first")), type_json),
                  repository=repo, block=F.lit(3), finding_type=F.col("finding_type")),
        doc.lines(info, F.lit("}}}"), repository=repo, block=F.lit(4)))


def flatten_reports(reports: DataFrame) -> DataFrame:
    """Findings of parsed reports (schema REPORT), one row each, in report order:
    ``repository, report, commit_ord, commit_hash, finding_ord`` and the finding's fields. ``report``
    tells reports of one repository apart: the file (``report_path``), or else a hash of the content."""
    content = F.sha2(F.to_json(F.struct(*schemas.REPORT.names)), 256)
    name = F.coalesce("report_path", content) if "report_path" in reports.columns else content
    return (reports.select(F.col("scan_info.repository").alias("repository"), name.alias("report"),
                           F.posexplode("findings_by_commit").alias("commit_ord", "commit_hash", "_findings"))
            .select("repository", "report", "commit_ord", "commit_hash",
                    F.posexplode("_findings").alias("finding_ord", "_f"))
            .select("repository", "report", "commit_ord", "commit_hash", "finding_ord", "_f.*"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The reports that ``write_documents`` put at ``path``, flattened as ``flatten_reports`` does, with
    ``finding_ord`` counting over the whole report.

    Part files are read by themselves: a line is a finding, or opens a commit, or neither. What
    leads across files is a row for each: how many commits it opens, and the last one.
    """
    files = spark.read.schema("value string, repository string").option("wholetext", True).format("text").load(path).select(
        F.col("repository").alias("_folder"), F.col("_metadata.file_name").alias("_file"),
        F.split("value", "\n").alias("_lines"))
    return flatten_lines(files.select("_folder", "_file", F.posexplode("_lines").alias("_at", "_line")), path)


def flatten_lines(lines: DataFrame, path: str) -> DataFrame:
    """The findings in reports by the lines of their files: ``_folder`` (the repository), ``_file``, ``_at`` and ``_line``."""
    key = F.regexp_extract("_line", r'^,?("(?:[^"\\]|\\.)*"):\[$', 1)
    here = W.partitionBy("_folder", "_file").orderBy("_at")
    told = lines.withColumn("_key", F.when(key != "", key)).where(
        F.col("_key").isNotNull() | F.col("_line").rlike(r"^,?\{") & ~F.col("_line").startswith('{"scan_info":'))
    told = told.withColumns({
        "_commit": F.last("_key", ignorenulls=True).over(here), "_opened": F.count("_key").over(here)})
    per_file = told.groupBy("_folder", "_file").agg(
        F.max_by("_key", F.when(F.col("_key").isNotNull(), F.col("_at"))).alias("_last"),
        F.count("_key").alias("_commits"), F.max("_at").alias("_size"))
    before = W.partitionBy("_folder").orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    carried = per_file.select(
        "_folder", "_file", F.last("_last", ignorenulls=True).over(before).alias("_last"),
        F.coalesce(F.sum("_commits").over(before), F.lit(0)).alias("_commits"),
        F.coalesce(F.sum(F.col("_size") + 1).over(before), F.lit(0)).alias("_start"))
    found = told.where("_key is null").join(carried, ["_folder", "_file"])
    name = F.get(F.from_json(F.concat(F.lit("["), F.coalesce("_commit", "_last"), F.lit("]")), "array<string>"), F.lit(0))
    item = F.from_json(F.ltrim(F.col("_line"), F.lit(",")), schemas.REPORT_FINDING, {"mode": "FAILFAST"})
    return found.select(
        F.col("_folder").alias("repository"), F.concat(F.lit(path), F.lit("/"), F.col("_folder")).alias("report"),
        (F.col("_commits") + F.col("_opened") - 1).cast("int").alias("commit_ord"), name.alias("commit_hash"),
        (F.col("_start") + F.col("_at")).cast("int").alias("finding_ord"), item.alias("_f")).select(
        "repository", "report", "commit_ord", "commit_hash", "finding_ord", "_f.*")

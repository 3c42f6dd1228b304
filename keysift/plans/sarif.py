"""SARIF 2.1.0 export: rules and results per repository, and the whole log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.functions import levels
from keysift.functions.text import title_case
from keysift.operators.answers import DEFAULT_CONFIDENCE, DEFAULT_RATIONALE, DEFAULT_TYPE
from keysift.plans import documents as doc

# Fixed values of the log.
SCHEMA_URL = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
SARIF_VERSION = "2.1.0"
RULE_SHORT, RULE_FULL = "Detects {}", "This rule identifies potential {} in the codebase."
RULE_HELP = "Remove hardcoded secrets and use environment variables or secret management services."
RULE_LEVEL = "error"
RULE_TAGS = ["security", "secrets"]
RULE_PRECISION = "high"
URI_BASE = "SRCROOT"
DEFAULT_PATH = "unknown"
DEFAULT_LINE = 1
DEFAULT_SNIPPET = ""
DEFAULT_AUTHOR = "unknown"
DEFAULT_DATE = "unknown"


@dataclass(frozen=True)
class Tool:
    """The driver named in the log."""

    name: str = "keysift"
    information_uri: str = "https://example.com/keysift"
    version: str = "1.0.0"


def _text(value: Column) -> Column:
    return F.struct(value.alias("text"))


def fill_defaults(findings: DataFrame) -> DataFrame:
    """Null fields replaced by what the log shows for them."""
    defaults = {
        "finding_type": DEFAULT_TYPE, "confidence": DEFAULT_CONFIDENCE, "rationale": DEFAULT_RATIONALE,
        "file_path": DEFAULT_PATH, "line_number": DEFAULT_LINE, "snippet": DEFAULT_SNIPPET,
        "author": DEFAULT_AUTHOR, "date": DEFAULT_DATE}
    return findings.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def sarif_rules(findings: DataFrame) -> DataFrame:
    """``repository, id, rule``: one rule object per distinct finding type."""
    words = F.replace(F.col("id"), F.lit("_"), F.lit(" "))

    def around(template: str) -> Column:
        before, after = template.split("{}")
        return F.concat(F.lit(before), words, F.lit(after))

    rule = F.struct(
        F.col("id").alias("id"),
        title_case(words).alias("name"),
        _text(around(RULE_SHORT)).alias("shortDescription"),
        _text(around(RULE_FULL)).alias("fullDescription"),
        _text(F.lit(RULE_HELP)).alias("help"),
        F.struct(F.lit(RULE_LEVEL).alias("level")).alias("defaultConfiguration"),
        F.struct(F.array(*map(F.lit, RULE_TAGS)).alias("tags"),
                 F.lit(RULE_PRECISION).alias("precision")).alias("properties"))
    types = findings.select("repository", F.coalesce("finding_type", F.lit(DEFAULT_TYPE)).alias("id"))
    return types.distinct().select("repository", "id", rule.alias("rule"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """The findings' columns plus ``result``, one result object per finding."""
    commit = levels.short_commit(F.col("commit_hash"))
    location = F.struct(F.struct(
        F.struct(F.col("file_path").alias("uri"), F.lit(URI_BASE).alias("uriBaseId")).alias("artifactLocation"),
        F.struct(F.col("line_number").alias("startLine"),
                 _text(F.col("snippet")).alias("snippet")).alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("finding_type").alias("ruleId"),
        levels.sarif_level(F.col("confidence")).alias("level"),
        _text(F.col("rationale")).alias("message"),
        F.array(location).alias("locations"),
        F.struct(commit.alias("commitHash")).alias("partialFingerprints"),
        F.struct("confidence", commit.alias("commit"), "author", "date").alias("properties"))
    return fill_defaults(findings).select("*", result.alias("result"))


def sarif_document(findings: DataFrame, tool: Tool = Tool(), window: DataFrame | None = None) -> DataFrame:
    """The log of each repository as document lines (see ``documents``); with the
    commit ``window``, also of those without findings.

    ``findings`` is a de-duplicated scan, or the rows of ``flatten_reports``, which
    keep their report's order whatever they hold. Several reports of one repository follow each
    other by ``report``; one that is there twice counts once.
    """
    ordered = findings
    if "commit_ord" in findings.columns:
        # the report's order takes the place of the scan's
        order = ["report", "commit_ord", "finding_ord"]
        ordered = (findings.dropDuplicates(["repository", *order]).withColumn("commit_rank", F.col("commit_ord"))
                   .withColumn("secret_sha256", F.lit(None).cast("string")))
    else:
        order = ["commit_rank", "commit_hash", *doc.ITEM]
    repo = F.col("repository")
    head = F.concat(
        F.lit(f'{{"$schema":"{SCHEMA_URL}","version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":{{"name":'),
        doc.json_text(F.lit(tool.name)), F.lit(',"informationUri":'), doc.json_text(F.lit(tool.information_uri)),
        F.lit(',"version":'), doc.json_text(F.lit(tool.version)), F.lit(',"rules":['))
    repositories = findings.select("repository")
    if window is not None:
        repositories = repositories.unionByName(window.select("repository"))
    repositories = repositories.distinct()
    rules = doc.mark_first(sarif_rules(findings), ["repository"], ["id"])
    results = doc.mark_first(sarif_results(ordered), ["repository"], order)
    in_order = ({"report": F.col("report"), "commit_rank": F.col("commit_ord"), "line_number": F.col("finding_ord")}
                if "commit_ord" in findings.columns else
                {c: F.col(c) for c in ["commit_rank", "commit_hash", *doc.ITEM]})
    return doc.union(
        doc.lines(repositories, head, repository=repo, block=F.lit(0)),
        doc.lines(rules, F.concat(doc.comma(F.col("is_first")), doc.json(F.col("rule"))),
                  repository=repo, block=F.lit(1), finding_type=F.col("id")),
        doc.lines(repositories, F.lit(']}},"results":['), repository=repo, block=F.lit(2)),
        doc.lines(results, F.concat(doc.comma(F.col("is_first")), doc.json(F.col("result"))),
                  repository=repo, block=F.lit(3), **in_order),
        doc.lines(repositories, F.lit("]}]}"), repository=repo, block=F.lit(4)))

"""The whole scan: commits and patches in, findings out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.functions.redact import redact, redact_model, redact_text
from keysift.operators.dedup import dedup_findings
from keysift.operators.diff import scan_units
from keysift.operators.history import last_n
from keysift.operators.inference import ClientFactory, model_run
from keysift.operators.match import regex_findings
from keysift.operators.prompts import ModelOptions
from keysift.operators.rules import RuleSet, default_rules

DEFAULT_COMMITS = 10


def redact_findings(findings: DataFrame, rules: RuleSet) -> DataFrame:
    """Snippets and rationales without whole secrets; secret_sha256 stays as it is. The
    rationale of a regex finding is its rule's description and needs no work."""
    told = redact_text(F.col("rationale"), F.col("snippet"), rules)
    by_rule = F.col("detector") == "regex"
    return findings.withColumns({
        "rationale": F.when(by_rule, F.col("rationale")).otherwise(told),
        "snippet": F.when(by_rule, redact(F.col("snippet"), rules)).otherwise(redact_model(F.col("snippet"), rules))})


def scan_texts_and_failures(
        units: DataFrame, rules: RuleSet | None = None, client_factory: ClientFactory | None = None,
        model: ModelOptions = ModelOptions(), cache: DataFrame | None = None,
        redaction: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """De-duplicated findings in units, by the rules and, with a client or a table of known
    answers, by a model; and per repository the chunks whose model call failed, which the findings
    say nothing of (``failed_chunks``; None without a model)."""
    rules = rules or default_rules()
    findings, failures = regex_findings(units, rules), None
    if client_factory is not None or cache is not None:
        run = model_run(units, rules, client_factory, model, cache)
        findings, failures = findings.unionByName(run.findings), run.failures
    findings = dedup_findings(findings)
    return redact_findings(findings, rules) if redaction else findings, failures


def scan_texts(units: DataFrame, *args, **options) -> DataFrame:
    """The findings of ``scan_texts_and_failures``, with its arguments."""
    return scan_texts_and_failures(units, *args, **options)[0]


def scan_and_failures(
        commits: DataFrame, patches: DataFrame, rules: RuleSet | None = None,
        client_factory: ClientFactory | None = None, n: int = DEFAULT_COMMITS, redaction: bool = True,
        model: ModelOptions = ModelOptions(), cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Findings in the last ``n`` commits of every repository and in its uncommitted changes, and
    what failed. Save the findings before making reports from them."""
    return scan_texts_and_failures(scan_units(last_n(commits, n), patches), rules,
                                   client_factory, model, cache, redaction)


def scan(commits: DataFrame, patches: DataFrame, *args, **options) -> DataFrame:
    """The findings of ``scan_and_failures``, with its arguments."""
    return scan_and_failures(commits, patches, *args, **options)[0]

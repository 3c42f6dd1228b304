"""Redaction: no whole secret may survive in a snippet or a rationale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keysift.operators.rules import RuleSet

KEEP = 4
DOTS = "..."

# A short label, `:` or `=`, an optional quote; then the value's first word. The label is
# limited, and `==` or a lone trailing `=` is no assignment, so that a base64 text is
# never taken for a label.
ASSIGNMENT = (r"""(?s)^(["']?[A-Za-z_][A-Za-z0-9_.-]{0,31}["']?[ \t]*[:=]\s*["']?)"""
              r"""([^=\s"'][^\s"']*).*$""")


def head(s: Column) -> Column:
    """The first characters and dots; nothing of a string that short."""
    return F.when(F.length(s) > KEEP, F.concat(F.substring(s, 1, KEEP), F.lit(DOTS))).otherwise(DOTS)


def _mask_rule(s: Column, regex: Column) -> Column:
    """Every match of one regex reduced to its head."""
    around = F.split(s, regex, -1)
    masked = F.transform(F.regexp_extract_all(s, regex, F.lit(0)), head)
    # a regex that can match nothing may split differently: hide everything then
    aligned = F.size(around) == F.size(masked) + 1
    rebuilt = F.array_join(F.zip_with(
        around, F.array_append(masked, F.lit("")), lambda a, m: F.concat(a, m)), "")
    return F.when(aligned, rebuilt).otherwise(DOTS)


def mask_matches(s: Column, rules: RuleSet) -> Column:
    """Every match of every rule keeps its first characters only."""
    regexes = [F.lit(rule.java_regex) for _, rule in rules.scannable()]
    if not regexes:
        return s
    return F.aggregate(F.array(*regexes), s, lambda acc, regex: F.when(
        F.regexp_like(acc, regex), _mask_rule(acc, regex)).otherwise(acc))


def redact(snippet: Column, rules: RuleSet) -> Column:
    """What follows an assignment, else all but the head, then any rule match left."""
    cut = F.when(F.regexp_like(snippet, F.lit(ASSIGNMENT)),
                 F.regexp_replace(snippet, F.lit(ASSIGNMENT), F.lit("$1" + DOTS))).otherwise(head(snippet))
    return mask_matches(cut, rules)


def redact_model(snippet: Column, rules: RuleSet) -> Column:
    """A model's snippet is free text: what stands before ``:`` or ``=`` may be the secret. It is kept if it
    is letters, and one of its parts is a rule keyword; else only the head is."""
    words = sorted({k.lower() for rule in rules for k in rule.keywords})
    label = F.lower(F.regexp_extract(snippet, r"""^["']?([A-Za-z_.-]+)["']?[ \t]*[:=]""", 1))
    known = F.arrays_overlap(F.split(label, "[_.-]+"), F.array(*map(F.lit, words)).cast("array<string>"))
    return F.when(known, redact(snippet, rules)).otherwise(mask_matches(head(snippet), rules))


def redact_text(s: Column, snippet: Column, rules: RuleSet) -> Column:
    """Free text about a finding: its snippet, the value assigned in it, and any rule
    match are masked."""
    value = F.regexp_extract(snippet, ASSIGNMENT, 2)
    whole = F.when(F.length(F.trim(snippet)) > 0, F.replace(s, snippet, head(snippet))).otherwise(s)
    parts = F.when(F.length(value) > KEEP, F.replace(whole, value, head(value))).otherwise(whole)
    return mask_matches(parts, rules)

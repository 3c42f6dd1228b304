"""The regex scan: one pass over the text for all rules, without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift import schemas
from keysift.functions import levels
from keysift.functions.text import LINES, match_lines, newlines
from keysift.operators.automaton import candidates
from keysift.operators.rule_tables import RuleTable, find_filed, spread_by_number
from keysift.operators.rules import FOLDING_LETTERS, Rule, RuleSet

#: Rules that are literals of one expression; the literals of more are one automaton.
INLINE_RULES = 64


def _contains_any(text: Column, literals: tuple[str, ...] | str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(x) for x in literals])


def _folded(rule: Rule, group: tuple[str, ...]) -> bool:
    """Whether the rule ignores the case of letters in the group."""
    return rule.ignores_case and any(c.isalpha() for literal in group for c in literal)


def _anchored(rule: Rule, group: tuple[str, ...], text: Column) -> Column:
    """Whether the text has a literal of the group."""
    if _folded(rule, group):
        return F.col("_folds") | _contains_any(F.col("_lower"), group)
    return _contains_any(text, group)


def find_matches(units: DataFrame, rules: RuleSet | RuleTable, text: str = "text") -> DataFrame:
    """One row per unit and rule with a match: the unit's columns, ``rule_ord`` and
    ``matches``, all matches in order.

    A rule's regex runs only over texts that hold its anchors; finding a literal takes
    a tenth of a regex pass, and the first anchors of all rules are looked up once. The
    rules are literals of one array, so each regex is compiled once per task, and a unit
    is copied for the rules that match it only. The array stays inside the explode: above it, the
    optimizer would run the regexes twice, and a generated method for all rules would
    be too long for the JVM to compile.
    """
    if isinstance(rules, RuleTable):
        return _find_in_table(units, rules, text)
    scannable = rules.scannable()
    if not scannable:
        return units.select("*", F.lit(0).alias("rule_ord"),
                            F.array().cast("array<string>").alias("matches")).where(F.lit(False))
    if len(scannable) > INLINE_RULES:
        return _find_candidates(units, rules, text)
    t, whole = F.col(text), F.lit(0)
    first: dict[tuple, tuple[str, Column]] = {}
    per_rule = []
    for rule in rules:
        if not rule.regex:
            per_rule.append(F.lit(None).cast("array<string>"))
            continue
        matches = F.regexp_extract_all(t, F.lit(rule.java_regex), whole)
        if rule.anchors:
            group, *others = rule.anchors
            key = (group, _folded(rule, group))
            if key not in first:
                first[key] = (f"_a{len(first)}", _anchored(rule, group, t))
            gate = reduce(lambda a, b: a & b, [F.col(first[key][0]), *[_anchored(rule, g, t) for g in others]])
            if rule.probe:
                gate = gate & t.rlike(rule.probe)
            matches = F.when(gate, matches)
        per_rule.append(matches)
    in_order = rules.ords == tuple(range(len(rules)))

    def number(i: Column) -> Column:
        return i if in_order else F.element_at(F.array(*map(F.lit, rules.ords)), i + 1)

    hits = F.filter(
        F.transform(F.array(*per_rule), lambda m, i: F.struct(number(i).alias("rule_ord"), m.alias("matches"))),
        lambda h: F.size(h["matches"]) > 0)
    if all(rule.anchors for _, rule in scannable):
        hits = F.when(reduce(lambda a, b: a | b, [F.col(name) for name, _ in first.values()]), hits)
    return (units
            .select("*", F.lower(t).alias("_lower"), _contains_any(t, FOLDING_LETTERS).alias("_folds"))
            .select("*", *[lookup.alias(name) for name, lookup in first.values()])
            .select(*units.columns, F.explode(hits).alias("_hit"))
            .select(*units.columns, "_hit.rule_ord", "_hit.matches"))


def _find_candidates(units: DataFrame, rules: RuleSet, text: str) -> DataFrame:
    """``find_matches`` by the automaton."""
    matches = F.transform("_candidates", lambda c: F.struct(
        c["rule_ord"].alias("rule_ord"), F.regexp_extract_all(F.col(text), c["regex"], F.lit(0)).alias("matches")))
    hits = F.filter(matches, lambda h: F.size(h["matches"]) > 0)
    return (units
            .select("*", candidates(units.sparkSession, F.col(text), rules).alias("_candidates"))
            .select(*units.columns, F.explode(hits).alias("_hit"))
            .select(*units.columns, "_hit.rule_ord", "_hit.matches"))


def _find_in_table(units: DataFrame, rules: RuleTable, text: str) -> DataFrame:
    """``find_matches`` by a table of any size: its rules with a filed literal by a join, the others on every text."""
    units = spread_by_number(units)
    found = [f for f in (find_filed(units, rules, text), find_matches(units, rules.rest, text) if rules.rest else None) if f is not None]
    return reduce(DataFrame.unionByName, found) if found else find_matches(units, RuleSet([]), text)


def _looked_up(told: DataFrame, rules: RuleSet | RuleTable) -> DataFrame:
    """The rules' side of a join: a set is bounded and broadcast, a table is not."""
    return told if isinstance(rules, RuleTable) else F.broadcast(told)


def match_values(units: DataFrame, rules: RuleSet | RuleTable, text: str = "text") -> DataFrame:
    """One row per match, without lines: the unit's columns but the text, the rule's
    name, ``match_no`` (from 0) and ``match``."""
    keep = [c for c in units.columns if c not in (text, "line_nos")]
    names = rules.to_df(units.sparkSession).select("rule_ord", F.col("name").alias("rule"))
    return (find_matches(units, rules, text)
            .select(*keep, "rule_ord", F.posexplode("matches").alias("match_no", "match"))
            .where(F.col("match") != "")
            .join(_looked_up(names, rules), "rule_ord")
            .select(*keep, "rule_ord", "rule", "match_no", "match"))


def _needed(units: DataFrame, rules: RuleSet | RuleTable, *columns: str) -> DataFrame:
    """A table deals the units to tasks by all their columns, so that copies of a text do not meet in one."""
    return units if isinstance(rules, RuleTable) else units.select(*columns)


def count_by_rule(units: DataFrame, rules: RuleSet | RuleTable, text: str = "text") -> DataFrame:
    """Matches per rule; the text never leaves the scan's stage, but for a table's."""
    names = rules.to_df(units.sparkSession).select("rule_ord", F.col("name").alias("rule"))
    return (find_matches(_needed(units, rules, text), rules, text)
            .select("rule_ord", F.size(F.array_remove("matches", "")).alias("n"))
            .groupBy("rule_ord").agg(F.sum("n").alias("hits"))
            .where("hits > 0")
            .join(_looked_up(names, rules), "rule_ord")
            .select("rule", "hits"))


def type_counts(units: DataFrame, rules: RuleSet | RuleTable, text: str = "text") -> DataFrame:
    """``repository, finding_type, findings``: the matches of each rule, counted without
    their lines or values."""
    names = rules.to_df(units.sparkSession).select("rule_ord", F.col("name").alias("finding_type"))
    return (find_matches(_needed(units, rules, "repository", text), rules, text)
            .select("repository", "rule_ord", F.size(F.array_remove("matches", "")).cast("long").alias("n"))
            .groupBy("repository", "rule_ord").agg(F.sum("n").alias("n")).where("n > 0")
            .join(_looked_up(names, rules), "rule_ord")
            .groupBy("repository", "finding_type").agg(F.sum("n").alias("findings")))


def locate_matches(units: DataFrame, rules: RuleSet, text: str = "text") -> DataFrame:
    """One row per match with its rule's columns, ``line_number`` (the file line it
    starts on) and ``keyword_hit`` (a rule keyword on one of its lines)."""
    keep = [c for c in units.columns if c not in (text, "line_nos")]
    t, regex = F.col(text), F.col("regex")
    line_nos = F.col("line_nos") if "line_nos" in units.columns else None
    # only a match with a line break can end on another line than it starts on
    breaks = F.exists("matches", lambda m: m.contains("\n"))
    last = match_lines(t, regex, None, F.col("keywords"), at_end=True)
    found = find_matches(units, rules, text).join(
        _looked_up(rules.lookup(units.sparkSession), rules), "rule_ord")
    placed = found.select(
        *keep, "rule_ord", "name", "keywords", "description", "confidence_boost",
        F.explode(F.arrays_zip(
            F.col("matches").alias("match"),
            match_lines(t, regex, line_nos, F.col("keywords")).alias("first"),
            F.when(breaks, last).otherwise(F.array().cast(LINES)).alias("last"),
        )).alias("m"))
    # lines between the first and the last lie inside the match itself
    inside = F.exists("keywords", lambda k: F.contains(F.lower(F.col("m.match")), F.lower(k)))
    return placed.where(F.col("m.match") != "").select(
        *keep, "rule_ord", F.col("name").alias("rule"), "description", "confidence_boost",
        F.col("m.match").alias("match"),
        F.col("m.first.file_line").alias("line_number"),
        (newlines(F.col("m.match")) + 1).alias("n_lines"),
        (F.col("m.first.keyword") | F.coalesce("m.last.keyword", F.lit(False)) | inside).alias("keyword_hit"))


def regex_findings(units: DataFrame, rules: RuleSet, carry: tuple[str, ...] = ()) -> DataFrame:
    """The scan of ``units`` as raw findings; the snippet is the match itself.
    ``carry`` names further columns of ``units`` to keep."""
    points = levels.score(F.col("confidence_boost"), F.col("keyword_hit"))
    return locate_matches(units, rules).select(
        "repository", "commit_hash", "commit_rank", "file_path",
        F.col("line_number").cast("int").alias("line_number"),
        F.col("match").alias("snippet"),
        F.col("rule").alias("finding_type"),
        levels.confidence(points).alias("confidence"),
        F.col("description").alias("rationale"),
        "author", "date",
        (F.col("commit_hash") == schemas.UNCOMMITTED).alias("is_uncommitted"),
        F.lit("regex").alias("detector"),
        F.sha2("match", 256).alias("secret_sha256"), *carry)

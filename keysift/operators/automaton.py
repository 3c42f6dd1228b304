"""Candidate rules of a text, by one automaton over the literals of all rules.

The literals of a rule set of any size are one Aho-Corasick automaton per kind of case, sent to the
tasks once. It reads Arrow batches of texts and gives each text the rules of which it holds
a literal, with their regexes; the plan does not grow with the rules, and the
regexes run in the JVM, on candidates only.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from keysift.operators.rules import FOLDING_LETTERS, RuleSet

CANDIDATES = "array<struct<rule_ord:int,regex:string>>"
_MADE: dict[str, Finder] = {}
#: Automata that a worker keeps.
KEPT = 4

Row = tuple[int, str, bool, tuple[str, ...]]


class Finder:
    """The rules of a text; ``rows`` are (rule_ord, regex, ignores case, literals of which a match holds one)."""

    def __init__(self, rows: list[Row]):
        self.ords = pa.array([r[0] for r in rows], pa.int32())
        self.regexes = pa.array([r[1] for r in rows], pa.string())
        self.always = [i for i, r in enumerate(rows) if not r[3]]
        self.folding = [i for i, r in enumerate(rows) if r[3] and r[2]]
        of: dict[bool, dict[str, list[int]]] = {False: {}, True: {}}
        for i, (_, _, folds, literals) in enumerate(rows):
            for literal in literals:
                of[folds].setdefault(literal, []).append(i)
        self.exact, self.lower = (self._automaton(of[kind]) for kind in (False, True))

    @staticmethod
    def _automaton(rules_of: dict[str, list[int]]) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for literal, rules in rules_of.items():
            found.add_word(literal, tuple(rules))
        found.make_automaton()
        return found if rules_of else None

    def rules_of(self, text: str) -> list[int]:
        hits = {rules for _, rules in self.exact.iter(text)} if self.exact else set()
        candidates = set(self.always).union(*hits)
        if self.lower:
            candidates.update(*{rules for _, rules in self.lower.iter(text.lower())})
            if any(c in text for c in FOLDING_LETTERS):
                candidates.update(self.folding)
        return sorted(candidates)

    def find(self, texts: pa.Array) -> pa.Array:
        found = [[] if t is None else self.rules_of(t) for t in texts.to_pylist()]
        at = pa.array(np.concatenate([np.zeros(0, np.int64), *(np.array(f, np.int64) for f in found)]))
        ends = np.cumsum([0, *map(len, found)])
        rules = pa.StructArray.from_arrays([self.ords.take(at), self.regexes.take(at)], ["rule_ord", "regex"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rules)


def _finder(key: str, sent: Broadcast) -> Finder:
    if key not in _MADE:
        while len(_MADE) >= KEPT:
            _MADE.pop(next(iter(_MADE)))
        _MADE[key] = Finder(sent.value)
    return _MADE[key]


def best(groups: tuple[tuple[str, ...], ...]) -> tuple[str, ...]:
    """The group whose shortest literal is the longest."""
    return max(groups, key=lambda g: min(map(len, g)), default=())


def candidates(spark: SparkSession, text: Column, rules: RuleSet) -> Column:
    """``array<struct<rule_ord, regex>>``: the rules that may match, all those without a literal among them; null text, none."""
    rows = [(i, r.java_regex, r.ignores_case, tuple(x.lower() if r.ignores_case else x for x in best(r.anchors)))
            for i, r in rules.scannable()]
    key = hashlib.sha256(repr(rows).encode()).hexdigest()
    sent = spark.sparkContext.broadcast(rows)  # as large as the rule set, which is bounded

    @F.arrow_udf(CANDIDATES)
    def of(texts: pa.Array) -> pa.Array:
        return _finder(key, sent).find(texts)

    return of(text)

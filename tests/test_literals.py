"""Literals derived from regexes, and scans of many rules."""

import dataclasses
import random
import re
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keysift.operators import literals, match
from keysift.operators.automaton import Finder
from keysift.operators.rules import ANCHORS, BUILT_IN, Rule, RuleSet, default_rules
from tests.test_rules import NEGATIVE, POSITIVE


def groups(regex, fold=False):
    return {tuple(sorted(g)) for g in literals.required(regex, fold)}


def test_derived_anchors_imply_the_written_ones():
    for name, regex, *_ in BUILT_IN:
        rule = Rule(name, regex, (), "")
        derived = literals.required(regex.removeprefix("(?i)"), rule.ignores_case)
        for written in ANCHORS[name]:
            assert any(all(any(w in d for w in written) for d in group) for group in derived), (name, written)
        assert rule.anchors  # what a scan looks up, when the rule comes from a table


@pytest.mark.parametrize(("regex", "want"), [
    ("abc", {("abc",)}), ("ab?c", {("abc", "ac")}), ("a(b|cd)e", {("abe", "acde")}), ("ab+c", {("ab",), ("bc",)}),
    ("ab{3}c", {("abbbc",)}), ("a{2,}", {("aa",)}), ("x*", set()), ("(x|)", set()), ("ab[0-9]cd", {("ab",), ("cd",)}),
    ("a[bc]d", {("abd", "acd")}), ("(?:ab|cd)[0-9]+(?:ef|gh)", {("ab", "cd"), ("ef", "gh")}),
    ("foo.*bar|foobar", {("foo",), ("bar",)}), ("a.b|c", {("a", "c"), ("b", "c")}), (r"\bkey\b", {("key",)}),
    ("(?=look)ab(?!no)", {("ab",)}), ("(?<n>ab)c", {("abc",)}), ("(?>ab)c", {("abc",)}), ("ab++c", {("ab",), ("bc",)}),
    ("[^a]b", {("b",)}), ("^ab$", {("ab",)}), ("(a)\\1", {("a",)}), ("(?i:ab)c", {("c",)}), ("a\\.b", {("a.b",)}),
])
def test_required(regex, want):
    assert groups(regex) == want


@pytest.mark.parametrize("regex", [
    "[a[bc]]", "[a-z&&[^b]]x", r"a\vb", r"(a)\12", r"\Qa.b\E", "(?x) a b", "(?si)ab", r"\p{L}ab", "a(b", "[]a]b", r"a\b{g}b", "(a", r"\hab",
])
def test_what_java_reads_differently_gives_nothing(regex):
    assert literals.required(regex) == []


def test_ignoring_case():
    assert groups("To[Kk]en", True) == {("token",)}
    assert groups("é-ab", True) == {("-ab",)} and groups("é-ab") == {("é-ab",)}


def random_regex(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 4)
    if kind < 3:
        return "".join(rng.choice("abkß-.1") for _ in range(rng.randint(1, 3))).replace(".", "\\.")
    if kind == 3:
        return rng.choice(["[ab]", "[^a]", ".", "[a-k1]", "\\d", "\\b", "[0-9k]"])
    inner = random_regex(rng, depth + 1)
    if kind == 4:
        return f"(?:{inner}){rng.choice(['?', '*', '+', '{2}', '{1,2}', '+?', '{0,3}'])}"
    if kind == 5:
        return f"(?:{inner}|{random_regex(rng, depth + 1)}|{random_regex(rng, depth + 1)})"
    return inner + random_regex(rng, depth + 1)


def test_no_match_without_its_literals():
    rng = random.Random(11)
    matched = 0
    for _ in range(3000):
        fold = rng.random() < 0.4
        regex = random_regex(rng)
        found = literals.required(regex, fold)
        compiled = re.compile(regex, re.IGNORECASE if fold else 0)
        for _ in range(20):
            text = "".join(rng.choice("abkABKß-.1") for _ in range(rng.randint(0, 9)))
            for m in compiled.finditer(text):
                matched += 1
                held = m.group().lower() if fold else m.group()
                # lookarounds apart, the match itself holds them
                assert all(any(x in held for x in group) for group in found), (regex, text, found)
    assert matched > 10_000


def many(n):
    shapes = [r"tok{i}_[a-z0-9]+", r"(?i)Key{i}[\s]*[:=][\s]*[a-z]+", r"(?:ab|cd){i}-[0-9]", r"[0-9]{{3}}x{i}\b", r"(?i)s{i}\w*"]
    return [Rule(f"r{i}", shapes[i % len(shapes)].format(i=i), (f"k{i}",), f"R {i}", Decimal("0.1")) for i in range(n)]


def test_many_rules_find_the_same(units, monkeypatch):
    """The automaton, one expression with derived anchors, and every regex on every text."""
    rng = random.Random(5)
    rules = RuleSet([*default_rules(), *many(80), Rule("any", "[0-9]{4}", (), "No literal"), Rule("empty", "x*", (), "E")])
    pieces = [*POSITIVE.values(), *NEGATIVE.values(), " ", "\n", "é", "ſ", "İ", "Key3 = abc", "ſ4"]
    for i in range(80):
        pieces += [f"tok{i}_a1", f"KEY{i} : x", f"ab{i}-7", f"CD{i}-7", f"123x{i}", f"S{i}"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    df = units(*texts, None, "").repartition(3)
    bare = RuleSet([dataclasses.replace(r, anchors=(), probe=None) for r in rules])
    by_automaton = match.regex_findings(df, rules).collect()
    no_literals = match.regex_findings(df, bare).collect()
    monkeypatch.setattr(match, "INLINE_RULES", 1000)
    in_line = match.regex_findings(df, rules).collect()
    without = match.regex_findings(df, bare).collect()
    assert sorted(map(repr, by_automaton)) == sorted(map(repr, in_line)) == sorted(map(repr, without)) == sorted(map(repr, no_literals))
    assert len({r.finding_type for r in by_automaton}) > 70


def test_finder():
    rows = [(7, "A", False, ("ab", "cd")), (9, "B", True, ("ab",)), (3, "C", False, ())]
    finder = Finder(rows)
    assert [finder.rules_of(t) for t in ("xaby", "AB", "cd", "", "ſ")] == [[0, 1, 2], [1, 2], [0, 2], [2], [1, 2]]
    import pyarrow as pa
    assert finder.find(pa.array(["cd", None, ""])).to_pylist() == [
        [{"rule_ord": 7, "regex": "A"}, {"rule_ord": 3, "regex": "C"}], [], [{"rule_ord": 3, "regex": "C"}]]
    assert Finder([]).find(pa.array([], pa.string())).to_pylist() == []


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plan_does_not_grow_with_the_rules(units):
    df = units("tok5_a")
    sizes = []
    for n in (100, 2000):
        rules = RuleSet(many(n))
        sizes.append(len(plan_of(match.find_matches(df, rules))))
        assert match.find_matches(df, rules).count() == 1
    assert abs(sizes[0] - sizes[1]) < 50


def test_regexes_are_checked_together(spark):
    start = time.time()
    RuleSet([Rule(f"r{i}", f"unique{i}[0-9]+", (), "") for i in range(3000)])
    assert time.time() - start < 20  # one query, where one for each rule would take minutes
    rules = [Rule(f"r{i}", f"other{i}", (), "") for i in range(500)]
    with pytest.raises(ValueError, match="rule broken"):
        RuleSet([*rules, Rule("broken", "a(b", (), ""), Rule("fine", "ab", (), "")])
    assert spark.sparkContext is not None and F is not None

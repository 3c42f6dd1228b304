import dataclasses
import random
import re

from pyspark.sql import functions as F

from keysift.operators.match import (
    count_by_rule, find_matches, locate_matches, match_values, regex_findings)
from keysift.operators.rules import Rule, RuleSet, default_rules
from tests.test_rules import NEGATIVE, POSITIVE

RULES = default_rules()


def found(df):
    return {(r.file_path, r.rule, r.match_no, r.match) for r in match_values(df, RULES).collect()}


def test_anchors_never_hide_a_match(units):
    """Glued fragments, odd cases and folding letters: same matches with and without."""
    rng = random.Random(7)
    pieces = [*POSITIVE.values(), *NEGATIVE.values(), " ", "\n", "-", "_", "://", "x" * 30, "é", " ", "\r"]
    fold = str.maketrans({"s": "ſ", "k": "K", "i": "ı"})
    texts = []
    for _ in range(400):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6)))
        how = rng.randrange(4)
        texts.append(t.upper() if how == 0 else t.lower() if how == 1 else t.translate(fold) if how == 2 else t)
    df = units(*texts)
    bare = RuleSet([dataclasses.replace(r, anchors=(), probe=None) for r in RULES])
    gated, plain = match_values(df, RULES), match_values(df, bare)
    assert gated.exceptAll(plain).count() == 0 and plain.exceptAll(gated).count() == 0
    assert gated.where("rule = 'api_key_generic' and match rlike 'K'").count() > 0


def test_same_matches_as_python(units):
    rng = random.Random(3)
    pieces = [*POSITIVE.values(), *NEGATIVE.values(), " ", "\n", "word "]
    texts = ["".join(rng.choice(pieces) for _ in range(8)) for _ in range(100)]
    want = {(f"f{i}", r.name, n, m.group()) for i, t in enumerate(texts) for r in RULES
            for n, m in enumerate(re.finditer(r.regex, t))}
    assert found(units(*texts)) == want


def test_dialect(units):
    """A dot stops at \\n only, and case folding is Unicode."""
    key = "a" * 40
    got = found(units(f"aws \r{key}", f"aws\n{key}", "paſſword=12345678"))
    assert {(f, r) for f, r, *_ in got} == {("f0", "aws_secret_key"), ("f2", "password")}


def brute_lines(text, regex):
    return [1 + text[:m.start()].count("\n") for m in re.finditer(regex, text) if m.group()]


def test_line_numbers(units):
    rng = random.Random(5)
    pieces = [POSITIVE["npm_token"], POSITIVE["ssh_private_key_id_rsa"], 'password\n=\n"abcdefgh1"', "\n", "\n\n", " ", "\u0001"]
    texts = ["".join(rng.choice(pieces) for _ in range(12)) for _ in range(60)]
    got = {}
    for r in locate_matches(units(*texts), RULES).collect():
        got.setdefault((r.file_path, r.rule), []).append(r.line_number)
    want = {}
    for i, t in enumerate(texts):
        for rule in RULES:
            lines = brute_lines(t, rule.regex)
            if lines:
                want[(f"f{i}", rule.name)] = lines
    assert {k: sorted(v) for k, v in got.items()} == want


def test_line_nos_of_a_hunk(units):
    secret = POSITIVE["npm_token"]
    rows = locate_matches(units((f"a\n{secret} {secret}\n{secret}", [10, 40, 41])), RULES).collect()
    assert sorted(r.line_number for r in rows) == [40, 40, 41]


def test_keyword_on_any_line_of_the_match(units):
    block = POSITIVE["ssh_private_key_id_rsa"]
    rule = RuleSet([Rule("b", RULES[14].regex, ("marker",), "B")])
    texts = [f"MARKER {block}", f"{block} marker", block.replace("ab", "marker"), f"marker\n{block}\nmarker", block]
    rows = {r.file_path: (r.keyword_hit, r.n_lines) for r in locate_matches(units(*texts), rule).collect()}
    assert rows == {"f0": (True, 4), "f1": (True, 4), "f2": (True, 4), "f3": (False, 4), "f4": (False, 4)}


def test_confidence(units):
    """high from 0.80: exact decimals, where doubles would fall short."""
    def level(boost, text):
        rule = RuleSet([Rule("r", "SECRET", ("near",), "R", boost)])
        return regex_findings(units(text), rule).first().confidence
    assert level("0.2", "near SECRET") == "high"
    assert level("0.3", "SECRET") == "high"
    assert level("0.2", "SECRET") == "medium"
    assert level("0.1", "SECRET") == "medium"
    assert level("0.0", "NEAR SECRET") == "medium"
    assert level("0.0", "SECRET") == "low"


def test_odd_rules(units):
    df = units("aaa b", "zzz", None, "")
    empty = RuleSet([Rule("maybe_empty", "a*", (), "E"), Rule("no_regex", None, (), "N")])
    got = {(r.file_path, r.match, r.line_number) for r in locate_matches(df, empty).collect()}
    assert got == {("f0", "aaa", 1)}
    assert [tuple(r) for r in count_by_rule(df, empty).collect()] == [("maybe_empty", 1)]
    assert find_matches(df, RuleSet([])).count() == 0
    twice = RuleSet([Rule("same", "b", (), "1"), Rule("same", "b", (), "2")])
    assert regex_findings(df, twice).count() == 2


def test_many_matches_on_one_line(units):
    rows = locate_matches(units(" ".join([POSITIVE["npm_token"]] * 5000)), RULES)
    assert rows.agg(F.count("*"), F.max("line_number")).first() == (5000, 1)


def test_partitioning_does_not_matter(units):
    df = units(*POSITIVE.values())
    one = regex_findings(df.repartition(1), RULES)
    many = regex_findings(df.repartition(7), RULES)
    assert one.exceptAll(many).count() == 0 and one.count() == many.count()

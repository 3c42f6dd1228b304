"""Work and files that follow the rows, not the number of repositories or rules."""

import os
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalog import inputs
from catalog.clients import line_flagger
from keysift import schemas
from keysift.llm import lm
from keysift.llm.queries import op13_lm
from keysift.operators import inference, rule_tables
from keysift.operators.match import count_by_rule, find_matches, match_values
from keysift.operators.prompts import ModelOptions
from keysift.operators.rule_tables import RuleTable
from keysift.operators.rules import RuleSet, default_rules
from keysift.plans.report import report_document
from keysift.plans.scan import scan_texts
from keysift.sources.history import read_history, source_repository
from keysift.sources.published import publish_documents, read_published
from keysift.streaming.history import NewestCommits


@pytest.fixture
def tables(spark, tmp_path):
    """Small tables of the given schemas: an event of its own repository for each of 300 rows, one without a user."""
    sf = str(tmp_path / "sf")
    rows = spark.range(300)
    events = rows.selectExpr(
        "id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id AS int)) AS ts",
        "CASE WHEN id <> 7 THEN id END AS user_id", "'push' AS event_type", "'p' AS props")
    documents = spark.range(30).selectExpr("id AS doc_id", "'a' || chr(10) || 'b' AS text", "'en' AS lang", "'s' AS source")
    for name, df in {
            "events": events, "documents": documents, "benchmark": spark.range(3).selectExpr("id AS item_id", "'x' AS text"),
            "pages": spark.range(3).selectExpr("id AS page_id", "'u' AS url", "'<p>' AS html")}.items():
        df.coalesce(1).write.parquet(f"{sf}/{name}.parquet")
    return sf


def test_a_dump_has_few_files_for_many_repositories(spark, tables, tmp_path):
    folder = str(tmp_path / "log")
    inputs.history_dump(spark, tables, folder)
    files = [f for _, _, names in os.walk(folder) for f in names if f.endswith(".txt")]
    assert 0 < len(files) < 50  # 300 repositories
    commits, patches = read_history(spark, folder, source_repository())
    columns = ["repository", "commit_hash", "author", "message"]
    assert sorted(map(repr, commits.select(*columns).collect())) == sorted(map(repr, inputs.commits(spark, tables).select(*columns).collect()))
    key = ["repository", "commit_hash", "file_path"]
    want = inputs.patches(spark, tables).where("origin = 'commit'").select(*key)
    assert sorted(map(repr, patches.select(*key).collect())) == sorted(map(repr, want.collect())) and want.count() == 30
    assert commits.where(F.col("repository").isNull()).count() == 1


class State:
    """A value of a state store that counts the calls to it."""

    def __init__(self):
        self.value, self.calls = None, 0

    def __getattr__(self, name):  # any other call of the store, as those of a map's keys
        raise AssertionError(f"a call for each row: {name}")

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None


def test_calls_to_the_state_do_not_grow_with_commits():
    states = []

    class Handle:
        def __getattr__(self, name):
            return lambda *_: states.append(State()) or states[-1]

    commits = [("commit", f"r{k % 50}", f"{k:04x}", "a", f"2024-01-01 00:00:{k % 60:02d}", "m", None, None, None, k % 3) for k in range(600)]
    patches = [("patch", c[1], c[2], None, None, None, "commit", "f", "p", c[-1]) for c in commits]
    columns = [*"kind repository commit_hash author commit_date message origin file_path patch part".split()]
    operator = NewestCommits(2)
    operator.init(Handle())
    out = []
    for rows in (commits[:300] + patches[300:], commits[300:] + patches[:300]):
        for frame in operator.handleInputRows((0,), iter([pd.DataFrame(rows, columns=columns)]), None):
            out += list(frame.itertuples(index=False, name=None))
    assert sum(s.calls for s in states) <= 12
    through = {r[1:3] for r in out if r[0] == "commit"}
    groups = {}
    for c in commits:
        groups.setdefault((c[1], c[-1]), []).append(c)
    patched = [r[1:3] for r in out if r[0] == "patch"]
    # what counts in the end: the newest two of each part, of equal dates the smaller hash, with their patches
    newest = set()
    for g in groups.values():
        newest |= {c[1:3] for c in sorted(sorted(g, key=lambda c: c[2]), key=lambda c: c[4], reverse=True)[:2]}
    assert newest <= through
    assert len(patched) == len(set(patched)) and set(patched) <= through and newest <= set(patched)


def rule_rows(spark, regexes):
    rows = [(3 * i + 5, f"n{i % 7}", r, ["token"], "d", Decimal("0.1")) for i, r in enumerate(regexes)]
    return spark.createDataFrame(rows, schemas.RULES)


def test_a_rule_table_finds_what_a_rule_set_finds(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("skIé01") for _ in range(rng.randrange(3, 14))) for _ in range(150)]
    regexes = [("(?i)" if i % 2 else "") + w + "[0-9]*" for i, w in enumerate(words)]
    regexes += ["(?i)(passwordsk|secretkeys|passwordis)=[a-z]+", "(longliteral1|longliteral2)x?", "[0-9]{6}", "", None, "(?:abcdefgh|q)1"]
    table = rule_rows(spark, regexes)
    odd = {"s": "\u017f", "k": "\u212a", "i": "\u0130", "I": "\u0131"}
    texts = [None, "", "longliteral2x longliteral1 longliteral2", "PASSWORDSK=a secretkeys=b pa\u017fswordi\u017f=c", "q1 abcdefgh1 123456",
             "longlit", "eral1x"]
    for w in words:
        v = "".join(odd.get(c, c) if rng.random() < 0.2 else c.upper() if rng.random() < 0.3 else c for c in w)
        texts += [f"{w}7 {v} {w}", "\n".join(rng.sample(words, 5)), v]
    texts.append("x" * 3000 + words[0] + "é" * 4000 + words[1])
    units = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got, want = (sorted(map(tuple, match_values(units, r).collect())) for r in (RuleTable(table), RuleSet.from_df(table)))
    assert got == want and len(want) > 400
    assert len(RuleTable(table).rest) < 110 < len(regexes)


def test_a_rule_table_has_no_limit_but_for_rules_tried_on_every_text(spark):
    many = rule_rows(spark, [f"literal{k:05d}x[0-9]" for k in range(300)])
    texts = spark.createDataFrame([(1, "literal00123x4 literal00299x5")], "doc_id int, text string")
    assert sorted(r.match for r in match_values(texts, RuleTable(many, most=10)).collect()) == ["literal00123x4", "literal00299x5"]
    with pytest.raises(ValueError, match="at most"):
        RuleTable(rule_rows(spark, ["[0-9]{3}"] * 11), most=10)
    with pytest.raises(ValueError, match="of its own"):
        RuleTable(many.unionAll(many))
    with pytest.raises(ValueError, match="a name"):
        RuleTable(many.withColumn("name", F.lit(None).cast("string")))
    with pytest.raises(ValueError, match="no regex"):
        RuleTable(rule_rows(spark, ["longliteral(", "fine"]))
    with pytest.raises(TypeError):
        RuleTable(many.drop("regex"))


def test_windows_of_texts_longer_than_a_stretch(monkeypatch):
    monkeypatch.setattr(rule_tables, "STRETCH", 16)
    want = rule_tables.filed_under("abcdefgh", False)
    bits = np.zeros(1 << 12, np.uint8)
    for at in (want & 0x7FFF, (want % 2 ** 64 >> 32) & 0x7FFF):
        bits[at >> 3] |= 1 << (at & 7)
    for before in range(40):
        text = "." * before + "abcdefgh" + "." * 9
        assert [list(f) for f in rule_tables.Filed(bits, False, True).of([text, None, "abcd", "efgh", text])] == [[want], [], [], [], [want]]


def test_op13_learns_five_words_and_files_single_ones_as_keys(spark, tables, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(60))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{tables}/documents.parquet")
    made, fit = [], lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a, **k: made.append(fit(*a, **k)) or made[-1])
    assert op13_lm(spark, tables).count() == 60
    (model,) = made
    assert model.order == len(model.files) == 5
    files = [f for f in model.files[4] if f[0]]
    size, grams = sum(os.path.getsize(f[0]) for f in files), sum(f[1] for f in files)
    assert grams > 2000 and size < 20 * grams + 32 * len(files)


def test_answers_with_a_cache_find_their_keys_once(spark, units, monkeypatch):
    """The texts are gone through once for the keys, which are needed twice, and once for the contents that are asked about."""
    rules, model, cut, known = default_rules(), ModelOptions(), [], []
    real, looked_up = inference.cut_lineage, inference.known_answers
    monkeypatch.setattr(inference, "cut_lineage", lambda df: cut.append(df.columns) or real(df))
    monkeypatch.setattr(inference, "known_answers", lambda d, c: known.append(d) or looked_up(d, c))
    chunks = inference.keyed_contents(units(*[f"text {k}" for k in range(40)]), rules, model)
    cache = spark.createDataFrame([(r.cache_key, "[]") for r in chunks.limit(10).collect()], schemas.RESPONSES)
    answers = inference.answers_for(chunks, rules, line_flagger("text 1", "x"), cache, model)
    assert answers.count() == 40 and answers.where("response = '[]'").count() >= 10
    assert cut.count(["cache_key", "copies"]) == 2  # all keys, and the new ones
    assert "content" not in known[0]._jdf.queryExecution().analyzed().toString()


def test_published_files_are_read_without_a_task_for_a_few_of_them(spark, units, tmp_path):
    """Many repositories' small files: Spark neither lists them on the driver nor plans them as splits."""
    found = scan_texts(units("password = 'abcdefgh12'", "AKIA" + "A" * 16), default_rules()).cache()
    many = found.drop("repository").crossJoin(spark.range(40).select(F.concat(F.lit("r/é "), "id").alias("repository"))).select(found.columns)
    path = publish_documents(report_document(many), str(tmp_path / "out"))
    rows = read_published(spark, path)
    columns = ["repository", "commit_hash", "file_path", "line_number", "snippet", "finding_type"]
    assert sorted(map(tuple, rows.select(*columns).collect())) == sorted(map(tuple, many.select(*columns).collect()))
    assert rows.inputFiles() == [] and rows.count() == 80


def test_op13_model_has_each_longest_n_gram_once_and_few_letters(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(300))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        model = lm.fit(docs, folder=str(tmp_path))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    grams = sum(f[1] for f in model.files[4])
    assert grams > 40_000 and sum(f.stat().st_size for f in tmp_path.rglob("*")) < 30 * grams
    assert model.shards == 16 and len(model.files[0]) == 4


def nodes(plan):
    yield plan
    for child in (plan.children().apply(i) for i in range(plan.children().size())):
        yield from nodes(child)


def test_texts_do_not_go_to_a_rule_table_once_for_each_window(spark, monkeypatch):
    table = RuleTable(rule_rows(spark, [f"literal{k:05d}x[0-9]" for k in range(300)] + ["otherone[0-9]", "[0-9]{6}"]))
    texts = spark.createDataFrame([(1, "literal00123x4 otherone5 otherone6"), (2, "123456")], "doc_id int, text string")
    for shared, moved in ((1000, 0), (64, 1)):  # beyond: many rules of one window
        monkeypatch.setattr(rule_tables, "SHARED", shared, raising=False)
        found = find_matches(texts, table)
        joins = [n for n in nodes(found._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join"]
        on_windows = [n for n in joins if "_window" in n.condition().toString()]
        assert len(on_windows) >= 1 + moved
        assert sum("text#" in side.output().mkString(" ") for n in on_windows for side in (n.left(), n.right())) == moved
        got = sorted((r.doc_id, m) for r in found.collect() for m in r.matches)
        assert got == [(1, "literal00123x4"), (1, "otherone5"), (1, "otherone6"), (2, "123456")]


@pytest.mark.parametrize("settings", [{"LEAST_EACH": 1 << 10, "BITS": 1 << 15}, {"SHARED": 0}, {"SHARED": 1}, {
    "SHARED": 1, "LEAST_EACH": 1 << 11, "BITS": 1 << 15}])
def test_a_rule_table_finds_the_same_in_parts_and_among_crowded_windows(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(rule_tables, name, value)
    regexes = [f"(?i)Name{k % 20:04d}{k}=[a-z]+" if k % 3 else f"name{k:05d}=[a-z]+" for k in range(90)]
    regexes += ["(passphrase|name00012|lookup_key)[=a-z]*", "(?i)(passphrase|name0002)[=a-z]*", "passphras", "name[0-9]+"]
    table = rule_rows(spark, regexes)
    texts = [f"name{k:05d}=x NAME{k % 20:04d}{k}=y passphrase=z\nlookup_key" for k in range(90)] + [None, "", "name0001", "passphrase"]
    units = spark.createDataFrame([(i % 40, t) for i, t in enumerate(texts * 2)], "doc_id int, text string")
    units = units.unionAll(units).withColumn("tags", F.create_map(F.lit("a"), F.lit("b"))).repartition(3)  # rows that come twice
    small = RuleTable(table)
    got, want = (sorted(map(tuple, match_values(units.drop("tags"), r).collect())) for r in (small, RuleSet.from_df(table)))
    assert got == want and len(want) > 1000
    assert sorted(map(tuple, count_by_rule(units, small).collect())) == sorted(map(tuple, count_by_rule(units, RuleSet.from_df(table)).collect()))

"""Phrases, whitening and the language model."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from catalog.check import canonical
from keysift.llm import lm, phrases, whitening
from keysift.llm.queries import ORACLE, op11_phrases, op12_whitening, op13_lm
from tests.conftest import SF
from tests.llm import plain


# --- phrases

def plain_phrases(rows, least=30, longest=4, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        scored = []
        for p, a in found.items():
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            over = [n for q, n in found.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * n >= 80 * a for n in over):
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def check_phrases(spark, rows, **options):
    df = spark.createDataFrame([(i, lang, text, "x") for i, (lang, text) in enumerate(rows)],
                               "doc_id long, lang string, text string, `a.phrase` string").repartition(3)
    got = sorted(tuple(r) for r in phrases.mine(df, **options).collect())
    assert got == plain_phrases(rows, **options)
    return got


def phrase_rows(n, words, seed):
    rng = random.Random(seed)
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", " ? "]
    rows = [(rng.choice(["en", "en", "de", None]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(300))))
            for _ in range(n)]
    return rows + [("en", None), ("en", ""), ("fr", " ,.;"), (None, "one TWO three four five. " * 40)] + [rows[0]] * 3


@pytest.mark.parametrize("least", [3, 30])
def test_phrases(spark, least):
    rows = phrase_rows(60, ["the", "The", "of", "a", "é", "Éa", "new", "york", "x" * 50, "c'est", "-"], least)
    assert check_phrases(spark, rows, least=least)
    check_phrases(spark, rows, least=least, longest=2, top=3)


def test_trie_bursts_and_spills(monkeypatch):
    monkeypatch.setattr(phrases, "BURST", 20)
    rng = random.Random(3)
    trie = phrases.Trie()
    first, rest = np.array([rng.randrange(1, 2000) for _ in range(3000)]), np.array([rng.randrange(5) for _ in range(3000)])
    trie.add(first[:1500], rest[:1500])
    some = list(zip(*trie.spill(500)))
    trie.add(first[1500:], rest[1500:])
    assert any(c.entries is None for c in trie.subtrees)
    total = Counter()
    for key, n in some + list(zip(*trie.spill(0))):
        total[key] += n
    assert total == Counter((first << 32 | rest).tolist()) and sum(trie.sizes) == 0


def test_runs_of_any_limits(monkeypatch):
    """Counting by itself, with limits so small that all of them are reached."""
    import pyarrow as pa

    for name, value in (("BURST", 10), ("LIMIT", 100), ("WORDS", 40), ("PART", 200), ("LANGS", 1)):
        monkeypatch.setattr(phrases, name, value)
    monkeypatch.setattr(phrases, "parts", lambda text, gap: plain_parts(text, gap, 200))
    rows = phrase_rows(30, [f"w{i}" for i in range(30)], 8)
    batch = pa.RecordBatch.from_pydict({"lang": [x or "und" for x, _ in rows], "text": [t for _, t in rows]})
    every = type("B", (), {"value": np.full(phrases.BITS // 8, 255, np.uint8)})
    found = Counter()
    for sizes, bits in (((1,), (None, None)), ((2,), (every, None)), ((3, 4), (every, every))):
        sent = list(phrases._runs(sizes, *bits, 8)(iter([batch])))
        for r in (r for out in sent for r in out.to_pylist() if r["size"]):
            words, at, _ = phrases.unpacked(r["words"], r["body"], r["size"])
            assert words == sorted(set(words)) and at.tolist() == sorted(at.tolist())  # a sorted run
        for out in phrases._merged(1)(iter(sent)):
            for r in out.to_pylist():
                found[r["lang"], r["phrase"]] += r["n"]
    want = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            want[lang or "und", ""] += len(w)
            for k in range(1, 5):
                want.update((lang or "und", " ".join(w[i:i + k])) for i in range(len(w) - k + 1))
    assert +found == +want


def plain_parts(text, gap, size):
    from keysift.llm.words import parts

    return parts(text, gap, size)


def test_phrases_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = op11_phrases(spark, SF)
    assert canonical(got.toPandas()) == canonical(con.execute(ORACLE["op11_phrases"]).df())
    assert phrases.mine(spark.read.parquet(f"{SF}/documents.parquet").limit(0)).count() == 0


# --- whitening

def check_whitening(found, rows, components=16):
    usable = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for _, v in usable], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), [int(c) for c in fit.sum(axis=0)]
    centre = (n * fit - np.array(s)) / n
    e, q = np.linalg.eigh(centre.T @ centre / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, len(e), int((e > 1e-12 * e.sum()).sum()))
    got = defaultdict(list)
    for r in found:
        got[r.vec_id].append(r)
    assert len(found) == k * len(usable)
    sign = {}
    for (i, _), row in zip(usable, x):
        mine = sorted((r for r in got[i]), key=lambda r: r.component)
        assert {r.component for r in mine} == set(range(1, k + 1))
        deviation = sum((n * int(a) - b) ** 2 for a, b in zip(row, s))
        white = (n * row - np.array(s)) / n @ q[:, :k] / np.sqrt(e[:k])
        for r in mine:
            j = r.component - 1
            if abs(white[j]) > 1e-6:
                sign.setdefault(j, np.sign(white[j]) * np.sign(r.whitened))
            assert r.n == n and r.deviation == deviation and r.identity_error <= 1e-4
            assert r.whitened == pytest.approx(sign.get(j, 1) * white[j], abs=1e-7)
            assert r.explained == pytest.approx(e[j] / e.sum(), rel=1e-9)


def test_whitening(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(40) * np.linspace(0.3, 2, 40)).tolist()) for i in range(300)]
    bad = [(400, None), (401, [float("nan")] * 40), (402, [None] + [1.0] * 39), (403, [float("inf")] * 40)]
    rows += [(350, rows[0][1]), (351, rows[0][1]), *bad]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + [(404, []), (405, [1.0] * 3), (406, [1e30] * 40)]],
                               "vec_id long, embedding array<double>, component int").repartition(3)
    check_whitening(whitening.whiten(df).collect(), rows)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 7")).count() == 0
    narrow = [(i, v[:3]) for i, v in rows[:50]]
    check_whitening(whitening.whiten(spark.createDataFrame(narrow, "vec_id long, embedding array<float>")).collect(),
                    [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in narrow])
    flat = [(i, [float(i), 2.0 * i, 5.0, -1.0 * i]) for i in range(20)]  # one direction alone varies
    check_whitening(whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect(), flat)


def test_whitening_is_exact_beyond_64_bits():
    n, sums = 3 << 40, [5 << 60, 7]
    x = np.array([[1 << 50, 3], [-5, 1 << 45]], np.int64)
    d = whitening._centred(n, sums)(x)
    want = [[n * int(v) - s for v, s in zip(row, sums)] for row in x.tolist()]
    assert d.tolist() == want and whitening._squares(d) == [None, None]
    assert whitening._squares(np.array([[3, 4], [2**31, 2**31]], np.int64)) == [25, None]


@pytest.mark.parametrize("spread", ["even", "steep", "equal", "low rank"])
def test_leading_components(spread):
    rng = np.random.default_rng(2)
    e = {"even": np.linspace(1, 1.1, 200), "steep": 10.0 ** -np.arange(200), "equal": np.append(np.ones(190), [2.0] * 10),
         "low rank": np.append(np.zeros(195), [1.0, 2.0, 3.0, 4.0, 5.0])}[spread]
    q = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    v = q * e @ q.T
    passes = []
    found, vectors = whitening.leading(lambda x: passes.append(1) or v @ x, 200, 16)
    assert np.allclose(found, np.sort(e)[::-1][:16], atol=1e-12) and len(passes) < 400
    assert np.allclose(v @ vectors, vectors * found, atol=1e-11) and np.allclose(vectors.T @ vectors, np.eye(16), atol=1e-12)


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(op12_whitening(spark, SF).collect(), rows)


# --- language model

def tokens_of(text):
    return [w.lower() for w in plain.words(text)] + ["END"]


def plain_model(texts, order):
    """Probability of a word after its context, by dictionaries."""
    counts = [None] * (order + 1)
    top = Counter()
    for t in texts:
        w = ["BEGIN"] * (order - 1) + tokens_of(t)
        top.update(tuple(w[i - order + 1:i + 1]) for i in range(order - 1, len(w)))
    raw = {order: top}
    for k in range(order - 1, 0, -1):
        raw[k] = Counter()
        for g, n in raw[k + 1].items():
            raw[k][g[1:]] += n
    counts[order] = dict(top)
    for k in range(order - 1, 0, -1):
        before = Counter(g[1:] for g in raw[k + 1])
        counts[k] = {g: raw[k][g] if k > 1 and g[0] == "BEGIN" else before[g] for g in raw[k]}
    discounts = {}
    for k in range(1, order + 1):
        n = [sum(c == i for c in counts[k].values()) for i in range(1, 5)]
        discounts[k] = lm._discounts(n)
    contexts = {}
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            at = contexts.setdefault(g[:-1], [0, 0.0])
            at[0] += c
            at[1] += discounts[k][min(c, 3) - 1]
    vocabulary = len(raw[1])

    def probability(gram):
        p = 1 / (vocabulary + 1)
        for k in range(1, order + 1):
            g = gram[len(gram) - k:]
            if g[:-1] in contexts:
                total, free = contexts[g[:-1]]
                c = counts[k].get(g, 0)
                p = max(c - (discounts[k][min(c, 3) - 1] if c else 0), 0) / total + free / total * p
        return p

    return probability, {g[0]: n for g, n in raw[1].items()}


def check_scores(found, rows, order, trained):
    probability, raw = plain_model([t for i, t in rows if trained(i)], order)
    total, vocabulary = sum(raw.values()), len(raw)
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    for i, text in rows:
        w = ["BEGIN"] * (order - 1) + tokens_of(text)
        grams = [tuple(w[k - order + 1:k + 1]) for k in range(order - 1, len(w))]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(grams), sum(g[-1] in raw for g in grams), total)
        assert r.base_score == pytest.approx(sum(math.log10((raw.get(g[-1], 0) + 1) / (total + vocabulary + 1)) for g in grams))
        assert r.score == pytest.approx(sum(math.log10(probability(g)) for g in grams), rel=1e-9, abs=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    if total:  # the probabilities of all words and the unknown one add up to 1
        for context in [("BEGIN",) * (order - 1), tuple(w[-order + 1:]) if order > 1 else ()]:
            assert sum(probability((*context, x)) for x in raw) + probability((*context, "unknown")) == pytest.approx(1)


def lm_rows(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "é", "new", "york", "x" * 40] + [f"w{i}" for i in range(60)]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(words[min(int(rng.paretovariate(0.5)) - 1, 67)] for _ in range(rng.randrange(120))))
            for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "  \n "), (n + 3, "hot words " * 500), (n + 4, rows[1][1]), (n + 5, "never seen before")]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, order, monkeypatch):
    rows = lm_rows(80, order)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    check_scores(lm.score(docs, lm.fit(docs.where("doc_id % 5 > 0"), order=order)).collect(), rows, order, lambda i: i % 5 > 0)


def test_heavy_contexts(spark, monkeypatch):
    """Nearly every context spread over the shards."""
    monkeypatch.setattr(lm, "SHARE", 1e-6)
    rows = lm_rows(60, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    model = lm.fit(docs, order=3)
    assert model.heavy.sum() > 50
    check_scores(lm.score(docs, model).collect(), rows, 3, lambda i: True)


def test_stretches():
    """Stretches of any length give the n-grams of whole texts."""
    import pyarrow as pa

    texts = [t for _, t in lm_rows(30, 4)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    hashes = lm._Hashes()
    want = [(row, g) for row, t in enumerate(texts) for g in zip(*(lambda w: (w[:-2], w[1:-1], w[2:]))(
        [lm.BEGIN] * 2 + [hashes[x] for x in (t or "").encode().translate(lm.LOWER).split()] + [lm.END]))]
    for stretch, part in ((1, 1), (7, 20), (1000, 300)):
        found = []
        old, lm.STRETCH, parts = lm.STRETCH, stretch, lm.parts
        lm.parts = lambda text, gap: parts(text, gap, part)
        try:
            for _, tokens, own, row, _ in lm._documents(iter([batch]), 3, hashes):
                found += list(zip(row[own].tolist(), map(tuple, lm._grams(tokens, own, 3).tolist())))
        finally:
            lm.STRETCH, lm.parts = old, parts
        assert found == want


def test_letters():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 50, (1000, 3)).astype(np.uint64) * np.uint64(2**58)
    n = rng.integers(1, 2**40, 1000)
    key, words, n, m = lm._summed(words, n, n + 1)
    again, a, b = lm.unpack(lm.pack(words, n, m))
    k2, w2, n2, m2 = lm._summed(again, a, b)
    assert (k2 == key).all() and (w2 == words).all() and (n2 == n).all() and (m2 == m).all()


def test_model_of_nothing(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (None, "x")], "doc_id long, text string")
    rows = lm.score(docs, lm.fit(docs.limit(0))).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in rows) and len(rows) == 3
    assert lm.score(docs.limit(0), lm.fit(docs)).count() == 0


def test_folder_must_be_mounted(spark):
    with pytest.raises(ValueError, match="mounts"):
        lm.fit(spark.createDataFrame([("x",)], "text string"), folder="hdfs://somewhere/x")


def test_lm_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    found = op13_lm(spark, SF).collect()
    check_scores(found, rows, lm.ORDER, lambda i: not held(i))
    assert all(r.held_out == held(r.doc_id) for r in found)
    new = [r for r in found if r.held_out]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)

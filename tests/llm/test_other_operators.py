"""Vectors, archives, toxicity, licences and packing."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from keysift.llm import embedding_dedup, licenses, packing, toxicity, warc
from keysift.llm.common import scratch
from keysift.llm.queries import ORACLE, op2_toxicity, op4_embedding_dedup, op10_packing, QUERIES
from pyspark.sql import functions as F
from tests.conftest import SF
from tests.llm import plain


# --- vectors

def brute_links(rows, least=0.9):
    unit = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float64) / np.max(np.abs(v))
        unit[i] = x / np.sqrt((x * x).sum())
    ids = list(unit)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
            if len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= least]


def check_vectors(found, rows, least_recall=0.99):
    pairs = brute_links(rows)
    want = plain.components([i for i, _ in rows if i is not None], pairs)
    links = Counter(x for p in pairs for x in p)
    got = {r.vec_id: r for r in found if r.vec_id is not None}
    assert sum(r.n_links for r in got.values()) >= least_recall * 2 * len(pairs)
    for i, r in got.items():
        assert r.n_links <= links[i] and r.component_id >= want[i] and r.kept == (r.component_id == i)
    if sum(r.n_links for r in got.values()) == 2 * len(pairs):
        assert {i: r.component_id for i, r in got.items()} == want


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((20, 16))
    rows = [(k, (centre[k % 20] + 0.12 * rng.standard_normal(16)).tolist()) for k in range(600)]
    rows += [(700 + k, rows[0][1]) for k in range(30)] + [(800, [3.0 * x for x in rows[0][1]])]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [float("inf")] + [1.0] * 15),
             (905, [None] + [1.0] * 15), (906, [1.0] * 4), (907, [2.0] * 4), (None, rows[0][1]), (908, [1e-30] * 16), (909, [1e30] * 16)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cell int").repartition(3)
    found = embedding_dedup.classes(df).collect()
    assert len(found) == len(rows)
    check_vectors(found, rows)
    got = {r.vec_id: r for r in found}
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 906)) and got[908].n_links == 1
    assert got[None].component_id is None and got[None].kept
    assert embedding_dedup.classes(df.limit(0)).count() == 0


def test_vectors_of_one_id(spark):
    """An id that stands for different vectors: each links by itself."""
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.01]), (9, [0.0, 0.0, 1.0])]
    found = embedding_dedup.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == [
        (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (9, 0, 9, True)]


def test_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    rows = [(k, (centre + 0.1 * rng.standard_normal(16)).tolist()) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check_vectors(embedding_dedup.classes(df).collect(), rows)


def test_vectors_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_vectors(op4_embedding_dedup(spark, SF).collect(), rows)


def test_recall_is_calibrated():
    """Pairs at the least cosine, compared as the plan for a large table would."""
    lines = embedding_dedup.plan(2_000_000)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((400, 24))
    y -= (y * x).sum(1)[:, None] * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1)[:, None]
    a, s = rng.standard_normal((24, lines.lines)), rng.standard_normal((24, lines.lines, lines.signs))
    same = ((np.tensordot(x, s, 1) > 0) == (np.tensordot(y, s, 1) > 0)).all(axis=2)
    hits = (same & (np.abs(x @ a - y @ a) <= lines.half)).sum(axis=1)
    assert (hits >= embedding_dedup.COUNT).mean() >= 0.97


# --- archives

PAGES = "page_id long, url string, html string, payload string, latest int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES).repartition(3)


def read_back(spark, df, least=0):
    folder = scratch(spark, "warc")
    captures = warc.write(df, folder, least)
    warc.build_index(captures, folder)
    return folder, captures, warc.look_up(spark, folder, captures)


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [(k, f"http://www.site{k % 3}.example.org:80/Path?q={k}#top", f"<p>é {k % 10}\r\n\r\nWARC/1.1</p>") for k in range(200)]
    rows += [(300, None, None), (301, None, ""), (302, "https://user@Host/a b\nc", "x" * 300_000), (None, "http://a", "<p>é 1\r\n\r\nWARC/1.1</p>"),
             (5, rows[5][1], rows[5][2]), (303, rows[0][1], "tail"), (304, "http://same/", "same"), (305, "http://same/", "same")]
    folder, captures, records = read_back(spark, pages(spark, rows))
    found = records.collect()
    assert len(found) == len(rows)
    newest = defaultdict(lambda: -1)
    for i, _, html in rows:
        newest[html or ""] = max(newest[html or ""], -1 if i is None else i)
    html_of = {(i, (h or "")) for i, _, h in rows}
    for r in found:
        if r.record_type == "response":
            text = bytes(r.payload).decode()
            assert (r.page_id, text) in html_of and r.payload_bytes == len(text.encode())
            assert r.page_id is None or newest[text] == r.page_id
            assert r.payload_digest == warc.digest(text.encode())
        else:
            assert r.payload is None and r.page_id is not None
    kinds = Counter(r.record_type for r in found)
    assert kinds["response"] == len({h or "" for _, _, h in rows}) + 1  # the null id
    # one URL: all its captures, and nothing for a URL that is not there
    key = warc.url_key(rows[0][1])
    some = warc.look_up(spark, folder, spark.createDataFrame([(key,), (key,), ("zz,none)/",), (None,)], "url_key string")).collect()
    assert sorted(r.page_id for r in some) == [0, 303]
    # copies below the limit are responses
    assert {r.record_type for r in read_back(spark, pages(spark, rows), 10**6)[2].collect()} == {"response"}


def test_archives_of_no_pages(spark):
    assert read_back(spark, pages(spark, [(1, "u", "h")]).limit(0))[2].count() == 0


def test_url_keys():
    assert warc.url_key("https://www.Blog.Example.com:443/A?b#c") == "com,example,blog)/A?b"
    assert warc.url_key("http://a.org:8080") == "org,a:8080)/" and warc.url_key("a.org/x://y") == "org,a)/x://y"
    assert warc.url_key(None) == "-"


def test_broken_records_are_refused():
    data = warc.record(1, "http://a/", b"payload", None)
    assert warc.parse(data)[2] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(data[:-1])


# --- toxicity

def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(1)
    n = 3000
    first = rng.random(n) < 0.5
    hint = np.where(rng.random(n) < 0.95, first, ~first)
    second = first & (rng.random(n) < 0.97)
    rows = [[0] if h else [1] for h in hint]
    chain = toxicity.train_chain(rows, {"first": first.astype(int), "second": second.astype(int)}, np.arange(n) % 4, [b"yes", b"no"])
    assert len(chain.links[1].weights) == 3 and chain.links[1].weights[2] > 0
    yes, no = chain.score([b"yes", b"no"])[:, 1]
    assert yes > 0.5 > no
    assert min(chain.quality["second"]) > 0.85


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"), ["quality", "toxic"])
    found = toxicity.classify(docs, chain).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    # some toxic documents of low quality have lost their insults to noise
    toxic = [r for r in found if r.toxic and r.quality]
    assert len(found) > 1000 and sum(r.rejected for r in toxic) > 0.8 * len(toxic) > 50
    assert sum(r.rejected for r in found if not r.toxic) <= 0.005 * len(found)
    assert all(r.kept != r.rejected for r in found)


def test_toxicity_hard_rows(spark):
    docs = spark.createDataFrame([(k, t, 1) for k, t in [(1, None), (2, ""), (3, "idiot " * 5), (None, "fine words"), (3, "x")]],
                                 "doc_id long, text string, rejected int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (9, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels, ["quality", "toxic"])  # nothing to learn from
    assert [r.kept for r in toxicity.classify(docs, chain).collect()] == [True] * 5
    chain = toxicity.fit(docs.limit(0), labels, ["quality", "toxic"])
    assert toxicity.classify(docs, chain).where("kept").count() == 5
    assert toxicity.classify(docs.limit(0), chain).count() == 0


def test_toxicity_query(spark):
    """The chain by dense matrices gives the same."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: {"quality": r.quality, "toxic": r.toxic} for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = op2_toxicity(spark, SF)
    assert found.columns == ["doc_id", "p_quality", "p_toxic", "rejected", "kept"] and found.count() == len(texts)
    check_chain(found, texts, labels)


def check_chain(found, texts, labels):
    p, rejected = plain.toxicity_chain(texts, labels, ["quality", "toxic"])
    for r in found.collect():
        assert np.allclose([r.p_quality, r.p_toxic], p[r.doc_id], atol=1e-6) and r.rejected == rejected[r.doc_id]


def test_chain_of_partly_known_labels(spark):
    """Labels that are null, ids that repeat, and no bound but the documents."""
    rng = random.Random(3)
    texts, labels = {}, {}
    for i in range(300):
        bad, toxic = rng.random() < 0.4, rng.random() < 0.3
        words = ["junk"] * bad + ["idiot", "Idiot!"][:rng.randrange(1, 3)] * toxic + rng.choices(["the", "of", "fine", "day", "night"], k=6)
        texts[i] = " ".join(rng.sample(words, len(words)))
        labels[i] = {"quality": rng.choice([int(not bad), int(not bad), None]), "toxic": rng.choice([int(toxic), None])}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(0, texts[0] + " zz")] * 40 + [(None, "idiot")], "doc_id long, text string")
    table = spark.createDataFrame([(i, v["quality"], v["toxic"]) for i, v in labels.items()] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, table, ["quality", "toxic"])
    check_chain(toxicity.classify(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), chain), texts, labels)
    # the sample bounds the documents, not the rows
    assert toxicity.fit(docs.where("doc_id = 0"), table, ["quality", "toxic"], sample=2).words == []


# --- licences

def test_licenses(spark):
    mit = licenses.NOTICES["MIT"][-1]
    rows = [(1, "Released under the MIT License."), (2, "Some words\nRELEASED   under the *MIT* Licence\r\nmore"), (3, mit),
            (4, "Copyright (c) 2020 A. Person\n\n" + mit.replace("MERCHANTABILITY", "merchantibility")), (5, "not released under the MIT License."),
            (6, None), (7, ""), (8, "...\n\n"), (2, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    found = {tuple(r) for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()}
    assert found == {(1, "text", "MIT", 1), (1, "line", "MIT", 1), (2, "line", "MIT", 2), (2, "text", "MIT", 1), (3, "text", "MIT", 1),
                     (4, "text", "MIT", 1), (None, "text", "CC-BY-NC-4.0", 1), (None, "line", "CC-BY-NC-4.0", 1)}
    assert licenses.scan(docs.limit(0), licenses.known_licenses(spark)).count() == 0


# --- packing

def plain_best_fit(pieces, capacity, per_source):
    bins, out = [], []
    for size, source, cluster in pieces:
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size
                and (cluster is None or cluster not in b["clusters"]) and (source is None or b["sources"][source] < per_source)]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "clusters": set(), "sources": Counter(), "n": 0})
        bins[k]["left"] -= size
        bins[k]["clusters"].add(cluster)
        bins[k]["sources"][source] += 1
        bins[k]["n"] += 1
        out.append((k, bins[k]["n"] - 1))
    return out


def test_best_fit_equals_a_plain_search():
    r = random.Random(1)
    for _ in range(60):
        pieces = sorted(((r.randint(1, 50), r.choice(["a", "b", None]), r.choice([None, *range(8)])) for _ in range(120)), key=lambda p: -p[0])
        assert packing.pack_group(pieces, 50, 2) == plain_best_fit(pieces, 50, 2)


def check_bins(found, rows, capacity, per_source):
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        bins[r.bin_id].append(r)
        pieces[r.doc_id].append(r)
    for held in bins.values():
        assert sum(r.size for r in held) <= capacity and sorted(r.place for r in held) == list(range(len(held)))
        assert max(Counter(r.source for r in held if r.source is not None).values(), default=0) <= per_source
        clusters = [rows[r.doc_id][2] for r in held if rows[r.doc_id][2] is not None]
        assert len(clusters) == len(set(clusters))
    for i, (size, _, _) in rows.items():
        ends = sorted((r.begin, r.begin + r.size) for r in pieces[i])
        assert sum(b - a for a, b in ends) == (size or 0)
        assert all(x[1] == y[0] for x, y in zip(ends, ends[1:]))
    return len(bins)


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 100)
    r = random.Random(2)
    rows = {k: (r.choice([0, None, 100, 200, 350, *range(1, 90)]), "hot" if k % 3 == 0 else r.choice(["a", "b", "c", None]),
                r.choice([None, "copy", k])) for k in range(500)}
    rows = {k: (s, src, None if c is None else str(c)) for k, (s, src, c) in rows.items()}
    df = spark.createDataFrame([(k, *v, 1) for k, v in rows.items()], "doc_id long, n int, source string, cluster string, bin_id int")
    found = packing.pack(df, F.col("n"), F.col("source"), F.col("cluster"), 100, 3)
    check_bins(found.collect(), rows, 100, 3)
    assert packing.pack(df.limit(0), F.col("n"), F.col("source"), F.col("cluster")).count() == 0
    twice = df.limit(20).unionAll(df.limit(20)).union(spark.createDataFrame([(None, 5, "a", "b", 1)], df.schema))
    assert packing.pack(twice, F.col("n"), F.col("source"), F.col("cluster"), 100, 3).count() > 0


def test_packing_query(spark):
    rows = {r.doc_id: (len(plain.words(r.text)), r.source, b" ".join(plain.words(r.text)).lower() or None)
            for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = op10_packing(spark, SF).collect()
    n = check_bins(found, rows, packing.CAPACITY, packing.PER_SOURCE)
    assert n <= 1.3 * sum(s for s, _, _ in rows.values()) / packing.CAPACITY + 2


# --- SQL

@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    import duckdb

    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = want.fetchall()
    assert rows and sorted(rows, key=repr) == sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)

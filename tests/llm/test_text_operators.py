"""Operators on texts against plain versions: bytes, passages, near duplicates, quality, tokens."""

import functools
import random

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keysift.llm import bpe, minhash, quality, suffix_dedup, superkmer
from keysift.llm.queries import op1_bpe, op3_suffix_dedup, op6_quality_rules, op7_minhash, op9_superkmer_dedup
from tests.conftest import SF
from tests.llm import plain

DOCS = "doc_id long, text string, kept string, row int"  # the last two clash with names of results
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def coder():
    return bpe.Coder(bpe.read_vocabulary(VOCABULARY))


@functools.cache
def library():
    return Tokenizer.from_file(VOCABULARY)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(3)


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeé漢") for _ in range(r.randint(1, 7))) for _ in range(n))


def edited(text, seed, edits):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def hard_rows():
    """Nulls, empty and short texts, ties, copies, one-letter runs, periods, shared passages and near copies."""
    base, passage = prose(1, 400), prose(2, 70)
    rows = [(None, None), (0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "One TWO"), (5, base), (6, base), (6, base),
            (7, base.upper()), (8, "a" * 1500), (9, "a" * 700 + "b" + "a" * 700), (10, "ab " * 600), (11, "\n".join(["same line here"] * 90)),
            (12, prose(3, 30) + " " + passage + " " + prose(4, 30)), (13, passage), (14, prose(5, 9) + "\n" + passage.replace(" ", "\n")),
            (15, prose(6, 20_000)), (16, "漢" * 900), (17, base[:len(base) // 2]), (18, prose(7, 49)), (19, prose(7, 50)), (None, base),
            (20, prose(8, 4)), (21, prose(8, 5)), (22, "\x1c \x85  x")]
    rows += [(100 + k, edited(base, k, k % 9)) for k in range(60)]
    rows += [(300 + k, prose(1000 + k, 60) + "\nfooter " + passage) for k in range(40)]
    return rows


def got_bytes(df):
    return sorted((r.id is None, r.id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


def test_suffix_dedup_hard_rows(spark):
    rows = hard_rows()
    want = sorted((i is None, i or 0, *x) for (i, _), x in zip(rows, plain.repeated_bytes([t for _, t in rows])))
    assert got_bytes(suffix_dedup.dedup(frame(spark, rows))) == want


def test_suffix_dedup_keeps_other_columns_and_letters(spark):
    rows = [(1, "é" * 300), (2, "x" + "é" * 300), (3, None)]
    found = {r.id: r for r in suffix_dedup.dedup(frame(spark, rows), whole_text=True).collect()}
    assert found[1].kept_text == "" and found[2].kept_text == "x" and found[3].kept_text is None
    assert found[2].row.kept == "x" and found[2].row.row == 1
    assert suffix_dedup.dedup(frame(spark, rows).limit(0)).count() == 0


def test_suffix_dedup_long_text_in_parts(spark, monkeypatch):
    text = prose(50, 30_000) + "z" * 900 + prose(50, 200)
    data = np.frombuffer(text.encode(), np.uint8)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    starts = set()
    for _, at, part, rows in suffix_dedup.parts([batch], 10_000):
        p = suffix_dedup.Parse(part, rows)
        strings, _ = p.strings(np.arange(len(p.low)))
        assert not starts & set((strings + at).tolist())
        starts |= set((strings + at).tolist())
    assert starts == set(range(len(data) - 199))


def test_suffix_dedup_query(spark):
    rows = documents(spark)
    want = {(i, n, m, k, plain.sha(kept)) for (i, _), (n, m, k, kept) in zip(rows, plain.repeated_bytes([t for _, t in rows]))}
    assert {tuple(r) for r in op3_suffix_dedup(spark, SF).collect()} == want


def test_superkmer_hard_rows(spark):
    rows = hard_rows()
    last = 2**63 - 1
    want = sorted((i, *x) for (i, _), x in zip([(last if i is None else i, t) for i, t in rows],
                                               plain.repeated_passages([(last if i is None else i, t) for i, t in rows])))
    found = superkmer.dedup(frame(spark, rows)).collect()
    assert sorted((last if r.id is None else r.id, r.n_words, r.n_removed, r.kept) for r in found) == want
    assert superkmer.dedup(frame(spark, rows).limit(0)).count() == 0


def test_superkmer_query(spark):
    rows = documents(spark)
    want = {(i, n, m, plain.sha(kept)) for (i, _), (n, m, kept) in zip(rows, plain.repeated_passages(rows))}
    assert {tuple(r) for r in op9_superkmer_dedup(spark, SF).collect()} == want


def test_near_duplicates_hard_rows(spark, monkeypatch):
    rows = hard_rows()
    want = plain.near_duplicates([(i, t) for i, t in rows if i is not None])
    found = minhash.classes(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
    assert minhash.classes(frame(spark, rows).limit(0)).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LIST_BLOCK", 8)
    monkeypatch.setattr(minhash, "SET_BLOCK", 7)
    base = prose(9, 150)
    rows = [(k, edited(base, k, k % 7)) for k in range(150)]
    want = plain.near_duplicates(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes(frame(spark, rows)).collect()} == want


def test_near_duplicates_query(spark):
    want = plain.near_duplicates(documents(spark))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op7_minhash(spark, SF).collect()} == want


def test_near_duplicates_of_one_id(spark):
    """An id that stands for different texts: each links by itself."""
    a, b = prose(71, 60), prose(72, 60)
    rows = [(5, a), (5, b), (9, b + " end"), (6, prose(73, 60)), (5, a)]
    found = minhash.classes(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [
        (5, 5, True), (5, 5, True), (5, 5, True), (6, 6, True), (9, 5, False)]


def test_band_verdicts(spark):
    """Every byte is judged, whatever the length: the verdict against a plain one."""
    r = random.Random(6)
    noise = lambda n: "".join(chr(r.randrange(33, 127)) + (" " if k % 9 == 0 else "") for k in range(n))[:n]
    same = lambda n: ("the same words again " * (n // 20 + 1))[:n]
    plain_letters = lambda t: t.encode("ascii", "ignore").decode()
    texts = [plain_letters(prose(80 + k, n))[:b] for k, (n, b) in enumerate([(12, 60), (30, 120), (50, 250), (200, 1000), (900, 4607), (900, 4608), (3000, 12000)])]
    texts += [texts[-1][:8192] + noise(4090), texts[-1][:4096] + noise(4091), noise(300) + texts[-1][:9000], texts[-1][:4096] + same(4096),
              noise(100), noise(63), noise(64), same(70), same(5000), "é" * 3000]
    judge = quality.Bands()
    compressor = zstandard.ZstdCompressor(level=3)
    got = [not judge.verdict(t.encode(), compressor)[2] for t in texts]
    assert got == [plain.band_verdict(t) for t in texts]
    # prose of all lengths is kept, a third or half of noise or repeats is not; a little noise, or some bytes of it, say nothing
    assert got[:7] == [True] * 7 and got[7:11] == [False, False, True, False] and not got[15]
    # half of it noise is noticed, with or without a second full chunk
    assert [x.kept for x in quality.judge(frame(spark, [(1, texts[7]), (2, texts[8])])).collect()] == [False, False]


def test_quality_query(spark):
    found = {r.doc_id: r.kept for r in op6_quality_rules(spark, SF).collect()}
    assert found == {i: plain.quality_keeps(t) for i, t in documents(spark)} and 0 < sum(found.values()) < len(found)


def test_columns_of_any_name(spark):
    """Names with dots, of types, of what operators add, and maps: they come through as they are."""
    rows = [(1, prose(90, 120), "x", 1, {"a": 1}), (2, prose(90, 120), "y", 2, {}), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `meta.lang` string, `row` int, `a map` map<string,int>")
    for found, kept in ((suffix_dedup.dedup(docs), "n_removed"), (superkmer.dedup(docs), "n_removed")):
        got = {r["row"]["doc_id"]: r for r in found.collect()}
        assert got[1]["row"]["meta.lang"] == "x" and got[2]["row"]["row"] == 2 and got[1]["row"]["a map"] == {"a": 1}
        assert got[2][kept] > 0 and got[3][kept] == 0
    assert len(minhash.classes(docs).collect()) == len(quality.judge(docs).collect()) == 3


def test_quality_counts(spark):
    rows = hard_rows() + [(500, "x #*$%&|<> y\nx\nx\n\n\nx "), (501, "word " * 30), (502, prose(60, 25))]
    found = quality.judge(frame(spark, rows)).collect()
    want = sorted((i is None, i or 0, *plain.quality_counts(t)) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                   r.base_failed) for r in found) == want
    assert all(not r.kept for r in found if r.base_failed)


@given(st.lists(st.sampled_from(["a", "b", "c", " ", "\n", "é", "#", "a b c d e f g h"]), max_size=60).map("".join))
@settings(max_examples=150, deadline=None)
def test_quality_counts_of_any_text(text):
    got = quality.judge_text(text.encode(), quality.Bands(), zstandard.ZstdCompressor(level=3))
    assert got[:6] == plain.quality_counts(text)


def test_quality_bands(spark):
    r = random.Random(5)
    noise = "".join(chr(r.randrange(33, 127)) + (" " if k % 9 == 0 else "") for k in range(9000))
    rows = [(1, noise), (2, prose(70, 1500)), (3, " ".join(str(k) + " lorem ipsum" for k in range(900)))]
    found = {x.doc_id: x for x in quality.judge(frame(spark, rows)).collect()}
    assert found[1].reason == "incompressible" and found[2].kept and found[3].reason == "repetitive"
    # every document that people labelled good and that passes the base rules is kept
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = op6_quality_rules(spark, SF).join(labels, "doc_id").where("quality = 1 and not base_failed")
    assert good.count() > 20 and good.where("not kept").count() == 0


def test_tokens_equal_the_library(spark):
    reference = library()
    r = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "the", "é", "漢", "½", "　", "\x1c", "\x85", "'s", "'ll", "<|endoftext|>", "😀", "!!!", "aaaa", "12"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(400)]
    texts += ["a" * 700, " " * 300, "ab" * 500, "", None, "ab " * 500] + [t for _, t in hard_rows()]
    rows = {(k, t) for k, t in enumerate(texts)}
    found = {x.doc_id: x for x in bpe.encode(frame(spark, rows), VOCABULARY).collect()}
    for k, t in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert found[k].token_ids == ids and found[k].n_tokens == len(ids)
        assert found[k].ids_sha256 == plain.sha(np.array(ids, "<u4").tobytes())
        assert found[k].decoded_sha256 == plain.sha(reference.decode(ids, skip_special_tokens=False)) == plain.sha(t or "")
    assert bpe.encode(frame(spark, rows).limit(0), VOCABULARY).count() == 0


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_tokens_of_any_text(text):
    machine = coder()
    assert machine.encode([text])[0].tolist() == library().encode(text, add_special_tokens=False).ids


def test_long_words_take_the_same_path():
    machine = coder()
    for seed in range(30):
        word = prose(seed, 6).replace(" ", "").encode()
        assert machine.auto.path(word).tolist() == machine.auto.paths([word])[0].tolist()


def test_merges_must_follow_from_each_other():
    with pytest.raises(ValueError):
        bpe.compile_merges([(b"ab", b"c")], {}, {})


def test_tokens_query(spark):
    reference = library()
    for (i, t), r in zip(sorted(documents(spark)), sorted(op1_bpe(spark, SF).collect())):
        ids = reference.encode(t, add_special_tokens=False).ids
        assert tuple(r) == (i, len(ids), plain.sha(np.array(ids, "<u4").tobytes()), plain.sha(t))

"""Near duplicates at the similarity asked for: the operator at 80 %, and the pipeline's stage."""

from math import comb

import corpus_pipeline
from keysift.llm import minhash
from keysift.llm.common import table
from tests.conftest import SF
from tests.llm import plain
from tests.llm.test_text_operators import documents, edited, frame, prose


def test_collisions_follow_the_similarity():
    for percent in range(50, 101):
        m, s = minhash.least_matches(percent), percent / 100
        below = [comb(minhash.COORDINATES, k) * s ** k * (1 - s) ** (minhash.COORDINATES - k) for k in range(m + 1)]
        assert sum(below[:m]) <= minhash.MISSED and (sum(below) > minhash.MISSED or m == minhash.COORDINATES)
    assert minhash.least_matches(85) == 18 and minhash.least_matches(80) == 15


def test_pairs_at_80_percent(spark):
    rows = []
    for k in range(0, 120, 2):
        base = prose(500 + k, 200)
        rows += [(k, base), (k + 1, edited(base, k, 4))]
    sets = {i: plain.shingle_set(t) for i, t in rows}
    near = [len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) for k in range(0, 120, 2)]
    assert sum(0.8 <= s < 0.85 for s in near) >= 10
    want = plain.near_duplicates(rows, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes(frame(spark, rows), percent=80).collect()} == want


def test_stage_at_80_percent(spark):
    docs = table(spark, SF, "documents")
    rows = documents(spark)
    want = {i for i, (_, c) in plain.near_duplicates(rows, 80).items() if c == i}
    assert want < {i for i, (_, c) in plain.near_duplicates(rows, 85).items() if c == i}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).select("doc_id").collect()} == want

"""Super-k-mers of a phrase that many documents share amid different words."""

import numpy as np

from keysift.llm import superkmer
from tests.llm import plain
from tests.llm.test_text_operators import frame, hard_rows, prose


def test_heavy_minimisers_are_told():
    m = np.array([1 << 40, 2 << 40, 3 << 40], np.uint64)
    e = np.array([m[0] | np.uint64(10 << 1 | 1), m[0] | np.uint64(1), m[1] | np.uint64(3 << 1 | 1), m[2]], np.uint64)
    found, chunk = superkmer.sort_minimisers(e, np.array([0, 1, 0, 1]), 1024)
    assert found.tolist() == [m[0] | np.uint64(1), m[0] | np.uint64(1), m[1]] and chunk.tolist() == [0, 1, 0]


def test_windows_of_heavy_minimisers(spark, monkeypatch):
    phrase, passage = prose(90, 30), prose(91, 70)
    rows = hard_rows() + [(1000 + k, prose(2000 + k, 45) + " " + phrase + " " + prose(3000 + k, 45)) for k in range(60)]
    rows += [(2000 + k, prose(4000 + k % 7, 60) + " " + phrase + " " + passage) for k in range(30)]
    last = 2**63 - 1
    rows = [(last if i is None else i, t) for i, t in rows]
    want = sorted((i, *x) for (i, _), x in zip(rows, plain.repeated_passages(rows)))
    for most in (0, 8, superkmer.HEAVY):
        monkeypatch.setattr(superkmer, "HEAVY", most)
        found = superkmer.dedup(frame(spark, rows)).collect()
        assert sorted((r.id, r.n_words, r.n_removed, r.kept) for r in found) == want, most

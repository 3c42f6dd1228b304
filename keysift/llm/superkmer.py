"""Repeated passages of words, by super-k-mers.

A window is WINDOW consecutive words of a document; its minimiser is the least hash among
its runs of GRAM words. Windows that follow each other mostly share it, and travel as one
string of words, a super-k-mer, to the bucket of their minimiser, where all windows with that
minimiser meet. There they are sorted and counted, and each gets the smallest id that has it.

Minimisers that one document alone has are found first, by their hashes, and their
super-k-mers stay where they are. Of minimisers that more than HEAVY different super-k-mers have, each
window goes on by its own fingerprint, once a chunk, so that no bucket grows with a common passage.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keysift.llm import chunks
from keysift.llm.chunks import LETTERS, letters, records_of
from keysift.llm.common import BUFFER, MULTIPLIERS, Rolling, bytes_of, mix, of_runs, partitions, slices, words_of

WINDOW = 50
GRAM = 8
WIDTH = WINDOW - GRAM + 1  # runs of GRAM words in a window

#: Different super-k-mers of one minimiser that may meet in its bucket, counted up to twice too many.
HEAVY = 1024
#: A minimiser's hash. Its lowest bit tells that several documents of the chunk have it (in the answer: that it
#: is heavy), the next five the logarithm of its different super-k-mers there.
KEY = ~np.uint64(63)
SEEN = np.dtype("<u8")
#: A super-k-mer by fingerprint, the windows of it from one on for a number, and the
#: smallest id that has them.
FIRST = np.dtype([("x", "<u8"), ("y", "<u4"), ("at", "<u2"), ("count", "<u2"), ("doc", "<i8")])
#: A window of a heavy minimiser by fingerprint, and the least and largest id that have it.
MET = np.dtype([("x", "<u8"), ("y", "<u4"), ("low", "<i8"), ("high", "<i8")])
ALONE = 0xFFFF  # in place of ``at``: the fingerprint is the window's own
LAST_ID = np.iinfo(np.int64).max
_BITS = np.uint64(32)  # of a place among the words laid out together


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype)])
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1:width - 1 + n])


class Cuts:
    """The super-k-mers of some texts, laid one after the other in ``data``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.begin, self.end, self.rows = words_of(data, starts)
        n = len(self.begin)
        self.hashes = [Rolling(data, i).of(self.begin, self.end) for i in (0, 1)]
        sizes = np.diff(self.rows)
        ends = np.repeat(self.rows[1:], sizes)  # for each word, where its text's words end
        windows = np.flatnonzero(np.arange(n) + WINDOW <= ends)
        self.windows = windows
        self.first = self.last = np.zeros(0, np.int64)
        self.minimiser = np.zeros(0, np.uint64)
        if not len(windows):
            return
        gram = np.zeros(n - GRAM + 1, np.uint64)
        for i in range(GRAM):
            gram += self.hashes[0][i:n - GRAM + 1 + i] * MULTIPLIERS[16 + i]
        gram = mix(gram)
        # the leftmost of equal hashes, as their place is in the lowest bits
        place = (gram >> _BITS << _BITS) | np.arange(len(gram), dtype=np.uint64)
        at = (least(place, WIDTH)[windows] & ((np.uint64(1) << _BITS) - np.uint64(1))).astype(np.int64)
        new = np.ones(len(windows), bool)
        new[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
        of = np.flatnonzero(new)
        #: The first and the last window of each super-k-mer, and its minimiser.
        self.first = windows[of]
        self.last = windows[np.append(of[1:], len(windows)) - 1]
        self.minimiser = gram[at[of]] & KEY

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        return self.prints_of(self.first, self.last + WINDOW)

    def each(self) -> tuple[np.ndarray, np.ndarray]:
        return self.prints_of(self.windows, self.windows + WINDOW)

    def prints_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (of_runs(self.hashes[0], 0)(a, b),
                (of_runs(self.hashes[1], 1)(a, b) >> np.uint64(32)).astype(np.uint32))


def laid_out(batches):
    """Runs of rows with their bytes."""
    for batch in slices(batches, "text", BUFFER):
        yield batch, *bytes_of(batch.column("text"))


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("id").fill_null(LAST_ID).to_numpy(zero_copy_only=False)


def _minimisers(n: int):
    def work(batches):
        held: dict[int, list[np.ndarray]] = {}
        strings: dict[int, list[np.ndarray]] = {}
        for batch, data, starts in laid_out(batches):
            cuts = Cuts(data, starts)
            x = cuts.prints()[0]
            row = np.searchsorted(cuts.rows, cuts.first, "right") - 1
            chunk, doc = np.asarray(batch.column("chunk"))[row], ids_of(batch)[row]
            for c in np.unique(chunk).tolist():
                e = np.empty((chunk == c).sum(), [("m", "<u8"), ("doc", "<i8")])
                e["m"], e["doc"] = cuts.minimiser[chunk == c], doc[chunk == c]
                held.setdefault(c, []).append(np.unique(e))
                _, one = np.unique(x[chunk == c], return_index=True)
                strings.setdefault(c, []).append(np.stack([x[chunk == c][one], e["m"][one]]))
        for c, found in held.items():
            e = np.unique(np.concatenate(found))
            m, times = np.unique(e["m"], return_counts=True)
            x, of = np.concatenate(strings.pop(c), axis=1)
            count = np.bincount(np.searchsorted(m, of[np.unique(x, return_index=True)[1]]), minlength=len(m))
            size = np.ceil(np.log2(np.maximum(count, 1))).astype(np.uint64)
            yield letters(((m >> _BITS) % np.uint64(n)).astype(np.int64),
                          m | (times > 1).astype(np.uint64) | (size << np.uint64(1)), c, 1, n)

    return work


def sort_minimisers(e: np.ndarray, chunk: np.ndarray, most: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """Those that several documents have, and whether more than ``most`` super-k-mers do."""
    m = e & KEY
    found, of, times = np.unique(m, return_inverse=True, return_counts=True)
    many = times > 1
    np.logical_or.at(many, of, (e & np.uint64(1)) > 0)
    heavy = np.bincount(of, 2.0 ** ((e >> np.uint64(1)) & np.uint64(31)), len(found)) > most
    use = many[of]
    return m[use] | heavy[of][use].astype(np.uint64), chunk[use]


def merged(w: np.ndarray) -> np.ndarray:
    """Each window of MET records once."""
    w = w[np.lexsort((w["y"], w["x"]))]
    new = np.ones(len(w), bool)
    new[1:] = (w["x"][1:] != w["x"][:-1]) | (w["y"][1:] != w["y"][:-1])
    at = np.flatnonzero(new)
    out = w[at]
    if len(at):
        out["low"], out["high"] = np.minimum.reduceat(w["low"], at), np.maximum.reduceat(w["high"], at)
    return out


def _packed(n: int):
    def work(docs: pa.Table, replies: pa.Table) -> pa.Table:
        strings: dict[bytes, list] = {}
        met = [np.zeros(0, MET)]
        if replies.num_rows and docs.num_rows:
            shared = np.unique(records_of(replies.column("blob"), SEEN))
            heavy = (shared & np.uint64(1)) > 0
            shared &= KEY
            for batch, data, starts in laid_out(docs.combine_chunks().to_batches()):
                cuts = Cuts(data, starts)
                at = np.minimum(np.searchsorted(shared, cuts.minimiser), len(shared) - 1)
                use = np.flatnonzero(shared[at] == cuts.minimiser)
                hot, use = use[heavy[at[use]]], use[~heavy[at[use]]]
                if len(hot):
                    sizes = cuts.last[hot] - cuts.first[hot] + 1
                    a = np.repeat(cuts.first[hot] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                    w = np.empty(len(a), MET)
                    w["x"], w["y"] = cuts.prints_of(a, a + WINDOW)
                    w["low"] = w["high"] = ids_of(batch)[np.searchsorted(cuts.rows, a, "right") - 1]
                    met.append(merged(w))
                ids = ids_of(batch)[np.searchsorted(cuts.rows, cuts.first[use], "right") - 1].tolist()
                begin, end = cuts.begin[cuts.first[use]].tolist(), cuts.end[cuts.last[use] + WINDOW - 1].tolist()
                flat = data.tobytes()
                for a, b, m, doc in zip(begin, end, cuts.minimiser[use].tolist(), ids):
                    words = b" ".join(flat[a:b].split())
                    found = strings.get(words)
                    if found is None:
                        strings[words] = [m, doc, doc]
                    else:
                        found[1], found[2] = min(found[1], doc), max(found[2], doc)
        sent: dict[int, tuple[list, list]] = {}
        for words, (m, low, high) in strings.items():
            head, body = sent.setdefault((m >> 32) % n, ([], []))
            head.append((len(words), low, high))
            body.append(words)
        chunk = docs.column("chunk")[0].as_py() if docs.num_rows else 0
        blobs = [np.array([len(h)], "<i8").tobytes() + np.array(h, "<i8").tobytes() + b"".join(b) for h, b in sent.values()]
        packed = pa.table([pa.array(list(sent), pa.int32()), pa.array([chunk] * len(sent), pa.int32()),
                           pa.array([2] * len(sent), pa.int32()), pa.array(blobs, pa.binary())],
                          ["bucket", "chunk", "round", "blob"])
        w = merged(np.concatenate(met))
        return pa.concat_tables([packed, pa.Table.from_batches([letters((w["x"] % np.uint64(n)).astype(np.int64), w, chunk, 3, n)])])

    return work


def _counted(batches):
    """Unpacks a bucket's super-k-mers, sorts all their windows and answers each chunk; so it does with
    windows that came alone."""
    heads, bodies, chunk = [], [], []
    met, to = [], []
    for batch in batches:
        for c, turn, blob in zip(*(batch.column(k).to_pylist() for k in ("chunk", "round", "blob"))):
            if turn == 3:
                met.append(np.frombuffer(blob, MET))
                to.append(np.full(len(met[-1]), c, np.int32))
                continue
            n = int(np.frombuffer(blob, "<i8", 1)[0])
            heads.append(np.frombuffer(blob, "<i8", 3 * n, 8).reshape(n, 3))
            bodies.append(blob[8 + 24 * n:])
            chunk.append(np.full(n, c, np.int32))
    if met:
        w, to = np.concatenate(met), np.concatenate(to)
        order = np.lexsort((w["y"], w["x"]))
        w, to = w[order], to[order]
        new = np.ones(len(w), bool)
        new[1:] = (w["x"][1:] != w["x"][:-1]) | (w["y"][1:] != w["y"][:-1])
        low = np.minimum.reduceat(w["low"], np.flatnonzero(new))[np.cumsum(new) - 1]
        use = low < w["high"]
        out = np.empty(int(use.sum()), FIRST)
        out["x"], out["y"], out["at"], out["count"], out["doc"] = w["x"][use], w["y"][use], ALONE, 1, low[use]
        yield from chunks.answers(to[use], out, 2)
    if not heads:
        return
    head, chunk = np.concatenate(heads), np.concatenate(chunk)
    data = np.frombuffer(b"".join(bodies), np.uint8)
    starts = np.concatenate([[0], np.cumsum(head[:, 0])])
    prints, owners, places, whole = [], [], [], []
    i = 0
    while i < len(head):  # some strings at a time
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BUFFER)))
        j = min(j, len(head))
        part = data[starts[i]:starts[j]]
        begin, end, rows = words_of(part, starts[i:j + 1] - starts[i])
        hashes = [of_runs(Rolling(part, k).of(begin, end), k) for k in (0, 1)]
        sizes = np.diff(rows) - WINDOW + 1
        owner = np.repeat(np.arange(j - i), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        a = rows[owner] + place
        w = np.empty(len(a), [("x", "<u8"), ("y", "<u4")])
        w["x"], w["y"] = hashes[0](a, a + WINDOW), (hashes[1](a, a + WINDOW) >> np.uint64(32)).astype(np.uint32)
        prints.append(w)
        owners.append(owner + i)
        places.append(place)
        whole.append(np.stack([hashes[0](rows[:-1], rows[1:]), hashes[1](rows[:-1], rows[1:]) >> np.uint64(32)]))
        i = j
    w, owner, place = np.concatenate(prints), np.concatenate(owners), np.concatenate(places)
    whole = np.concatenate(whole, axis=1)
    order = np.lexsort((w["y"], w["x"]))
    new = np.ones(len(w), bool)
    new[1:] = w[order][1:] != w[order][:-1]
    at = np.flatnonzero(new)
    low = np.minimum.reduceat(head[owner[order], 1], at)
    high = np.maximum.reduceat(head[owner[order], 2], at)
    of = np.empty(len(w), np.int64)
    of[order] = np.cumsum(new) - 1
    low, several = low[of], (low < high)[of]
    # windows in a row of one super-k-mer with one smallest id make one answer
    starts_run = several.copy()
    starts_run[1:] &= ~several[:-1] | (owner[1:] != owner[:-1]) | (low[1:] != low[:-1])
    run = np.cumsum(starts_run) - 1
    at = np.flatnonzero(starts_run)
    out = np.empty(len(at), FIRST)
    out["x"], out["y"] = whole[0][owner[at]], whole[1][owner[at]].astype(np.uint32)
    out["at"], out["doc"] = place[at], low[at]
    out["count"] = np.bincount(run[several], minlength=len(at)) if len(at) else 0
    yield from chunks.answers(chunk[owner[at]], out, 2)


def _covered(cover: np.ndarray, known: np.ndarray, first: np.ndarray, prints: tuple, ids: np.ndarray) -> None:
    """Adds to ``cover`` what the answers on the runs of words at ``first`` say, for the document of each."""
    x, y = prints
    a, b = np.searchsorted(known["x"], x), np.searchsorted(known["x"], x, "right")
    owner = np.repeat(np.arange(len(x)), b - a)
    hit = known[np.arange(len(owner)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[owner]]
    use = (hit["y"] == y[owner]) & (hit["doc"] < ids[owner])
    begin = first[owner[use]] + hit["at"][use]
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + hit["count"][use] + WINDOW - 1, -1)


def _cut(docs: pa.Table, replies: pa.Table) -> pa.Table:
    known = records_of(replies.column("blob"), FIRST) if replies.num_rows else np.zeros(0, FIRST)
    known = known[np.argsort(known["x"], kind="stable")]
    alone, strings = known[known["at"] == ALONE], known[known["at"] != ALONE]
    alone["at"] = 0
    out = []
    for batch, data, starts in laid_out(docs.combine_chunks().to_batches()):
        cuts = Cuts(data, starts)
        cover = np.zeros(len(cuts.begin) + 1, np.int32)
        for known, first, prints in ((strings, cuts.first, cuts.prints), (alone, cuts.windows, cuts.each)):
            if len(known) and len(first):
                _covered(cover, known, first, prints(), ids_of(batch)[np.searchsorted(cuts.rows, first, "right") - 1])
        gone = np.cumsum(cover[:-1]) > 0
        removed = np.concatenate([[0], np.cumsum(gone)])
        flat = data.tobytes()
        for i in range(batch.num_rows):
            a, b = int(cuts.rows[i]), int(cuts.rows[i + 1])
            words = flat[starts[i]:starts[i + 1]].split()
            cut = int(removed[b] - removed[a])
            if cut:
                words = [w for w, g in zip(words, gone[a:b].tolist()) if not g]
            out.append((b - a, cut, b" ".join(words).decode()))
    columns = list(zip(*out)) or [[]] * 3
    return pa.table([docs.column("id"), docs.column("row"),
                     *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string())))],
                    ["id", "row", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each word covered by a window that also starts in a document of smaller id.

    Columns: ``id``, ``row`` (a struct of the other columns of ``docs``, the id included, which may
    have any names), ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by one space). One row per row.
    Rows of equal id count as one document and do not remove each other's words. A null id counts as
    the largest; a null text has no words; texts with fewer than WINDOW words stay whole; an empty table
    gives an empty one. Ids must be integers.

    The text is shuffled once, 8 bytes per super-k-mer once, and super-k-mers whose
    minimiser several documents have once more, each at most once a chunk. In a bucket at most HEAVY different
    ones of a minimiser meet; of a heavier one each window (28 bytes) is sent once a chunk to a bucket of its own
    fingerprint, so a bucket gets at most as many rows of one window as there are chunks.
    """
    n = partitions(docs.sparkSession)
    dealt = chunks.deal(docs, id_col, text_col, n)
    shared = chunks.resolve(dealt.mapInArrow(_minimisers(n), LETTERS), 1, SEEN, functools.partial(sort_minimisers, most=HEAVY))
    packed = chunks.reply(dealt, shared, _packed(n), LETTERS)
    counted = packed.repartition(n, "bucket").mapInArrow(_counted, LETTERS)
    return chunks.reply(dealt, counted, _cut, chunks.answered(dealt, "n_words long, n_removed long, kept string"))

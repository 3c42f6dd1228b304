"""Repeated strings by prefix-free parsing.

A rolling hash of GRAM bytes triggers at about one place in EVERY; the triggers cut a text into
phrases. Equal strings hold equal triggers, so a string of SPAN bytes that occurs twice starts
in the same place before the same trigger both times, and the strings of a phrase (those whose
first trigger ends it) can be looked at together:

1. The parse. Each phrase in its context (all its strings together) is one entry of the
   dictionary, filed under the CORE bytes beside its trigger that all its strings share.
   Buckets sort the entries by core, then by context. Equal contexts are neighbours: all
   their strings repeat, and a highly repetitive text is done here, one entry per context.
   A core that two different contexts share asks for a closer look; others repeat nowhere.
2. The dictionary. Of those contexts, each once, the suffixes cut to SPAN bytes are sorted;
   a suffix that meets an equal one repeats.

Entries are sorted by fingerprint (94 bits) in place of letters, as only equality up to
SPAN bytes counts: neighbours in this order agree in SPAN bytes or not at all. Strings
without a trigger are entries by themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keysift.llm import chunks
from keysift.llm.chunks import LETTERS, letters, records_of
from keysift.llm.common import BUFFER, MULTIPLIERS, Rolling, bytes_of, mix, partitions, slices

SPAN = 200
GRAM = 12
EVERY = 32
CORE = 100

ENTRY = np.dtype([("x", "<u8"), ("y", "<u4"), ("core", "<u8")])  # a context; the low bits of y are flags
PRINT = np.dtype([("x", "<u8"), ("y", "<u4")])
FLAGS = np.uint32(3)
MANY = REPEATED = np.uint32(1)  # the chunk has it twice; all its strings repeat
ASKED = np.uint32(2)  # its strings are to be sorted


class Parse:
    """The phrases of some texts, laid one after the other in ``data``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.hash = Rolling(data, 0), Rolling(data, 1)
        n = len(data)
        t = np.arange(max(0, n - GRAM + 1))
        t = t[(mix(self.hash[0].raw(t, t + GRAM)) % np.uint64(EVERY)) == 0]
        row = np.searchsorted(starts, t, "right") - 1
        t, row = (whole := t[t + GRAM <= starts[row + 1]]), row[t + GRAM <= starts[row + 1]]
        first = np.maximum(np.concatenate([[0], whole[:-1] + 1]) if len(t) else t, starts[row])
        low = np.maximum(first, t - (SPAN - GRAM))
        high = np.minimum(t, starts[row + 1] - SPAN)
        used = low <= high
        t, low, high = t[used], low[used], high[used]
        near, far = np.maximum(low, t - CORE), np.minimum(high, t - CORE - 1)
        a, b = near <= high, low <= far
        # strings that hold no trigger at all
        starts_here = np.zeros(n + 1, np.int32)
        long = np.flatnonzero(np.diff(starts) >= SPAN)
        np.add.at(starts_here, starts[:-1][long], 1)
        np.add.at(starts_here, starts[1:][long] - SPAN + 1, -1)
        np.add.at(starts_here, low, -1)
        np.add.at(starts_here, high + 1, 1)
        alone = np.flatnonzero(np.cumsum(starts_here[:-1]) > 0)
        #: The first strings of the entries, and the last.
        self.low = np.concatenate([near[a], low[b], alone])
        self.high = np.concatenate([high[a], far[b], alone])
        begin = np.concatenate([t[a], t[b] - CORE - 1, alone])
        end = np.concatenate([t[a] + CORE, t[b] + GRAM, alone + SPAN])
        tag = np.repeat(MULTIPLIERS[:3], [a.sum(), b.sum(), len(alone)])
        self.core = mix(self.hash[0].raw(begin, end) + tag)
        self.context = self.prints(self.low, self.high + SPAN)

    def prints(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(begin), PRINT)
        out["x"] = self.hash[0].of(begin, end)
        out["y"] = (self.hash[1].of(begin, end) >> np.uint64(32)).astype(np.uint32) & ~FLAGS
        return out

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings of some entries start, and the entry of each."""
        sizes = self.high[which] - self.low[which] + 1
        owner = np.repeat(np.arange(len(which)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.low[which][owner]
        return at, which[owner]


def parts(batches, limit: int = BUFFER):
    """The texts in runs: (batch of rows, place in the text, data, starts). A text longer than
    a run comes in parts that overlap, each with its own strings."""
    for batch in slices(batches, "text", limit):
        data, starts = bytes_of(batch.column("text"))
        if batch.num_rows > 1 or len(data) <= 2 * limit:
            yield batch, 0, data, starts
            continue
        for at in range(0, len(data) - SPAN + 1, limit):
            part = data[at:at + limit + SPAN - 1]
            yield batch, at, part, np.array([0, len(part)])


def distinct(entries: np.ndarray) -> np.ndarray:
    """Each entry once, marked MANY if it was there more than once or was marked."""
    if not len(entries):
        return entries
    y = entries["y"] & ~FLAGS
    order = np.lexsort((y, entries["x"]))
    e, y = entries[order], y[order]
    new = np.ones(len(e), bool)
    new[1:] = (e["x"][1:] != e["x"][:-1]) | (y[1:] != y[:-1])
    at = np.flatnonzero(new)
    many = (np.diff(np.append(at, len(e))) > 1) | np.logical_or.reduceat(e["y"] & MANY > 0, at)
    out = e[at]
    out["y"] = y[at] | many * MANY
    return out


class Known:
    """Answers, by fingerprint."""

    def __init__(self, found: np.ndarray):
        self.found = found[np.argsort(found["x"], kind="stable")]

    def flags(self, prints: np.ndarray) -> np.ndarray:
        """The flags of each, 0 for those not found."""
        if not len(self.found):
            return np.zeros(len(prints), np.uint32)
        at = np.minimum(np.searchsorted(self.found["x"], prints["x"]), len(self.found) - 1)
        hit = self.found[at]
        same = (hit["x"] == prints["x"]) & (hit["y"] & ~FLAGS == prints["y"] & ~FLAGS)
        return np.where(same, hit["y"] & FLAGS, 0).astype(np.uint32)


def sort_parse(e: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bucket of entries by core and context: what repeats and what asks for a closer look."""
    y = e["y"] & ~FLAGS
    order = np.lexsort((y, e["x"], e["core"]))
    e, y, chunk = e[order], y[order], chunk[order]
    n = len(e)
    new_core = np.ones(n, bool)
    new_core[1:] = e["core"][1:] != e["core"][:-1]
    new = new_core.copy()
    new[1:] |= (e["x"][1:] != e["x"][:-1]) | (y[1:] != y[:-1])
    at = np.flatnonzero(new)
    context = np.cumsum(new) - 1
    times = np.add.reduceat(1 + (e["y"] & MANY).astype(np.int64), at)
    core_at = np.flatnonzero(new_core[at])  # contexts that begin a core
    contexts = np.diff(np.append(core_at, len(at)))
    shared = np.repeat(contexts > 1, contexts)
    repeated = times > 1
    flags = repeated[context] * REPEATED
    # one chunk sorts the strings for all that have the context
    flags |= (shared[context] & new) * ASKED
    use = flags > 0
    out = np.empty(int(use.sum()), PRINT)
    out["x"], out["y"] = e["x"][use], y[use] | flags[use].astype(np.uint32)
    return out, chunk[use]


def sort_strings(e: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bucket of strings: those that meet an equal one."""
    y = e["y"] & ~FLAGS
    order = np.lexsort((y, e["x"]))
    e, y, chunk = e[order], y[order], chunk[order]
    new = np.ones(len(e), bool)
    new[1:] = (e["x"][1:] != e["x"][:-1]) | (y[1:] != y[:-1])
    at = np.flatnonzero(new)
    times = np.add.reduceat(1 + (e["y"] & MANY).astype(np.int64), at)
    use = (times > 1)[np.cumsum(new) - 1]
    out = np.empty(int(use.sum()), PRINT)
    out["x"], out["y"] = e["x"][use], y[use] | REPEATED
    return out, chunk[use]


def _parse(n: int):
    def work(batches):
        held: dict[int, list[np.ndarray]] = {}
        size: dict[int, int] = {}

        def send(chunk: int):
            e = distinct(np.concatenate(held.pop(chunk)))
            return letters((e["core"] % np.uint64(n)).astype(np.int64), e, chunk, 1, n)

        for batch, _, data, starts in parts(batches):
            p = Parse(data, starts)
            if not len(p.low):
                continue
            e = np.empty(len(p.low), ENTRY)
            e["x"], e["y"], e["core"] = p.context["x"], p.context["y"], p.core
            # the rows of a run may be of several chunks
            of_row = np.asarray(batch.column("chunk"))
            of_entry = of_row[np.searchsorted(starts, p.low, "right") - 1] if batch.num_rows > 1 else np.full(len(e), of_row[0])
            for chunk in np.unique(of_entry).tolist():
                mine = e[of_entry == chunk]
                held.setdefault(chunk, []).append(mine)
                size[chunk] = size.get(chunk, 0) + len(mine)
                if size[chunk] > chunks.GATHERED:
                    size[chunk] = 0
                    yield send(chunk)
        for chunk in list(held):
            yield send(chunk)

    return work


def _strings(n: int):
    def work(docs: pa.Table, replies: pa.Table) -> pa.Table:
        known = Known(records_of(replies.column("blob"), PRINT)) if replies.num_rows else None
        held = []
        if docs.num_rows and known is not None:
            for _, _, data, starts in parts(docs.combine_chunks().to_batches()):
                p = Parse(data, starts)
                flags = known.flags(p.context)
                at, owner = p.strings(np.flatnonzero(flags & ASKED > 0))
                e = p.prints(at, at + SPAN)
                e["y"] |= flags[owner] & REPEATED
                held.append(distinct(e))
        if not held:
            return pa.Table.from_batches([letters(np.zeros(0, np.int64), np.zeros(0, PRINT), 0, 2, n)])
        e = distinct(np.concatenate(held))
        return pa.Table.from_batches([letters((e["x"] % np.uint64(n)).astype(np.int64), e, docs.column("chunk")[0].as_py(), 2, n)])

    return work


def _cut(docs: pa.Table, replies: pa.Table, whole_text: bool) -> pa.Table:
    known = []
    for turn in (1, 2):
        mine = replies.filter(pa.array(np.asarray(replies.column("round")) == turn)) if replies.num_rows else replies
        known.append(Known(records_of(mine.column("blob"), PRINT)))
    out: list[tuple] = []
    for batch in slices(docs.combine_chunks().to_batches(), "text"):
        whole, rows = bytes_of(batch.column("text"))
        cover = np.zeros(len(whole) + 1, np.int32)
        for _, at, data, starts in parts([batch]):
            p = Parse(data, starts)
            flags = known[0].flags(p.context)
            full = np.flatnonzero(flags & REPEATED > 0)
            np.add.at(cover, at + p.low[full], 1)
            np.add.at(cover, at + p.high[full] + SPAN, -1)
            if len(known[1].found):
                some, _ = p.strings(np.flatnonzero(flags & REPEATED == 0))
                some = some[known[1].flags(p.prints(some, some + SPAN)) > 0]
                np.add.at(cover, at + some, 1)
                np.add.at(cover, at + some + SPAN, -1)
        out += _kept(whole, rows, np.cumsum(cover[:-1]) > 0, whole_text, batch.column("text").is_null().to_pylist())
    columns = list(zip(*out)) or [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
    return pa.table([docs.column("id"), docs.column("row"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    ["id", "row", "n_bytes", "n_removed", "n_spans", "kept", "kept_text"])


def _kept(data: np.ndarray, rows: np.ndarray, gone: np.ndarray, whole_text: bool, null: list[bool]) -> list[tuple]:
    """For each row its size, how much goes in how many runs, and what is left."""
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    first = rows[:-1][rows[:-1] < len(gone)]
    begins[first] = gone[first]  # a run ends with its row
    removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins))
    out = []
    for a, b, no_text in zip(rows[:-1].tolist(), rows[1:].tolist(), null):
        cut = int(removed[b] - removed[a])
        text, lost = data[a:b], gone[a:b]
        kept = text[~lost].tobytes() if cut else text.tobytes()
        letters_left = None if no_text or not whole_text else whole_letters(text, lost) if cut else kept.decode()
        out.append((b - a, cut, int(spans[b] - spans[a]), None if whole_text else kept, letters_left))
    return out


def whole_letters(data: np.ndarray, gone: np.ndarray) -> str:
    """What is left as text: a letter of several bytes goes if one of them goes."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    whole = np.logical_or.reduceat(gone, first)
    keep = ~np.repeat(whole, np.diff(np.append(first, len(data))))
    return data[keep].tobytes().decode()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_text: bool = False) -> DataFrame:
    """Removes from each text every byte covered by a SPAN-byte string that also starts at
    another place, of the same text or another.

    Columns: ``id``, ``row`` (a struct of the other columns of ``docs``, the id included, which
    may have any names), ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), and ``kept`` (the
    bytes left, concatenated) or, with ``whole_text``, ``kept_text`` (the same by whole letters: one that
    loses a byte goes; null for null), the other column null. One row per row; repeated rows are documents of
    their own, so long ones remove each other. A null text is empty; texts shorter than SPAN
    stay whole; an empty table gives an empty one. Null ids change nothing.

    The text is shuffled once; entries, 20 bytes for about every EVERY bytes of text, once.
    """
    n = partitions(docs.sparkSession)
    dealt = chunks.deal(docs, id_col, text_col, n)
    parsed = chunks.resolve(dealt.mapInArrow(_parse(n), LETTERS), 1, ENTRY, sort_parse)
    asked = chunks.reply(dealt, parsed, _strings(n), LETTERS)
    found = chunks.resolve(asked, 2, PRINT, sort_strings)
    return chunks.reply(dealt, parsed.unionAll(found), lambda docs, replies: _cut(docs, replies, whole_text),
                        chunks.answered(dealt, "n_bytes long, n_removed long, n_spans long, kept binary, kept_text string"))

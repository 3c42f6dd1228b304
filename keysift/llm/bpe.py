"""Byte-pair encoding by an automaton over tokens, compiled merge by merge.

The automaton starts with one state and an arc for each byte, so any text of bytes is a
path. The gadget of merge (u, v) -> w takes the state in which u ends, makes a copy of it
without the arc v, sends all arcs u to the copy, and adds an arc w beside each arc u, to
where v led. Hence all arcs with one label lead to one state, which is named by the label:
the state of w is the state of v as it was when w was made, and then loses an arc per later
merge that begins with w. Two labels may follow each other only if no gadget has cut that
arc, and a text's encoding is the one path whose labels spell it.

The arcs of 50,000 states to 50,000 labels are not written out. The compiled tables hold
what each gadget did (which arc it cut, whose state it copied), from which an arc is
worked out when first needed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.llm.common import MULTIPLIERS, slices

# Fixed value: how byte-level vocabularies split a text into words.
WORDS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Words a task keeps at most, beyond which it gathers anew, and places for known arcs.
KEPT_WORDS = 500_000
ARC_BITS = 20
#: Bytes of text whose new words are encoded together.
TEXT_BYTES = 1 << 20
#: Bytes from which a word is encoded by itself.
LONG_WORD = 96


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable
    ones for themselves, the others in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Automaton:
    """The compiled tables. Labels 0-255 are the bytes, label 256 + k is made by merge k."""

    labels: list[bytes]
    ids: np.ndarray
    cuts: np.ndarray  # arcs that gadgets cut, as state * labels + label, in order
    cut_by: np.ndarray  # the label that each of those gadgets made
    left: np.ndarray
    right: np.ndarray
    steps: np.ndarray  # the labels as a tree: [node, byte] -> node, 0 if there is none
    ends: np.ndarray  # the label that ends at a node, or -1
    added: dict[str, int]  # strings with an id of their own

    def __post_init__(self):
        self.lengths = np.fromiter(map(len, self.labels), np.int64, len(self.labels))
        self.longest = int(self.lengths.max())
        self.text_of = {int(i): x for i, x in zip(self.ids, self.labels)} | {i: s.encode() for s, i in self.added.items()}
        self.arcs = np.full(1 << ARC_BITS, -1, np.int64)  # arcs looked at before
        self.arc_is = np.zeros(1 << ARC_BITS, bool)

    def has_arc(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Whether each label may follow its state."""
        key = state * len(self.labels) + label
        slot = ((key.view(np.uint64) * MULTIPLIERS[0]) >> np.uint64(64 - ARC_BITS)).view(np.int64)
        found = self.arc_is[slot]
        new = np.flatnonzero(self.arcs[slot] != key)
        if len(new):
            found[new] = known = self._arc(state[new], label[new])
            # slot by slot the last of equal slots stays, for the key as for its answer
            self.arcs[slot[new]] = key[new]
            self.arc_is[slot[new]] = known
        return found

    def _arc(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        # Walks back in time through the gadgets that made the two; what a gadget cut
        # counts if it came before the copy, or before the arc, that is looked at.
        n = len(self.labels)
        out = np.ones(len(state), bool)
        rows, before = np.arange(len(state)), np.full(len(state), n)
        while len(rows):
            key = state * n + label
            at = np.minimum(np.searchsorted(self.cuts, key), len(self.cuts) - 1)
            cut = (self.cuts[at] == key) & (self.cut_by[at] < before)
            out[rows[cut]] = False
            go = ~cut & ((state >= 256) | (label >= 256))
            rows, state, label = rows[go], state[go], label[go]
            # a state was copied from that of its right part, an arc was added beside that
            # of its left part, also by the gadget that made it
            copied = state > label
            before = np.where(copied, state, label + 1)
            state, label = np.where(copied, self.right[state], state), np.where(copied, label, self.left[label])
        return out

    def paths(self, words: list[bytes]) -> list[np.ndarray]:
        """For each word the ids along the one path that spells it.

        All words take their steps together: from each place that a path has reached, the
        tree of labels is walked, and each label with an arc from there reaches its end.
        A word's beginning has one path only, so each place is reached at most once.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        n, longest = len(words), int(size.max(initial=0))
        data = np.zeros((n, longest + 1), np.uint8)
        data[np.arange(longest + 1) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        state = np.full((n, longest + 1), -1, np.int64)  # the label that ends at each place
        for at in range(longest):
            rows = np.flatnonzero((state[:, at] >= 0) & (size > at)) if at else np.flatnonzero(size > 0)
            node, here, to = np.zeros(len(rows), np.int64), state[rows, at], at
            while len(rows):
                node = self.steps[node, data[rows, to]]
                to += 1
                go = node > 0
                rows, node, here = rows[go], node[go], here[go]
                label = self.ends[node]
                full = np.flatnonzero(label >= 0)
                if at:
                    full = full[self.has_arc(here[full], label[full])]
                state[rows[full], to] = label[full]
                go = to < size[rows]
                rows, node, here = rows[go], node[go], here[go]
        # from each word's end back to its beginning
        lengths, rows, at, back = self.lengths, np.arange(n), size.copy(), []
        rows = rows[at > 0]
        while len(rows):
            label = state[rows, at[rows]]
            back.append((rows, label))
            at[rows] -= lengths[label]
            rows = rows[at[rows] > 0]
        if not back:
            return [np.zeros(0, "<u4")] * n
        owner = np.concatenate([r for r, _ in back[::-1]])
        order = np.argsort(owner, kind="stable")
        found = self.ids[np.concatenate([x for _, x in back[::-1]])[order]].astype("<u4")
        return np.split(found, np.cumsum(np.bincount(owner, minlength=n))[:-1])

    def path(self, word: bytes) -> np.ndarray:
        """The same for one long word, with memory in proportion to its length: the longest
        arc is tried first, and a place from which the rest can't be spelled stays closed."""
        n, at, closed = len(word), 0, bytearray(len(word) + 1)
        labels: list[int] = []
        tries: list[list[int]] = []  # at each place of the path, arcs yet to try, longest last
        while at < n:
            if len(tries) == len(labels):
                node, found = 0, []
                for b in word[at:at + self.longest]:
                    node = int(self.steps[node, b])
                    if not node:
                        break
                    if self.ends[node] >= 0:
                        found.append(int(self.ends[node]))
                tries.append(found)
            while tries[-1]:
                label = tries[-1].pop()
                to = at + len(self.labels[label])
                if not closed[to] and (not labels or self.has_arc(np.array([labels[-1]]), np.array([label]))[0]):
                    labels.append(label)
                    at = to
                    break
            else:
                closed[at] = 1
                tries.pop()
                at -= len(self.labels[labels.pop()])
        return self.ids[labels].astype("<u4")


def compile_merges(merges: Iterable[tuple[bytes, bytes]], ids: dict[bytes, int], added: dict[str, int]) -> Automaton:
    """Adds one gadget per merge, in order. A merge's parts must be bytes or made before,
    as any trained table has them; otherwise ``ValueError``."""
    labels = [bytes([b]) for b in range(256)]
    number = {x: i for i, x in enumerate(labels)}
    cuts: dict[tuple[int, int], int] = {}
    left, right = list(range(256)), list(range(256))
    for u, v in merges:
        if u not in number or v not in number or u + v in number:
            raise ValueError(f"merge of {u!r} and {v!r} does not follow from those before it")
        label = number[u + v] = len(labels)
        labels.append(u + v)
        cuts[number[u], number[v]] = label
        left.append(number[u])
        right.append(number[v])
    tree: dict[tuple[int, int], int] = {}
    ends = [-1]
    for label, text in enumerate(labels):
        node = 0
        for b in text:
            to = tree.get((node, b))
            if to is None:
                to = tree[node, b] = len(ends)
                ends.append(-1)
            node = to
        ends[node] = label
    steps = np.zeros((len(ends), 256), np.int32)
    places = np.array(list(tree)).T
    steps[places[0], places[1]] = list(tree.values())
    arcs = np.array([a * len(labels) + b for a, b in cuts], np.int64)
    order = np.argsort(arcs)
    return Automaton(labels, np.array([ids[x] for x in labels]), arcs[order], np.array(list(cuts.values()), np.int64)[order],
                     np.array(left), np.array(right), steps, np.array(ends, np.int64), added)


def read_vocabulary(path: str) -> dict:
    """The parts of a byte-level vocabulary file that the automaton is made from."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for t in spec["added_tokens"]:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError(f"added token {t['content']!r} has options that are not supported")
    if spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("vocabularies with a normalizer or a prefix space are not supported")
    return {"merges": [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]],
            "ids": spec["model"]["vocab"], "added": {t["content"]: t["id"] for t in spec["added_tokens"]}}


_TASK: dict[str, Coder] = {}


class Coder:
    """Encodes and decodes whole texts, with the words met so far kept."""

    def __init__(self, parts: dict):
        letters = byte_letters()

        def raw(s: str) -> bytes:
            return bytes(letters[c] for c in s)

        self.auto = compile_merges([(raw(a), raw(b)) for a, b in parts["merges"]],
                                   {raw(s): i for s, i in parts["ids"].items() if s not in parts["added"]}, parts["added"])
        self.split = regex.compile(WORDS).findall
        self.double = regex.compile(r"[\p{White_Space}\x1c-\x1f] ").search
        longest = sorted(parts["added"], key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, longest))) if longest else None
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        """Encodes words that are not known yet, those of similar length together."""
        new = sorted((w.encode() for w in words.difference(self.words)), key=len)
        while new and len(new[-1]) > LONG_WORD:
            long = new.pop()
            self.words[long.decode()] = self.auto.path(long).tobytes()
        for i in range(0, len(new), 4096):
            for w, found in zip(new[i:i + 4096], self.auto.paths(new[i:i + 4096])):
                self.words[w.decode()] = found.tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; a string of an added token counts as that token wherever
        it stands.

        A word never goes on across a space that follows a character other than white space,
        so a text is cut there first, where that is the only kind of space it has.
        """
        for kept in (self.words, self.pieces):
            if len(kept) > KEPT_WORDS:
                kept.clear()
        plans: list[list[tuple[list[str], list[str]] | bytes]] = []  # words, then pieces after a space
        words: set[str] = set()
        pieces: set[str] = set()
        for text in texts:
            plan: list[tuple[list[str], list[str]] | bytes] = []
            for part, token in self._parts(text):
                if self.double(part):
                    first, rest = self.split(part), []
                else:
                    head, *rest = part.split(" ")
                    first = self.split(head)
                plan.append((first, rest))
                if token is not None:
                    plan.append(np.array([token], "<u4").tobytes())
                words.update(first)
                pieces.update(rest)
            plans.append(plan)
        split = {p: self.split(" " + p) for p in pieces.difference(self.pieces)}
        words.update(w for found in split.values() for w in found)
        self._learn(words)
        word, piece = self.words.__getitem__, self.pieces.__getitem__
        self.pieces.update((p, b"".join(map(word, found))) for p, found in split.items())
        return [np.frombuffer(b"".join([x if isinstance(x, bytes) else b"".join([*map(word, x[0]), *map(piece, x[1])])
                                        for x in plan]), "<u4") for plan in plans]

    def _parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text between added tokens, each with the id of the token after it."""
        at = 0
        for m in self.added.finditer(text) if self.added else ():
            yield text[at:m.start()], self.auto.added[m[0]]
            at = m.end()
        yield text[at:], None

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs, one after the other."""
        return b"".join(map(self.auto.text_of.__getitem__, ids.tolist()))


def coder(key: str, parts: dict) -> Coder:
    """This process's coder; it is compiled once."""
    if key not in _TASK:
        _TASK.clear()
        _TASK[key] = Coder(parts)
    return _TASK[key]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
           ids: bool = True) -> DataFrame:
    """Encodes each whole text and decodes it again.

    ``vocabulary`` is a byte-level vocabulary file, read on the driver (its size is the
    vocabulary's, whatever the data's) and sent to the tasks. Returns one row per row:
    ``id_col``, ``token_ids`` (array<int>; null unless ``ids``), ``n_tokens``, ``ids_sha256``
    (of the ids as little-endian unsigned 32-bit integers) and ``decoded_sha256`` (of the
    decoded text in UTF-8). A null text counts as empty: no tokens. Other columns are not
    read, equal rows give equal results, and an empty table gives an empty one. Nothing is
    shuffled; a row's work depends on that row alone.
    """
    parts = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    key = hashlib.sha256(repr(sorted(parts.value["ids"].items())).encode()).hexdigest()
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = coder(key, parts.value)
        for batch in slices(batches, "text", TEXT_BYTES):
            tokens, counts, of_ids, of_text = [], [], [], []
            for found in machine.encode([x or "" for x in batch.column("text").to_pylist()]):
                counts.append(len(found))
                of_ids.append(hashlib.sha256(found).hexdigest())
                of_text.append(hashlib.sha256(machine.decode(found)).hexdigest())
                tokens.append(found.astype(np.int32) if ids else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(tokens, pa.list_(pa.int32())), pa.array(counts, pa.int64()),
                 pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["id", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        work, f"id {id_type}, token_ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return rows.withColumnRenamed("id", id_col)

"""Near duplicates by an inverted join of MinHash signatures.

Each distinct set of shingles has a signature of COORDINATES least hashes. A set is posted under
its (coordinate, value) pairs, and two sets that collide in at least ``least_matches`` of them are
candidates. Two sets of similarity s collide in a binomial number of mean COORDINATES * s;
at the least similarity asked for it falls below that in MISSED of all pairs at most.

Prefix: the pairs of a set are taken from the rarest to the commonest. Sets with m
collisions share a pair among the rarest COORDINATES - m + 1 of both, so only those are
posted; the long lists of common lines and passages are skipped, and their collisions
counted from the signatures when a short list has brought two sets together. Pairs that
one set alone has bring nothing together and are not posted at all.

Candidates need not be listed pair by pair: of a list, a spanning forest of its candidate
pairs goes on. Sets so connected are then compared exactly, whole set against whole
set, by an incidence product, and again the forest of the links found goes on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.llm.common import (
    BUFFER, MULTIPLIERS, Rolling, bytes_of, cut, group_starts, mix, pairs_in_groups, partitions, slices, whole_groups,
    words_of)
from keysift.llm.graph import components, meetings, sized
from keysift.operators.joins import may_match

SHINGLE = 5
COORDINATES = 32
#: The greatest chance that a pair just similar enough is no candidate.
MISSED = 2e-5
SIMILAR = 85  # percent
#: Sets of a list, or of a group of candidates, that one block holds.
LIST_BLOCK, SET_BLOCK = 512, 512


def least_matches(percent: int) -> int:
    """The collisions that candidates need: as many as a pair ``percent`` similar lacks with a chance of MISSED at most."""
    s = percent / 100
    chance, k = (1 - s) ** COORDINATES, 0  # of at most k collisions
    while chance <= MISSED and k < COORDINATES:
        k += 1
        chance += math.comb(COORDINATES, k) * s ** k * (1 - s) ** (COORDINATES - k)
    return max(1, k)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def shingles(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    begin, end, rows = words_of(data, starts)
    h = Rolling(lowered(data)).of(begin, end)
    runs = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        runs += h[i:i + len(runs)] * MULTIPLIERS[32 + i]
    runs = mix(runs)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= SHINGLE:
            found = np.sort(runs[a:b - SHINGLE + 1])
            out.append(found[np.append(True, found[1:] != found[:-1])])
        else:  # fewer words: the whole sequence is one shingle
            parts = np.append(h[a:b] * MULTIPLIERS[64:64 + b - a], MULTIPLIERS[70 + b - a])
            out.append(mix(parts.sum(dtype=np.uint64, keepdims=True)) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The least hash of each non-empty set at each coordinate."""
    h = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for i in range(COORDINATES):
        z = (h ^ MULTIPLIERS[96 + i]) * MULTIPLIERS[128 + i]
        out[:, i] = np.minimum.reduceat(z ^ (z >> np.uint64(32)), at) >> np.uint64(32)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", BUFFER):
        sets = shingles(*bytes_of(batch.column("text")))
        full = [s for s in sets if len(s)]
        signed = iter(signatures(full).view(np.int32) if full else ())
        out = [(len(s), int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ MULTIPLIERS[0]).sum(dtype=np.uint64).view(np.int64)),
                next(signed)) if len(s) else (0, 0, 0, None) for s in sets]
        n, one, two, sign = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
             pa.array(sign, pa.list_(pa.int32()))], ["id", "text_key", "n_shingles", "one", "two", "signature"])


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of pairs of 0..n-1, those that join what the ones before had not joined."""
    root = list(range(n))
    use = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
            use.append(k)
    return np.array(use, np.int64)


def candidates(lists: pa.Table, matches: int) -> pa.Table:
    """A spanning forest of the candidate pairs, of at least ``matches`` collisions, in each posting list."""
    starts = group_starts(lists, ["pair", "i", "j"])
    n = lists.num_rows
    side, item = lists.column("side").to_numpy(), lists.column("item").to_numpy()
    group = np.repeat(starts, np.diff(np.append(starts, n)))
    crossed = np.maximum.reduceat(side, starts) > 0 if n else np.zeros(0, bool)
    crossed = np.repeat(crossed, np.diff(np.append(starts, n)))
    signature = lists.column("signature").combine_chunks()
    signature = np.asarray(signature.flatten()).reshape(n, COORDINATES)
    label = np.arange(n)
    found_a, found_b = [], []
    for a, b in pairs_in_groups(starts, n):
        go = (label[a] != label[b]) & (~crossed[a] | (side[a] != side[b]))
        a, b = a[go], b[go]
        if len(a):
            go = (signature[a] == signature[b]).sum(axis=1) >= matches
            a, b = a[go], b[go]
        if len(a):
            use = forest(label[a], label[b], n)
            found_a.append(a[use])
            found_b.append(b[use])
            label = _joined(label, label[a[use]], label[b[use]])
    a = np.concatenate(found_a) if found_a else np.zeros(0, np.int64)
    b = np.concatenate(found_b) if found_b else a
    return pa.table({"a": item[a], "b": item[b]})


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The labels when the classes x and y are one."""
    to = np.arange(len(label))
    for p, q in zip(x.tolist(), y.tolist()):
        while to[p] != p:
            p = to[p]
        while to[q] != q:
            q = to[q]
        to[max(p, q)] = min(p, q)
    while True:
        new = to[to]
        if (new == to).all():
            return to[label]
        to = new


def links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets, of both sides if there are two, at least ``percent`` similar."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(flat)))
    shared = np.repeat(times > 1, times)
    column = (np.cumsum(new & shared) - 1)[shared]
    owner = owner[shared]
    common = np.zeros((n, n), np.float32)
    width = 8192
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [c, c + width])
        incidence = np.zeros((n, width), np.float32)
        incidence[owner[a:b], column[a:b] - c] = 1
        common += incidence @ incidence.T
    common = common.astype(np.int64)
    linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    linked &= np.triu(np.ones((n, n), bool), 1)
    if side.any():
        linked &= side[:, None] != side[None, :]
    return np.nonzero(linked)


def _confirmed(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["component", "i", "j"], 500):
            starts = np.append(group_starts(table, ["component", "i", "j"]), table.num_rows)
            side, item = table.column("side").to_numpy(), table.column("item").to_numpy()
            text = table.column("text").combine_chunks()
            text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
            found_a, found_b = [], []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                sets = []
                rows = pa.RecordBatch.from_arrays([text.slice(s, e - s)], ["text"])
                for part in slices([rows], "text"):
                    sets += shingles(*bytes_of(part.column("text")))
                a, b = links(sets, side[s:e], percent)
                use = forest(a, b, e - s)
                found_a.append(item[s + a[use]])
                found_b.append(item[s + b[use]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], ["a", "b"])

    return work


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = SIMILAR, keys: bool = False) -> DataFrame:
    """The near-duplicate class of each document.

    Words are separated by ASCII white space, A-Z in lower case. Columns: ``id_col``,
    ``n_shingles`` (distinct; a text of fewer than SHINGLE words is one shingle), ``component_id``
    (the smallest id reachable by links) and ``kept`` (the id is the component's). Two documents
    link if they share at least ``percent`` of their shingles' union. One row per row: rows of
    equal id are documents of their own, each linked by its own text. Null and empty texts link with nothing, rows with a
    null id are left alone (component null, kept), and an empty table gives an empty one.
    Ids must be integers; other columns are not read.

    With ``keys`` also ``text_key``, a hash of the text, and ``class_key``, which the documents of one class share and of
    different classes do not, whatever their ids; null for a document that links with nothing.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    matches = least_matches(percent)
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    signed = cut(texts.mapInArrow(
        _signed, "id long, text_key long, n_shingles long, one long, two long, signature array<int>"), "signatures")
    # equal sets are one item; its number is fixed when it is written
    item = cut(signed.where("n_shingles > 0 and id is not null").groupBy("one", "two", "n_shingles").agg(
        F.min(F.struct("id", "text_key")).alias("first"), F.min_by("signature", "id").alias("signature")).withColumn(
        "item", F.monotonically_increasing_id()), "items")
    signed_items = item.select("item", "signature")
    pairs = signed_items.select("item", F.posexplode("signature")).select("item", F.xxhash64("pos", "col").alias("pair"))
    entry = F.struct("n", "pair")
    rarest = F.expr(f"slice(array_sort(pairs), 1, size(pairs) - {matches - 1})")
    posted = cut(sized(pairs, "pair").groupBy("item").agg(F.collect_list(entry).alias("pairs")).where(
        F.size("pairs") >= matches).select("item", F.explode(rarest).alias("p")).select("item", "p.pair"), "posted")
    met = meetings(sized(posted, "pair"), "item", LIST_BLOCK).join(signed_items, "item")
    met = met.repartition(n, "pair", "i", "j").sortWithinPartitions("pair", "i", "j")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in whole_groups(batches, ["pair", "i", "j"]):
            yield from candidates(lists, matches).to_batches()

    near = cut(components(met.mapInArrow(listed, "a long, b long")), "candidates")
    # the texts of sets that may be near another, each once unless its group is large; groups are counted without texts
    wanted = cut(sized(near, "component").withColumnRenamed("node", "item").join(
        item.select("item", "first.id", "first.text_key"), "item"), "wanted")
    # other texts are dropped where they are read, so only these are shuffled
    alone = may_match(texts, wanted, ["id", "text_key"]).join(wanted, ["id", "text_key"]).groupBy(
        "item", "component", "n").agg(F.min("text").alias("text"))
    compared = meetings(alone, "item", SET_BLOCK).repartition(n, "component", "i", "j").sortWithinPartitions(
        "component", "i", "j").select("component", "i", "j", "side", "item", "text")
    linked = cut(components(compared.mapInArrow(_confirmed(percent), "a long, b long")).withColumnRenamed("node", "item").join(
        item.select("item", "first.id"), "item"), "linked")
    lowest = cut(linked.groupBy("component").agg(F.min("id").alias("low")), "lowest")
    of_item = item.join(linked.drop("id").join(lowest, "component"), "item", "left").select(
        "one", "two", "n_shingles", F.coalesce("low", "first.id").alias("low"), F.coalesce("component", "item").alias("class_key"))
    found = signed.join(of_item, ["one", "two", "n_shingles"], "left").select(
        F.col("id").alias(id_col), "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("low", "id")).alias("component_id"), "text_key",
        F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.col("class_key")).alias("class_key"))
    found = found.withColumn("kept", F.coalesce(F.col(f"`{id_col}`") == F.col("component_id"), F.lit(True)))
    return found if keys else found.drop("text_key", "class_key")

"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic models over words and beginnings of words
(which stand for inflected and joined ones); each model also gets the probabilities of the categories before it. For training, those come from models that have not
seen the document (out of fold), so a later model learns how far they can be trusted on new texts;
the models that score are then fitted on all the sample.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.llm.common import BUFFER, SPACES, cut, slices

#: Most labelled documents that models are fitted on, and folds.
SAMPLE, FOLDS = 12_000, 4
#: Words must be in so many labelled documents, and their shares in the two classes of a category must
#: differ by so many standard errors.
LEAST_DOCUMENTS, LEAST_ERRORS = 5, 4.0
#: Letters of a word's beginnings.
BEGINNINGS = (4, 5)
_EDGES = b".,;:!?\"'()[]{}-" + SPACES


def words_in(text: bytes) -> set[bytes]:
    """The distinct words of a text and their beginnings: A-Z in lower case, punctuation at their ends
    cut off, beginnings (in bytes) marked by a star."""
    words = {w.strip(_EDGES) for w in set(text.lower().split())} - {b""}
    for n in BEGINNINGS:
        words |= {w[:n] + b"*" for w in words if len(w) > n + 1}
    return words


@dataclass
class Link:
    """One model of the chain: a weight per word and per earlier category, and its threshold."""

    name: str
    weights: np.ndarray
    bias: float
    threshold: float


@dataclass
class Chain:
    """The words that count, and the models in order."""

    words: list[bytes]
    links: list[Link]
    #: By category: average precision, precision and recall out of fold.
    quality: dict[str, tuple[float, float, float]]

    def __post_init__(self):
        self.number = {w: i for i, w in enumerate(self.words)}

    def score(self, texts: Sequence[bytes]) -> np.ndarray:
        """The probability of each category, a row per text."""
        rows = Rows.of([[self.number[w] for w in words_in(t) if w in self.number] for t in texts], len(self.words))
        out = np.zeros((len(texts), len(self.links)))
        for i, link in enumerate(self.links):
            out[:, i] = chance(rows.times(link.weights[:len(self.words)]) + out[:, :i] @ link.weights[len(self.words):] + link.bias)
        return out


@dataclass
class Rows:
    """Which words each row has: the words of all rows one after the other, and the row of each."""

    words: np.ndarray
    owner: np.ndarray
    n: int
    width: int

    @staticmethod
    def of(rows: Sequence[Sequence[int]], width: int) -> Rows:
        sizes = [len(r) for r in rows]
        flat = np.concatenate([np.zeros(0, np.int64), *(np.asarray(r, np.int64) for r in rows)])
        return Rows(flat, np.repeat(np.arange(len(rows)), sizes), len(rows), width)

    def __post_init__(self):
        by_word = np.argsort(self.words, kind="stable")
        self._owner = self.owner[by_word]  # in order of the words
        self._row_at, self._word_at = (np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else x
                                       for x in (self.owner, self.words[by_word]))
        self._rows, self._words = self.owner[self._row_at], self.words[by_word][self._word_at]

    def times(self, weights: np.ndarray) -> np.ndarray:
        """The sum of the weights of each row's words."""
        out = np.zeros(self.n)
        if len(self.words):
            out[self._rows] = np.add.reduceat(weights[self.words], self._row_at)
        return out

    def back(self, values: np.ndarray) -> np.ndarray:
        """The sum of the values of the rows that have each word."""
        out = np.zeros(self.width)
        if len(self.words):
            out[self._words] = np.add.reduceat(values[self._owner], self._word_at)
        return out

    def only(self, use: np.ndarray) -> Rows:
        """The rows that are used."""
        place = np.cumsum(use) - 1
        mine = use[self.owner]
        return Rows(self.words[mine], place[self.owner[mine]], int(use.sum()), self.width)


def fit_logistic(rows: Rows, more: np.ndarray, y: np.ndarray, rounds: int = 200, decay: float = 0.002) -> np.ndarray:
    """Logistic weights of words and of ``more`` columns, and a bias, both classes of equal weight, by gradient steps with
    momentum; a weight's steps are scaled by how often its column is on."""
    n = len(y)
    weight = np.where(y > 0, n / (2 * max(1.0, y.sum())), n / (2 * max(1.0, n - y.sum())))
    scale = np.concatenate([rows.back(np.ones(n)) / n + 0.01, more.mean(axis=0) + 0.01, [1.0]])
    m = rows.width
    w, speed = np.zeros(len(scale)), np.zeros(len(scale))
    for _ in range(rounds):
        error = (chance(rows.times(w[:m]) + more @ w[m:-1] + w[-1]) - y) * weight
        step = np.concatenate([rows.back(error), error @ more, [error.sum()]]) / n
        step[:-1] += decay * w[:-1]
        speed = 0.9 * speed - 0.3 * step / scale
        w = w + speed
    return w


def chance(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_chain(found: Sequence[Sequence[int]], labels: dict[str, np.ndarray], fold: np.ndarray, words: list[bytes]) -> Chain:
    """Fits the chain; ``labels`` has an array per category, in the chain's order, of 0, 1, and NaN where it is not known: a
    category is learnt from the rows that have it. One without examples of both kinds gets probability 0 and is never stated."""
    rows = Rows.of(found, len(words))
    earlier = np.zeros((rows.n, 0))
    links, quality = [], {}
    for name, y in labels.items():
        y = y.astype(float)
        known = ~np.isnan(y)
        unseen = np.zeros(rows.n)
        if not 0 < y[known].sum() < known.sum():
            links.append(Link(name, np.zeros(len(words) + earlier.shape[1]), -30.0, 1.0))
            quality[name] = (0.0, 0.0, 0.0)
        else:
            for k in np.unique(fold):
                use, rest = known & (fold != k), fold == k
                w = fit_logistic(rows.only(use), earlier[use], y[use])
                unseen[rest] = chance(rows.only(rest).times(w[:len(words)]) + earlier[rest] @ w[len(words):-1] + w[-1])
            threshold, quality[name] = best_threshold(unseen[known], y[known])
            w = fit_logistic(rows.only(known), earlier[known], y[known])
            links.append(Link(name, w[:-1], float(w[-1]), threshold))
        earlier = np.column_stack([earlier, unseen])
    return Chain(words, links, quality)


def best_threshold(p: np.ndarray, y: np.ndarray) -> tuple[float, tuple[float, float, float]]:
    """The middle of the gap below the threshold of best F0.5 (a clean text lost weighs more than a toxic one
    kept), and average precision, precision, recall."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    precision, recall = hits / np.arange(1, len(y) + 1), hits / y.sum()
    last = np.append(p[1:] < p[:-1], True)  # equal scores go together
    f = np.where(last, 1.25 * precision * recall / np.maximum(0.25 * precision + recall, 1e-9), -1)
    k = int(np.argmax(f))
    below = p[k + 1] if k + 1 < len(p) else 0.0
    return float((p[k] + below) / 2), (float((precision * y).sum() / y.sum()), float(precision[k]), float(recall[k]))


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text",
        sample: int = SAMPLE) -> Chain:
    """Fits a chain on a sample of labelled documents: the ``sample`` ids of least hash, or all if there are
    fewer. An id counts once, with the least of its texts and the larger of each of its labels. Rows with a null id or
    text are left out, as are those with no label at all; a document without one of the labels is learnt from for the others.

    ``labels`` has ``id_col`` and a 0/1 column per category, in the chain's order. The words are all those whose
    share of the documents differs by LEAST_ERRORS standard errors or more between the classes of a category. What
    comes to the driver is bounded by ``sample``: a word is in LEAST_DOCUMENTS sampled rows at least, and
    per sampled row come the numbers of the words it has.
    """
    spark = docs.sparkSession
    kinds = [f"c{i}" for i in range(len(categories))]
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), *(F.col(f"`{c}`").alias(k) for c, k in zip(categories, kinds)))
    known = known.where("id is not null").groupBy("id").agg(*(
        F.max(F.when(F.col(k) > 0, 1).when(F.col(k).isNotNull(), 0)).alias(k) for k in kinds)).where(F.coalesce(*kinds).isNotNull())
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    # the ids and labels, ``sample`` at most, are sent to every task; of the texts only those of the sample are shuffled
    once = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), *(F.first(k).alias(k) for k in kinds))
    rows = cut(once.mapInArrow(_distinct_words, _words_schema(len(categories))), "labelled")
    total = rows.agg(*(F.count(k).alias(f"n_{k}") for k in kinds), *(F.sum(k).alias(k) for k in kinds)).first()
    if not any(total[f"n_{k}"] for k in kinds):
        return Chain([], [Link(c, np.zeros(i), -30.0, 1.0) for i, c in enumerate(categories)], {})
    counts = cut(rows.select(F.explode("words").alias("word"), *kinds).groupBy("word").agg(
        *(F.count(k).alias(f"n_{k}") for k in kinds), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds)).where(
        F.greatest(*(F.col(f"n_{k}") for k in kinds), F.lit(0)) >= LEAST_DOCUMENTS), "words")
    apart = F.lit(False)
    for k in kinds:
        yes = float(total[k] or 0)
        no = float(total[f"n_{k}"] - yes)
        if yes and no:
            share = F.col(f"n_{k}") / (yes + no)
            error = F.sqrt(share * (1 - share) * (1 / yes + 1 / no) + 1e-12)
            apart = apart | (F.abs(F.col(k) / yes - (F.col(f"n_{k}") - F.col(k)) / no) / error >= LEAST_ERRORS)
    words = sorted(bytes(r.word) for r in counts.where(apart).select("word").collect())
    number = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[number.value[w] for w in ws if w in number.value] for ws in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.list_(pa.int32())), *b.columns[2:]],
                                             ["id", "found", *b.schema.names[2:]])

    got = rows.mapInArrow(numbered, _words_schema(len(categories)).replace("words array<binary>", "found array<int>")).orderBy("id").collect()
    fold = np.arange(len(got)) % FOLDS
    return train_chain([r.found for r in got], {
        c: np.array([np.nan if r[k] is None else r[k] for r in got]) for c, k in zip(categories, kinds)}, fold, words)


def _words_schema(n: int) -> str:
    return ", ".join(["id long", "words array<binary>", *(f"c{i} int" for i in range(n))])


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", BUFFER):
        found = [sorted(words_in(t)) for t in b.column("text").cast(pa.binary()).to_pylist()]
        n = b.num_columns - 2
        yield pa.RecordBatch.from_arrays(
            [b.column("id").cast(pa.int64()), pa.array(found, pa.list_(pa.binary())), *(c.cast(pa.int32()) for c in b.columns[2:])],
            ["id", "words", *(f"c{i}" for i in range(n))])


def score_texts(chain: Chain, texts: list[bytes | None]) -> tuple[np.ndarray, list[bool]]:
    """The probabilities of each text, a row each, and whether the last category is stated."""
    p = chain.score([t or b"" for t in texts])
    last = chain.links[-1].threshold
    return p, [bool(x) for x in (p[:, -1] >= last) & (last < 1)]


def classify(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chain's probabilities on each whole text, one row per row.

    Columns: ``id_col``, ``p_<category>`` for each, ``rejected`` (the last category is stated) and ``kept``, its
    opposite. A null or empty text has no words and is kept; other columns are not read; equal
    texts get equal results; an empty table gives an empty one. The chain is sent to the tasks
    (its words are bounded by the sample); nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [f"p_{link.name}" for link in chain.links]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BUFFER):
            p, bad = score_texts(sent.value, b.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.array(p[:, i]) for i in range(len(names))),
                 pa.array(bad, pa.bool_()), pa.array([not x for x in bad], pa.bool_())],
                ["id", *(f"p{i}" for i in range(len(names))), "rejected", "kept"])

    schema = f"id {id_type}, " + "".join(f"p{i} double, " for i in range(len(names))) + "rejected boolean, kept boolean"
    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(work, schema)
    return out.toDF(id_col, *names, "rejected", "kept")

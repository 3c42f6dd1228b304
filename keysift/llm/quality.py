"""Quality rules: counts of words, symbols and repeats, and bands of compression ratios.

A text that repeats itself compresses far better than prose, and noise hardly compresses.
Both limits depend on length, as a compressor needs some text before it gains anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.llm.common import MULTIPLIERS, SPACES, slices

WINDOW = 8  # words
_CONTINUES = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size over size (zstandard, ``level``).

    ``limits``: rows (bytes below which the row holds, lowest, highest ratio); the first that fits counts. A text is
    judged as a whole, and by its pieces: chunks of ``chunk_bytes``, the rest a piece of its own, or part of the last chunk
    if it has fewer than ``rest_bytes``. Whole texts and pieces have the limits of their length, every byte is in one piece, and
    a text is rejected when at least ``bad_share`` of its bytes are in pieces outside. Texts below ``least_bytes``, where
    ratios say nothing, are judged by the counts alone.
    """

    level: int = 3
    least_bytes: int = 64
    limits: tuple[tuple[float, float, float], ...] = (
        (128, 0.45, 1.15), (256, 0.42, 1.05), (512, 0.40, 0.93), (1024, 0.37, 0.85), (2048, 0.33, 0.78), (4096, 0.30, 0.72),
        (8192, 0.28, 0.70), (16384, 0.26, 0.70), (65536, 0.24, 0.70), (float("inf"), 0.20, 0.70))
    chunk_bytes: int = 4096
    rest_bytes: int = 512
    bad_share: float = 0.25

    def outside(self, text: bytes | memoryview, compressor: zstandard.ZstdCompressor) -> tuple[float, str]:
        """The ratio of a text or piece, and "" or which limit it breaks."""
        n = len(text)
        ratio = len(compressor.compress(text)) / n
        low, high = next((a, b) for below, a, b in self.limits if n < below)
        return ratio, "repetitive" if ratio < low else "incompressible" if ratio > high else ""

    def pieces(self, n: int) -> list[tuple[int, int]]:
        """Where the pieces of a text of n bytes begin and end."""
        cuts = list(range(0, n, self.chunk_bytes))
        if len(cuts) > 1 and n - cuts[-1] < self.rest_bytes:
            cuts.pop()
        return list(zip(cuts, [*cuts[1:], n]))

    def verdict(self, text: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float | None, int, str]:
        """The whole text's ratio, the number of bad pieces, and "" or why it is rejected."""
        n = len(text)
        if n < self.least_bytes:
            return None, 0, ""
        ratio, why = self.outside(text, compressor)
        pieces, view = self.pieces(n), memoryview(text)
        if len(pieces) == 1:
            return ratio, int(why != ""), why
        bad = [b - a for a, b in pieces if self.outside(view[a:b], compressor)[1]]
        return ratio, len(bad), why or ("bad chunks" if sum(bad) >= self.bad_share * n else "")


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that occur twice or more, first ones included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    of_word = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        h += of_word[i:i + n] * MULTIPLIERS[i]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(again), 1)
    np.add.at(cover, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    count = 0
    for line in text.split(b"\n"):
        if line in seen:
            count += 1
        elif line.split(None, 1):
            seen.add(line)
    return count


def judge(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and the verdict for each whole text, one row per row.

    Columns: ``id_col``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed`` (fewer than 20 words, or more than 30 % of the words in
    repeated windows), ``ratio`` (null below ``least_bytes``), ``n_bad_chunks`` (pieces outside), ``reason`` and
    ``kept``. A null or empty text has no words, hence fails. Other columns are not read, whatever their names;
    equal rows give equal results, and an empty table gives an empty one. Nothing is shuffled. A text is worked on as a
    whole by one task, in memory of some fifteen times its size.
    """
    schema = (f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, ratio double, n_bad_chunks long, reason string, kept boolean")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        lambda batches: _judged(batches, bands), schema)
    return rows.withColumnRenamed("id", id_col)


def _judged(batches: Iterator[pa.RecordBatch], bands: Bands) -> Iterator[pa.RecordBatch]:
    compressor = zstandard.ZstdCompressor(level=bands.level)
    for batch in slices(batches, "text"):
        out = [judge_text(text, bands, compressor) for text in batch.column("text").cast(pa.binary()).to_pylist()]
        columns = list(zip(*out)) or [[]] * 10
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "base_failed", "ratio", "n_bad_chunks", "reason", "kept"])


def judge_text(text: bytes | None, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple:
    text = text or b""
    words = text.split()
    n = len(words)
    repeats = repeated_words(words)
    failed = n < 20 or 100 * repeats > 30 * n
    ratio, bad, why = bands.verdict(text, compressor)
    return (n, len(text.translate(None, SPACES + _CONTINUES)), len(text) - len(text.translate(None, _SYMBOLS)),
            repeated_lines(text), repeats, failed, ratio, bad, "base" if failed else why, not failed and not why)


def keeps(texts: list[bytes | None], bands: Bands = Bands()) -> list[bool]:
    """The verdict on some texts."""
    compressor = zstandard.ZstdCompressor(level=bands.level)
    return [judge_text(t, bands, compressor)[-1] for t in texts]

"""What the operators share: tables, scratch space, batches, rolling hashes, grouped batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from keysift.session import shared_dir

#: ASCII white space that separates words: [\x20\x09-\x0D], what bytes.split() splits at.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text that one round of array work takes; its arrays need about a hundred times that.
BUFFER = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder's path inside ``spark.checkpoint.dir``, which all executors share (in a local session
    without that setting, inside a folder of its own)."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its work is done once, and
    neither a lost executor nor a second use repeats it."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- batches

def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = BUFFER) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``limit`` bytes in a string or binary
    column, a single larger row alone."""
    for batch in batches:
        sizes = np.diff(offsets(batch.column(column)))
        total, begin = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > limit:
                yield batch.slice(begin, i - begin)
                total, begin = 0, i
            total += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def offsets(column: pa.Array) -> np.ndarray:
    """Where each row's bytes begin and end in the column's data buffer."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(1, np.int64)
    found = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind().itemsize)
    return found.astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows' bytes one after the other, and where each begins; nulls are empty."""
    at = offsets(column)
    data = column.buffers()[2] if len(column) else None
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    if column.null_count:
        sizes = np.where(np.asarray(column.is_null()), 0, np.diff(at))
        if int(sizes.sum()) != int(at[-1] - at[0]):  # a null may own bytes
            rows = [bytes(x or b"") for x in column.cast(pa.large_binary()).to_pylist()]
            return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``keys``; a table has about
    ``least`` rows, or one group if that is larger."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        joined = pa.Table.from_batches(held).combine_chunks()
        starts = group_starts(joined, keys)
        if len(starts) > 1:
            last = int(starts[-1])
            yield joined.slice(0, last).combine_chunks()
            joined = joined.slice(last)
        held, rows = joined.to_batches(), 0 if len(starts) > 1 else rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """The rows at which a new group begins."""
    n = rows.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for key in keys:
        v = rows.column(key).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def pairs_in_groups(starts: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same group, in arrays by distance of the two."""
    ends = np.append(starts[1:], n)
    end_of = np.repeat(ends, ends - starts)
    left = np.arange(n)
    step = 1
    while True:
        left = left[left + step < end_of[left]]
        if not len(left):
            return
        yield left, left + step
        step += 1


# --- hashes

_RNG = np.random.Generator(np.random.PCG64(0x5EED))
_BYTES = _RNG.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASES = _RNG.integers(0, 2**64, 2, dtype=np.uint64) | np.uint64(5)
_INVERSES = np.array([pow(int(b), -1, 2**64) for b in _BASES], np.uint64)
MULTIPLIERS = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each bit over all 64."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, BUFFER + (BUFFER >> 2))
        have = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]))
                     for x in (_BASES[which], _INVERSES[which]))
        if size <= 8 * BUFFER:  # a longer text's are not kept
            _POWERS[which] = have
    return have


class Rolling:
    """Polynomial hashes, modulo 2^64, of any stretch of a buffer, from prefix sums."""

    def __init__(self, data: np.ndarray, which: int = 0):
        powers, self.back = _powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[which][data] * powers[:len(data)], out=self.sums[1:])

    def raw(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.back[begin]

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(begin, end) + (end - begin).astype(np.uint64) * MULTIPLIERS[255])


def of_runs(h: np.ndarray, which: int = 0):
    """A function of begins and ends: hashes of runs of items, from the items' hashes."""
    powers, back = _powers(which, len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers[:len(h)], out=sums[1:])
    return lambda a, b: mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of all rows begin and end, and at which word each row begins."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    word = ~_IS_SPACE[data]
    new = word.copy()
    new[1:] &= ~word[:-1]
    rows = starts[:-1][starts[:-1] < len(data)]
    new[rows] = word[rows]  # a row's first word does not go on from the row before
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends_at = rows[rows > 0] - 1
    last[ends_at] = word[ends_at]
    begin = np.flatnonzero(new)
    return begin, np.flatnonzero(last) + 1, np.searchsorted(begin, starts)

"""Questions that documents ask of all others, without keys or copies gathering anywhere.

Documents are dealt to chunks by one shuffle, whose files are read again for each round. In a
round a chunk packs its distinct keys into one blob per bucket, so a key costs at most one
entry a chunk however often it occurs; a bucket's task sorts the entries of all chunks, and
sends each chunk its answers. Blobs are arrays of fixed records, many to a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from keysift.llm.common import partitions

LETTERS = "bucket int, chunk int, round int, blob binary"
#: Entries a chunk gathers before it sends them; more are sent in several blobs.
GATHERED = 4_000_000


def deal(docs: DataFrame, id_col: str, text_col: str, n: int | None = None) -> DataFrame:
    """The documents by chunk: ``chunk``, ``id``, ``text``, and ``row``, a struct of the other
    columns (as a struct, their names clash with nothing). As many chunks as
    ``spark.sql.shuffle.partitions`` unless given."""
    n = n or partitions(docs.sparkSession)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(n)).cast("int").alias("chunk"),
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(*others).alias("row"),
    ).repartition(n, "chunk")


def answered(dealt: DataFrame, columns: str) -> StructType:
    """``id`` and ``row`` of the documents, as they are, and further columns."""
    return StructType([StructField("id", LongType()), dealt.schema["row"], *StructType.fromDDL(columns).fields])


def letters(bucket: np.ndarray, records: np.ndarray, chunk: int, turn: int, n: int) -> pa.RecordBatch:
    """One row per bucket with the records that go there."""
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=n)
    full = np.flatnonzero(counts)
    cuts = np.split(records[order], np.cumsum(counts[full])[:-1]) if len(full) else []
    return _batch(full, np.full(len(full), chunk), turn, cuts)


def answers(chunk: np.ndarray, records: np.ndarray, turn: int) -> Iterator[pa.RecordBatch]:
    """One row per chunk with the records that go back to it."""
    if not len(chunk):
        return
    order = np.argsort(chunk, kind="stable")
    chunks, at = np.unique(chunk[order], return_index=True)
    cuts = np.split(records[order], at[1:])
    for i in range(0, len(chunks), 1000):
        yield _batch(np.zeros(len(chunks[i:i + 1000])), chunks[i:i + 1000], turn, cuts[i:i + 1000])


def _batch(buckets, chunks, turn: int, blobs: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), pa.array(chunks, pa.int32()), pa.array([turn] * len(blobs), pa.int32()),
         pa.array([b.tobytes() for b in blobs], pa.binary())], ["bucket", "chunk", "round", "blob"])


def records_of(blobs: pa.ChunkedArray | pa.Array, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), kind)


def resolve(sent: DataFrame, turn: int, kind: np.dtype,
            sort: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Sorts each bucket: ``sort`` gets its records and the chunk of each, and returns the
    answers and the chunk that each goes to."""
    n = partitions(sent.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, chunks = [], []
        for b in batches:
            found = b.column("blob").to_pylist()
            blobs += found
            chunks += [np.full(len(x) // kind.itemsize, c, np.int32) for x, c in zip(found, b.column("chunk").to_pylist())]
        if blobs:
            found, to = sort(np.frombuffer(b"".join(blobs), kind), np.concatenate(chunks))
            yield from answers(to, found, turn)

    return sent.repartition(n, "bucket").mapInArrow(work, LETTERS)


def reply(dealt: DataFrame, replies: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table],
          schema: StructType | str) -> DataFrame:
    """Each chunk's documents with all answers to it."""
    return dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(work, schema)

"""Best-fit packing under conflicts.

Texts are packed into bins of equal capacity, the longest first, each into the bin that it fills
best. Bins are kept in order of what is left in them; the search starts at the first bin with room
enough and goes on to its successors until one is compatible, which is then the tightest compatible
one. A bin carries bitmaps of the sources and the duplicate clusters in it: a cluster may be in a
bin once, a source ``per_source`` times (one bitmap for each time).

Texts longer than a bin are cut into whole bins and a rest.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.llm.common import SPACES, cut, whole_groups

CAPACITY = 4096
PER_SOURCE = 4
#: Pieces that are packed together, on the average; groups are dealt by hash.
GROUP = 4096


class Bins:
    """The open bins of a group, in order of what is left in them."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (left, bin)
        self.sources: list[list[int]] = []  # of a bin, a bitmap for each time a source may be in it
        self.clusters: list[int] = []
        self.counts: list[int] = []
        self.bit: dict[tuple[str, object], int] = {}

    def _bit(self, kind: str, value: object) -> int:
        """The bit of a source or cluster; none for null, which conflicts with nothing."""
        return 0 if value is None else self.bit.setdefault((kind, value), 1 << len(self.bit))

    def place(self, size: int, source: object, cluster: object) -> tuple[int, int]:
        """Puts a piece into the tightest compatible bin; its number, and the place there."""
        source, cluster = self._bit("source", source), self._bit("cluster", cluster)
        at = bisect.bisect_left(self.order, (size, -1))
        while at < len(self.order):
            left, bin = self.order[at]
            if not self.clusters[bin] & cluster and not self.sources[bin][-1] & source:
                del self.order[at]
                break
            at += 1
        else:
            left, bin = self.capacity, len(self.counts)
            self.sources.append([0] * self.per_source)
            self.clusters.append(0)
            self.counts.append(0)
        self.clusters[bin] |= cluster
        for k, bits in enumerate(self.sources[bin]):
            if not bits & source:
                self.sources[bin][k] |= source
                break
        self.counts[bin] += 1
        if left > size:
            bisect.insort(self.order, (left - size, bin))
        return bin, self.counts[bin] - 1


def pack_group(pieces: list[tuple[int, object, object]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """The bin and the place in it of each (size, source, cluster), in the order given."""
    bins = Bins(capacity, per_source)
    return [bins.place(*p) for p in pieces]


def word_count(text: Column) -> Column:
    """Words separated by ASCII white space, 0 for null."""
    spaces = SPACES.decode()
    plain = F.trim(F.translate(text, spaces, " " * len(spaces)))
    return F.when(F.length(plain) > 0, F.size(F.split(plain, " +"))).otherwise(0)


def cluster_key(text: Column) -> Column:
    """A key that texts share which differ in case and white space only; null without a word."""
    spaces = SPACES.decode()
    words = F.trim(F.regexp_replace(F.translate(text, spaces + "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                                " " * len(spaces) + "abcdefghijklmnopqrstuvwxyz"), "  +", " "))
    return F.when(F.length(words) > 0, F.md5(words))


def pack(docs: DataFrame, size: Column, source: Column, cluster: Column, capacity: int = CAPACITY,
         per_source: int = PER_SOURCE, id_col: str = "doc_id") -> DataFrame:
    """Packs the rows into bins.

    ``size``, ``source`` and ``cluster`` are columns of ``docs``. Returns a row per piece: ``id_col``, ``piece`` (from
    0), ``begin`` and ``size`` (in the text, in the unit of ``size``), ``bin_id``, ``place`` (from 0, in the bin) and
    ``source``. Rows of size 0 or null give no piece. Null sources and clusters conflict with
    nothing; equal rows are pieces of their own, of one cluster if that is what they have; whole
    bins cut from one long text are bins of their own, and only its rest is packed. Other columns are not read, and an
    empty table gives an empty one.

    Rows are dealt by hash of id and cluster to groups of GROUP on the average, packed each by one
    task: a source's rows, however many, are spread over all groups, as are copies (rows that
    agree in id and all else go together). A group ends with bins not yet full; that is less than one
    part in a hundred of its bins.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), size.cast("long").alias("size"), source.alias("source"),
                       cluster.alias("cluster"))
    # filtered after it is written: before, the sizes would be worked out once more for the filter
    rows = cut(rows, "sizes").where("size > 0")
    groups = max(1, -(-rows.count() // GROUP))
    spark = docs.sparkSession
    tasks = min(groups, int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = F.floor(F.col("size") / capacity)
    pieces = rows.withColumn("whole", whole).withColumn("piece", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("whole") - F.when(F.col("size") % capacity == 0, 1).otherwise(0)))).select(
        F.pmod(F.xxhash64("id", "cluster"), F.lit(groups)).alias("group"), "id", "piece",
        (F.col("piece") * capacity).alias("begin"),
        F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece") * capacity).alias("size"), "source", "cluster")
    dealt = pieces.repartition(tasks, "group").sortWithinPartitions(
        "group", F.desc("size"), F.xxhash64("id", "piece", "cluster"), "id", "piece", "source", "cluster")
    kinds = dict(pieces.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["group"], 1):
            size = table.column("size").to_pylist()
            group, source, cluster = (table.column(c).to_pylist() for c in ("group", "source", "cluster"))
            bins, places, before, packed = [], [], None, None
            for g, n, s, c in zip(group, size, source, cluster):
                if g != before:
                    before, packed = g, Bins(capacity, per_source)
                bin, place = packed.place(n, s, c)
                bins.append((g << 32) | bin)
                places.append(place)
            yield from pa.table({"id": table.column("id"), "piece": table.column("piece"), "begin": table.column("begin"),
                                 "size": table.column("size"), "bin_id": pa.array(bins, pa.int64()),
                                 "place": pa.array(places, pa.int64()), "source": table.column("source")}).to_batches()

    return dealt.mapInArrow(work, f"id {kinds['id']}, piece long, begin long, size long, bin_id long, place long, "
                                  f"source {kinds['source']}").withColumnRenamed("id", id_col)

"""Near duplicates of vectors by counting collisions of one-dimensional projections.

Each projection sorts the vectors on a line, and two vectors collide on it if they lie within half a
window of each other. At the least cosine the distance is known, hence the chance of a
collision on one line, and the count that at least RECALL of such pairs reach; pairs that pass it
are verified in double precision.

A line alone would count a constant share of all pairs. So each line is cut into cells by the signs
of some further projections, and windows are counted inside cells. More vectors mean more signs,
so that a cell holds about CELL vectors of an evenly spread table, and more lines, so that the
recall stays: both follow from the number of vectors by the formulas in ``plan``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.llm.common import cut, group_starts, partitions, whole_groups
from keysift.llm.graph import components, meetings, sized

COSINE = 0.9
RECALL = 0.995
CELL = 8
#: Half a window, in standard deviations of a pair at the least cosine.
HALF = 2.0
#: Collisions that a pair needs.
COUNT = 2
#: Vectors of a cell that one block holds.
BLOCK = 512
SEED = 20


@dataclass(frozen=True)
class Lines:
    """How many lines and signs per line, and the half window."""

    lines: int
    signs: int
    half: float


def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> Lines:
    """The signs and lines for n vectors, so that a pair at ``cosine`` has COUNT collisions with
    probability ``recall`` or more."""
    signs = max(1, min(36, round(math.log2(max(2, n) / CELL))))
    same_sign = 1 - math.acos(cosine) / math.pi
    p = same_sign ** signs * math.erf(HALF / math.sqrt(2))
    lines = COUNT
    while sum(math.comb(lines, k) * p ** k * (1 - p) ** (lines - k) for k in range(COUNT)) > 1 - recall:
        lines += 1
    return Lines(lines, signs, HALF * math.sqrt(2 - 2 * cosine))


def _projected(lines: Lines, dim_seed: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                vectors = part.column("unit").to_pylist()
                ids = np.asarray(part.column("item"))
                for dim in {len(v) for v in vectors}:
                    if dim not in made:
                        rng = np.random.Generator(np.random.PCG64([dim_seed, dim]))
                        made[dim] = rng.standard_normal((dim, lines.lines)), rng.standard_normal((dim, lines.lines * lines.signs))
                    of = [i for i, v in enumerate(vectors) if len(v) == dim]
                    x = np.array([vectors[i] for i in of], np.float64)
                    place = x @ made[dim][0]
                    signs = (x @ made[dim][1] > 0).reshape(len(of), lines.lines, lines.signs)
                    cell = signs @ (np.int64(1) << np.arange(lines.signs, dtype=np.int64))
                    key = (cell * lines.lines + np.arange(lines.lines)) * 4096 + dim % 4096
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.ravel()), pa.array(np.repeat(ids[of], lines.lines)), pa.array(place.ravel())],
                        ["cell", "item", "at"])

    return work


def _collisions(half: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["cell", "i", "j"]):
            n = table.num_rows
            starts = group_starts(table, ["cell", "i", "j"])
            sizes = np.diff(np.append(starts, n))
            side, item, at = (table.column(c).to_numpy() for c in ("side", "item", "at"))
            crossed = np.repeat(np.maximum.reduceat(side, starts) > 0, sizes)
            # rows are in order of place, so a window ends at the first row beyond it
            go = np.arange(n)
            ends = np.repeat(np.append(starts[1:], n), sizes)
            step = 1
            while len(go):
                go = go[go + step < ends[go]]
                go = go[at[go + step] - at[go] <= half]
                a, b = go, go + step
                use = ~crossed[a] | (side[a] != side[b])
                a, b = item[a[use]], item[b[use]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
                step += 1

    return work


def links(items: DataFrame, cosine: float = COSINE, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """Pairs ``a`` < ``b`` of ``items`` (``item``, ``unit``: a vector of length 1) found with at least
    ``cosine``, none below it."""
    n = partitions(items.sparkSession)
    lines = plan(items.count(), cosine, recall)
    placed = items.mapInArrow(_projected(lines, seed), "cell long, item long, at double")
    met = meetings(sized(placed, "cell"), "item", BLOCK).repartition(n, "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "at")
    pairs = met.mapInArrow(_collisions(lines.half), "a long, b long").groupBy("a", "b").agg(
        F.count("*").alias("n")).where(F.col("n") >= COUNT).select("a", "b")
    one, two = (items.select(F.col("item").alias(c), F.col("unit").alias(f"unit_{c}")) for c in "ab")
    dot = F.aggregate(F.zip_with("unit_a", "unit_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(one, "a").join(two, "b").where((F.size("unit_a") == F.size("unit_b")) & (dot >= cosine)).select("a", "b")


def classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
            recall: float = RECALL) -> DataFrame:
    """The links and the class of each vector.

    Columns: ``id_col``, ``n_links`` (other rows linked directly), ``component_id`` (the smallest id reachable)
    and ``kept`` (the id is the component's). Equal vectors are compared once and counted as often as
    they occur. Vectors that are null, empty or zero, or hold null or non-finite components, link with
    nothing, as do vectors of other lengths; rows with a null id are left alone. Ids should be unique
    integers; rows of equal id count as rows, each linked by its own vector. An empty table gives an empty one.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col("id").isNotNull()
    largest = F.array_max(F.transform("v", F.abs))
    # scaled first, so that squares neither overflow nor vanish
    scaled = rows.where(usable).withColumn("top", largest).where("top > 0").withColumn(
        "v", F.transform("v", lambda x: x / F.col("top"))).withColumn("norm", F.sqrt(square)).select(
        "id", F.transform("v", lambda x: x / F.col("norm") + 0.0).alias("unit"))
    member = cut(scaled.withColumn("copy", F.sha2(F.concat_ws(",", F.transform("unit", lambda x: x.cast("string"))), 256)), "units")
    # an item's number is fixed when it is written; ids may repeat
    items = cut(member.groupBy("copy").agg(F.min("id").alias("low"), F.min("unit").alias("unit"), F.count("*").alias("copies")).withColumn(
        "item", F.monotonically_increasing_id()), "vectors")
    found = cut(links(items.select("item", "unit"), cosine, recall), "links")
    both = found.unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = items.select(F.col("item").alias("b"), "copies")
    linked = both.join(sizes, "b").groupBy("a").agg(F.sum("copies").alias("others"))
    joined = cut(components(found).withColumnRenamed("node", "item").join(items.select("item", "low"), "item"), "classes")
    lowest = cut(joined.groupBy("component").agg(F.min("low").alias("lowest")), "lowest")
    of_item = items.select("copy", "item", "copies", "low").join(linked.withColumnRenamed("a", "item"), "item", "left").join(
        joined.drop("low").join(lowest, "component"), "item", "left").select(
        "copy", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("lowest", "low").alias("component"))
    known = member.select("id", "copy").join(of_item, "copy").select("id", "n_links", "component")
    alone = rows.where(~F.coalesce(usable & (largest > 0), F.lit(False))).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return known.unionAll(alone).select(
        F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))

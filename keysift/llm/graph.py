"""Connected components of a graph in tables, and groups compared in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for all nodes of ``edges``
    (``a``, ``b``).

    Alternates large and small stars: each node links its larger neighbours, then itself and its
    smaller ones, to the smallest it sees, until nothing changes; the rounds grow with the
    logarithm of the nodes. A round's edges are written to the shared folder. Minima are
    combined before the shuffle, so a node with many edges costs a row per task.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that Spark splits the join at a node with many edges
        low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "low")
        large = both.where("b > a").join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = cut(large.distinct(), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b")).where("a <> b")
        edges = cut(small.distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now


def sized(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``n``, how many of them have their ``key``; keys with one row are left out.

    The counts are written first: Spark splits a hot key of a join with a table, not of one with
    an aggregate, which would have to be done in the same task.
    """
    return rows.join(cut(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "counts"), key)


def meetings(rows: DataFrame, item: str, block: int) -> DataFrame:
    """The rows of ``sized`` so that each two of equal key meet in exactly one group of that key.

    Puts ``i``, ``j`` and ``side`` in place of ``n``. A key with up to ``block`` rows is the one group (0, 0). Those of
    a larger one are dealt by ``item`` to blocks of about that size, and a group (i, j) holds two
    blocks (``side`` 0 and 1; rows of one side meet in a group of their own) or one, so no
    task gets more than two blocks.
    """
    dealt = rows.withColumn("n", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64(item), F.col("n")).cast("int")
    return dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side")).drop("n", "own", "other")

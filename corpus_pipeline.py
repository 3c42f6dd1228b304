"""A corpus from raw documents to packed bins: five stages, each on what the one before kept.

Every stage is one operator of ``keysift.llm`` on the whole table it gets. ``run`` writes what a
stage returns as Parquet into the shared folder and reads it again for the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm import minhash, packing, quality, suffix_dedup, toxicity
from keysift.llm.common import BUFFER, cut, slices, table
from keysift.llm.queries import CATEGORIES

#: Percent of two documents' shingles from which they are near duplicates. (op7's 85 is that query's contract.)
SIMILAR = 80


def _placed(docs: DataFrame) -> DataFrame:
    """The same columns, named by their places: any name may occur among them."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def _filtered(docs: DataFrame, keep) -> DataFrame:
    """The rows whose text ``keep`` (from a list of texts in UTF-8 to a list of booleans) says yes to."""
    rows, text = _placed(docs), f"c{docs.columns.index('text')}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, BUFFER):
            yield batch.filter(pa.array(keep(batch.column(text).cast(pa.binary()).to_pylist()), pa.bool_()))

    return rows.mapInArrow(work, rows.schema).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain states toxic go. It is fitted on the labelled ones of those it gets. Null and empty texts
    stay, equal texts share their fate, and an empty table gives an empty one; columns may have any names."""
    chain = spark.sparkContext.broadcast(toxicity.fit(docs, table(spark, sf_dir, "labels"), CATEGORIES))
    return _filtered(docs, lambda texts: [not bad for bad in toxicity.score_texts(chain.value, texts)[1]])


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the compression bands go; null and empty texts have no words, so they do. Equal
    texts share their fate, and an empty table gives an empty one; columns may have any names."""
    return _filtered(docs, quality.keeps)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of smallest id stays; of several rows of that id in one class,
    the first by their other columns. Rows that link with nothing stay: those with a null id, and null and empty texts
    however often they occur. An id may stand for different texts. An empty table gives an empty one."""
    found = cut(minhash.classes(docs, percent=SIMILAR, keys=True), "classes")
    key = ["doc_id", "text_key"]
    rows = _placed(docs)
    keyed = rows.withColumns({"doc_id": F.col(f"c{docs.columns.index('doc_id')}").cast("long"),
                              "text_key": F.xxhash64(f"c{docs.columns.index('text')}")})
    left = keyed.join(found.where("not kept").select(*key).distinct(), key, "left_anti")
    # ids should be unique; where one is not, its rows are gathered. Without any, the texts are not read again.
    again = cut(found.where("kept and class_key is not null").groupBy("class_key").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.collect_set("text_key").alias("keys")).where("n > 1").select(
        "class_key", "doc_id", F.explode("keys").alias("text_key")), "again")
    if again.isEmpty():
        return left.select(*rows.columns).toDF(*docs.columns)
    row = F.struct(*rows.columns)
    once = left.join(again, key).groupBy("class_key").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return left.join(again, key, "left_anti").select(*rows.columns).unionByName(once).toDF(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeated 200-byte strings cover go, and letters that lose a byte; ``n_chars`` follows. Every row stays, if
    with an empty text; a null text stays null, repeated rows remove each other's long strings, and an empty table gives an
    empty one."""
    found = suffix_dedup.dedup(docs, whole_text=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    changed = {"text": F.col("kept_text"), "n_chars": n_chars}
    return found.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in bins of 4096 words: a row per piece, with its words. Null and empty texts have no piece, long
    ones several, and copies share no bin; an empty table gives an empty one."""
    return packing.pack(docs, packing.word_count(F.col("text")), F.col("source"), packing.cluster_key(F.col("text")))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table to the pieces in bins."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: The chain and the bands can't be stated in SQL; the stages are tested against plain versions.
ORACLE_SQL = None

"""JSON documents as ordered lines.

A report or SARIF log is one JSON document per repository, and a repository may have
more findings than a task can hold. So a document is never one row: it is a set of
text lines with sort columns; in that order, the lines of a repository are the
document. The writer sorts them by range, which splits any repository over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# repository, block of the document, report it comes from, commit, part of the commit, item
ORDER = ["repository", "block", "report", "commit_rank", "commit_hash", "part",
         "file_path", "line_number", "finding_type", "secret_sha256"]
ITEM = ["file_path", "line_number", "finding_type", "secret_sha256"]
TYPES = {"block": "int", "commit_rank": "int", "part": "int", "line_number": "int"}


def lines(df: DataFrame, line: Column, **sort: Column) -> DataFrame:
    """Rows of a document; sort columns that are not given are null (first)."""
    return df.select(
        *[sort.get(c, F.lit(None)).cast(TYPES.get(c, "string")).alias(c) for c in ORDER],
        line.alias("line"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def comma(is_first: Column) -> Column:
    """What separates an element from the one before."""
    return F.when(is_first, "").otherwise(",")


def mark_first(df: DataFrame, within: list[str], by: list[str]) -> DataFrame:
    """Adds ``is_first``: the row comes first by ``by`` among those equal in ``within``.

    ``within + by`` must be unique. The firsts are a map-side minimum, joined back on
    the whole key, so no group, however large, ends up in one task.
    """
    firsts = (df.groupBy(*within).agg(F.min(F.struct(*by)).alias("_f"))
              .select(*[F.col(c).alias(f"_{c}") for c in within],
                      *[F.col("_f")[c].alias(f"_{c}") for c in by], F.lit(True).alias("_hit")))
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(firsts[f"_{c}"]) for c in within + by])
    return (df.join(firsts, same, "left")
            .select(*df.columns, F.coalesce("_hit", F.lit(False)).alias("is_first")))


def json(column: Column) -> Column:
    return F.to_json(column, {"ignoreNullFields": "false"})


def json_text(column: Column) -> Column:
    """A JSON string literal: what to_json writes between the brackets of ["..."]."""
    array = F.to_json(F.array(column))
    return array.substr(F.lit(2), F.length(array) - 2)


def write_documents(document: DataFrame, path: str) -> str:
    """One folder ``repository=...`` per document; its part files in name order are
    the document. Returns the path. Make documents from a saved findings table: the
    range sort reads its input twice."""
    (document.orderBy(*ORDER).select("repository", "line")
     .write.mode("errorifexists").partitionBy("repository").text(path))
    return path

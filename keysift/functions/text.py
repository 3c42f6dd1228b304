"""Column functions on text: lines, matches, title case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\u0001"
LINES = "array<struct<line:int,file_line:int,keyword:boolean>>"


def newlines(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))


def match_lines(text: Column, regex: Column, line_nos: Column | None = None,
                keywords: Column | None = None, at_end: bool = False) -> Column:
    """For each match of ``regex`` in order, the line it starts (or ends) on:
    ``array<struct<line, file_line, keyword>>``.

    Every match gets one extra character in front (or behind); a line's matches are
    then the characters it grew by, whatever the text contains. That is linear in
    the text, also with many matches. ``line`` is the 1-based text line, ``file_line``
    its entry of ``line_nos`` if there is one, ``keyword`` whether the line contains
    one of ``keywords`` in any case.
    """
    marked = F.regexp_replace(text, regex, F.lit("$0" + MARK if at_end else MARK + "$0"))
    no_lines = F.array().cast("array<int>")
    lines = F.arrays_zip(
        F.split(marked, "\n").alias("marked"),
        F.split(text, "\n").alias("line"),
        (no_lines if line_nos is None else F.coalesce(line_nos, no_lines)).alias("file_line"),
    )

    def of_line(x: Column, i: Column) -> Column:
        if keywords is None:
            hit = F.lit(False)
        else:
            hit = F.exists(keywords, lambda k: F.contains(F.lower(x["line"]), F.lower(k)))
        entry = F.struct(
            (i + 1).alias("line"),
            F.coalesce(x["file_line"], i + 1).alias("file_line"),
            hit.alias("keyword"),
        )
        count = F.length(x["marked"]) - F.length(x["line"])
        return F.when(count > 0, F.array_repeat(entry, count)).otherwise(
            F.array().cast(LINES))

    return F.flatten(F.transform(lines, of_line))


def title_case(s: Column) -> Column:
    """Each run of letters starts upper case and goes on lower case; anything that
    is not a letter starts a new run (``initcap`` only breaks at blanks)."""
    runs = F.regexp_extract_all(s, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(
            F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))), "")

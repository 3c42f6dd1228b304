"""Cutting units into the slices a model is asked about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.functions.text import match_lines, newlines
from keysift.operators.prompts import CONTENT_CHARS

CHUNK_CHARS = 2048


def _checked(size: int, limit: int) -> str:
    """The regex of a slice; a size that can't fit is refused."""
    if not 0 < size <= limit:
        raise ValueError(f"slices of {size} characters don't fit in a prompt's {limit}")
    return f"(?s).{{1,{size}}}"


def _doubled(content: Column) -> Column:
    """The content's length in a prompt, where braces are doubled."""
    return F.length(content) + F.length(content) - F.length(F.translate(content, "{}", ""))


def _fitting(content: Column, limit: int) -> Column:
    """A slice as it is if it fits with its braces doubled, else cut in parts that fit
    whatever they hold."""
    return F.when(_doubled(content) <= limit, F.array(content)).otherwise(
        F.regexp_extract_all(content, F.lit(f"(?s).{{1,{limit // 2}}}"), F.lit(0)))


def chunk_contents(units: DataFrame, size: int = CHUNK_CHARS, limit: int = CONTENT_CHARS) -> DataFrame:
    """``content`` of the slices of ``chunk_units`` alone, without the work on their lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    pieces = F.when(text == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all(text, F.lit(_checked(size, limit)), F.lit(0)))
    return units.select(F.explode(F.flatten(F.transform(pieces, lambda p: _fitting(p, limit)))).alias("content"))


def chunk_units(units: DataFrame, size: int = CHUNK_CHARS, limit: int = CONTENT_CHARS) -> DataFrame:
    """Slices of ``size`` characters without overlap; the last may be shorter and an
    empty text is one empty slice. A slice that is longer than ``limit`` when its braces are
    doubled comes in several, so that a prompt holds all of it; a larger ``size`` is refused.

    Adds ``chunk_no`` (from 0), ``start_line`` (text line of the slice's first
    character), ``content``, and turns ``line_nos`` into the slice's part of it. One
    regex pass cuts a text, where a substring per slice would start over each time.
    """
    keep = [c for c in units.columns if c not in ("text", "line_nos")]
    piece = F.lit(_checked(size, limit))
    text = F.coalesce(F.col("text"), F.lit(""))

    def parts(c: Column, at: Column) -> Column:
        fitting = _fitting(c, limit)
        return F.transform(fitting, lambda p, i: F.struct(
            p.alias("content"),
            (at["line"] + newlines(F.array_join(F.slice(fitting, 1, i), ""))).alias("start_line")))

    cut = units.select(
        *keep,
        F.col("line_nos") if "line_nos" in units.columns else F.lit(None).cast("array<int>").alias("line_nos"),
        F.when(text == "", F.array(F.struct(F.lit("").alias("content"), F.lit(1).alias("start_line"))))
        .otherwise(F.flatten(F.zip_with(
            F.regexp_extract_all(text, piece, F.lit(0)), match_lines(text, piece), parts))).alias("_pieces"))
    part = F.when(F.col("line_nos").isNull(), F.transform("_pieces", lambda p: F.struct(
        p["content"].alias("content"), p["start_line"].alias("start_line"),
        F.lit(None).cast("array<int>").alias("line_nos")))).otherwise(
        F.transform("_pieces", lambda p: F.struct(
            p["content"].alias("content"), p["start_line"].alias("start_line"),
            F.slice("line_nos", p["start_line"], newlines(p["content"]) + 1).alias("line_nos"))))
    return (cut.select(*keep, F.posexplode(part).alias("chunk_no", "_p"))
            .select(*keep, "chunk_no", "_p.start_line", "_p.content", "_p.line_nos"))

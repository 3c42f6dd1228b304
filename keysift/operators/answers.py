"""Reading a model's answer defensively, with native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift import schemas
from keysift.functions import levels

# Defaults of a finding's missing fields.
DEFAULT_TYPE = "unknown"
DEFAULT_CONFIDENCE = "low"
DEFAULT_RATIONALE = "Potential secret detected"

# How an answer is found in a response. An array of objects, and one whose end is missing.
CLOSED = r"(?s)(\[\s*\{.*?\}\s*\])"
OPEN = r"(?s)(\[\s*\{.*)"
FIELDS = {"line": "int", "snippet": "string", "type": "string",
          "confidence": "string", "rationale": "string"}


def _unwrapped(response: Column) -> Column:
    """Without code fences, and with doubled braces single. The latter also hits
    real nested objects; their answer then does not parse, which is intended."""
    plain = F.regexp_replace(F.regexp_replace(response, r"```json\s*", ""), r"```\s*", "")
    return F.replace(F.replace(plain, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))


def _closed(fragment: Column) -> Column:
    """A fragment that does not end in ``]`` ends after its last whole object."""
    through_last = F.regexp_extract(fragment, r"(?s)^(.*\})", 1)
    return (F.when(F.regexp_like(fragment, F.lit(r"(?s)\]\s*\z")), fragment)
            .when(through_last != "", F.concat(through_last, F.lit("\n]")))
            .otherwise(fragment))


def _items(fragment: Column) -> Column:
    """The fragment's elements if it is strict JSON, else null. The wrapper makes
    the parser see what follows the array, which it would else ignore."""
    parsed = F.try_parse_json(F.concat(F.lit('{"r":'), fragment, F.lit("}")))
    return F.try_variant_get(parsed, "$.r", "array<variant>")


def _typed(items: Column) -> Column:
    objects = F.filter(items, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    return F.transform(objects, lambda v: F.struct(*[
        F.try_variant_get(v, f"$.{name}", kind).alias(name) for name, kind in FIELDS.items()]))


def parse_answer(response: Column) -> Column:
    """``array<struct<line, snippet, type, confidence, rationale>>``, empty for
    anything that holds no JSON list; elements that are no objects are left out."""
    text = _unwrapped(response)
    closed = _typed(_items(F.nullif(F.regexp_extract(text, CLOSED, 1), F.lit(""))))
    opened = _typed(_items(F.nullif(_closed(F.regexp_extract(text, OPEN, 1)), F.lit(""))))
    return F.coalesce(closed, opened, F.array().cast(schemas.ANSWERS))


def answer_findings(answered: DataFrame) -> DataFrame:
    """Findings from chunks with an ``answer`` array: one row per item."""
    keep = [c for c in answered.columns if c != "answer"]
    item = answered.select(*keep, F.inline("answer"))
    at = F.when(F.col("line_nos").isNull(), F.col("start_line") + F.col("line") - 1).otherwise(
        F.get("line_nos", F.col("line") - 1))
    snippet = F.coalesce("snippet", F.lit(""))
    return item.select(
        "repository", "commit_hash", "commit_rank", "file_path",
        at.cast("int").alias("line_number"),
        snippet.alias("snippet"),
        F.coalesce("type", F.lit(DEFAULT_TYPE)).alias("finding_type"),
        levels.known_confidence(F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE))).alias("confidence"),
        F.coalesce("rationale", F.lit(DEFAULT_RATIONALE)).alias("rationale"),
        "author", "date",
        (F.col("commit_hash") == schemas.UNCOMMITTED).alias("is_uncommitted"),
        F.lit("model").alias("detector"),
        F.sha2(snippet, 256).alias("secret_sha256"))

"""Confidence scores and severity levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keysift.schemas import UNCOMMITTED

BASE_SCORE = "0.50"
KEYWORD_BONUS = "0.10"
HIGH_FROM = "0.80"
MEDIUM_FROM = "0.60"


def dec(value: str) -> Column:
    return F.lit(value).cast("decimal(3,2)")


def score(boost: Column, keyword_hit: Column) -> Column:
    """0.50 + the rule's boost + 0.10 for a keyword nearby, as an exact decimal."""
    bonus = F.when(keyword_hit, dec(KEYWORD_BONUS)).otherwise(dec("0.00"))
    return (dec(BASE_SCORE) + boost + bonus).cast("decimal(3,2)")


def confidence(points: Column) -> Column:
    return (F.when(points >= dec(HIGH_FROM), "high")
            .when(points >= dec(MEDIUM_FROM), "medium")
            .otherwise("low"))


def known_confidence(c: Column) -> Column:
    """A model's confidence, or ``low`` for anything but the three known words."""
    word = F.lower(F.trim(c))
    return F.when(word.isin("high", "medium", "low"), word).otherwise("low")


def sarif_level(c: Column) -> Column:
    word = F.lower(c)
    return (F.when(word == "high", "error")
            .when(word == "medium", "warning")
            .otherwise("note"))


def short_commit(c: Column) -> Column:
    return F.when(c == UNCOMMITTED, c).otherwise(F.substring(c, 1, 8))


def confidence_order(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)

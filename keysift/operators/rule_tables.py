"""Rule tables of any size: rules and literals stay a table, and texts meet them by a join.

A literal of eight bytes or more is filed under its first eight. Each text tells which of its windows of eight bytes may be
filed, by bitmaps of bounded size that are broadcast. Only those windows, with a number for the text, are joined with the
literals, and the regexes that a text met are sent to it, so a text moves once, however many windows it has. Only where many
rules share a window do texts go to the rules, once for each window. Rules without such a literal have to be tried on every
text anyway: they are a RuleSet, which refuses more than ``most`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift import schemas
from keysift.operators.automaton import best
from keysift.operators.rules import FOLDING_LETTERS, MAX_RULES, Rule, RuleSet, builtin_hints, java_dialect
from keysift.session import cut_lineage

#: Bytes of a literal that it is filed under.
WINDOW = 8
#: Bits of a bitmap for each literal, and at most: 32 MB. Where fewer than LEAST_EACH are left, there are more bitmaps.
BITS_EACH, LEAST_EACH, BITS = 32, 16, 1 << 28
#: Bits that a window sets.
PLACES = 3
#: Rules of one window whose regexes go to the texts; where there are more, the texts go to the rules.
SHARED = 64
#: The ASCII letters that FOLDING_LETTERS are taken for.
FOLDED = "skii"
_FOLDS = str.maketrans(FOLDING_LETTERS, FOLDED)
#: Bytes of text that are looked at together.
STRETCH = 1 << 22


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _windows(data: np.ndarray, folds: bool) -> np.ndarray:
    """A number for each window of WINDOW bytes, another one where case does not count."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        h |= data[i:i + n].astype(np.uint64) << np.uint64(8 * i)
    return _mixed(h ^ np.uint64(0x9E3779B97F4A7C15)) if folds else _mixed(h)


def filed_under(literal: str, folds: bool) -> int:
    return int(_windows(np.frombuffer(literal.encode()[:WINDOW], np.uint8), folds).view(np.int64)[0])


class Filed:
    """The windows that may be filed: ``places`` bits each of a bitmap."""

    def __init__(self, bits: np.ndarray, folds: bool, exact: bool, places: int = 2):
        self.bits, self.kinds, self.places = bits, [k for k, used in ((False, exact), (True, folds)) if used], places
        self.mask = np.uint64(len(bits) * 8 - 1)

    def _has(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text its distinct windows that may be filed."""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for folds in self.kinds:
            held, size = [], 0
            for i, t in enumerate(texts):
                if t:
                    held.append((i, (t.translate(_FOLDS).lower() if folds else t).encode()))
                    size += len(held[-1][1])
                if held and (size > STRETCH or i + 1 == len(texts)):
                    self._look(held, folds, found)
                    held, size = [], 0
        return [np.unique(np.concatenate(f)) if f else np.zeros(0, np.int64) for f in found]

    def _look(self, held: list[tuple[int, bytes]], folds: bool, found: list[list[np.ndarray]]) -> None:
        data = np.frombuffer(b"".join(b for _, b in held), np.uint8)
        ends = np.cumsum([len(b) for _, b in held])
        for start in range(0, len(data), STRETCH):  # a long text by itself
            h = _windows(data[start:start + STRETCH + WINDOW - 1], folds)
            at = np.flatnonzero(self._has(h & self.mask))
            for i in range(self.places - 1):
                at = at[self._has(((h[at] >> np.uint64(32)) + np.uint64(i) * (h[at] & self.mask)) & self.mask)]
            text = np.searchsorted(ends, at + start, "right")
            whole = at + start + WINDOW <= ends[np.minimum(text, len(ends) - 1)]  # not over the end of a text
            at, text = at[whole], text[whole]
            cuts = np.flatnonzero(text[1:] != text[:-1]) + 1
            for where, rows in zip(np.split(at, cuts), np.split(text, cuts)):
                if len(where):
                    found[held[rows[0]][0]].append(h[where].view(np.int64))


_LITERALS = "rule_ord int, name string, regex string, keywords array<string>, description string, confidence_boost decimal(3,2), " \
            "folds boolean, literals array<string>, filed array<long>"


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rules with the literals of which a match holds one, if all of them are long enough to be filed."""
    for batch in batches:
        folds, literals, filed = [], [], []
        for name, regex in zip(batch.column("name").to_pylist(), batch.column("regex").to_pylist()):
            rule = Rule(name, regex, (), "", 0, *builtin_hints(name, regex))
            group = [x.lower() if rule.ignores_case else x for x in best(rule.anchors)]
            if not group or any(len(x.encode()) < WINDOW for x in group):
                group = []
            folds.append(rule.ignores_case)
            literals.append(group)
            filed.append([filed_under(x, rule.ignores_case) for x in group])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(folds, pa.bool_()), pa.array(literals, pa.list_(pa.string())), pa.array(filed, pa.list_(pa.int64()))],
            [*batch.schema.names, "folds", "literals", "filed"])


class RuleTable:
    """Rules that stay a table with the rules schema, of any number; ``rule_ord`` is the key.

    What RuleSet.from_df refuses is refused: columns that are missing or of another type, null names or numbers, numbers that
    repeat, regexes that Spark does not know. ``most`` limits only the rules without a literal of WINDOW bytes,
    which are tried on every text.
    """

    def __init__(self, table: DataFrame, most: int = MAX_RULES):
        RuleSet.check_columns(table)
        self.spark = table.sparkSession
        repeated = table.groupBy("rule_ord").agg(F.count("*").alias("n"), F.count("name").alias("named")).agg(
            F.count_if(F.expr("rule_ord is null or named < n")), F.count_if(F.expr("n > 1"))).first()
        if repeated[0]:
            raise ValueError("a rule needs a name and a rule_ord")
        if repeated[1]:
            raise ValueError("each rule needs a rule_ord of its own")
        keywords = F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: k.isNotNull())
        rules = table.select(
            "rule_ord", "name", "regex", keywords.alias("keywords"), F.coalesce("description", F.lit("")).alias("description"),
            F.coalesce("confidence_boost", F.lit(0)).cast("decimal(3,2)").alias("confidence_boost"))
        # parsing the regexes is the work: spread, and done once
        tasks = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.rules = cut_lineage(rules.repartition(tasks, "rule_ord").mapInArrow(_prepared, _LITERALS))
        scanned = self.rules.where("regex <> ''")
        try:
            scanned.agg(F.count(F.regexp_like(F.lit(""), java_dialect(F.col("regex"))))).collect()
        except Exception as e:
            raise ValueError("a rule's regex is no regex that Spark knows") from e
        rest = RuleSet.from_df(scanned.where(F.size("literals") == 0), most)
        self.rest = rest if len(rest) else None
        self.filed = scanned.where(F.size("literals") > 0).select(
            "rule_ord", java_dialect(F.col("regex")).alias("_regex"), "folds", "literals", F.posexplode("filed").alias("_no", "_window"))

    def to_df(self, spark=None) -> DataFrame:
        return self.rules.select(*schemas.RULES.names)

    def lookup(self, spark=None) -> DataFrame:
        """The rules with the regex the scan runs."""
        return self.to_df().withColumn("regex", java_dialect(F.col("regex")))


def _bitmap(filed: DataFrame, size: int, folds: bool, exact: bool) -> Filed:
    low, high = F.col("_window").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("_window", 32)
    places = F.explode(F.array(low, *[high + i * low for i in range(PLACES - 1)]))
    places = filed.select(places.alias("_p")).select((F.col("_p").bitwiseAND(F.lit(size - 1)) + 1).alias("_p"))
    bits = np.zeros(size // 8, np.uint8)
    for r in places.groupBy(F.bitmap_bucket_number("_p").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("bits")).toLocalIterator():
        start = (r["bucket"] - 1) * 4096
        bits[start:start + 4096] = np.frombuffer(r["bits"], np.uint8)
    return Filed(bits, folds, exact, PLACES)


def _parts(filed: DataFrame) -> Iterator[tuple[DataFrame, Filed]]:
    """The literals and the bitmap of their windows, in as many parts as leave LEAST_EACH bits to a literal."""
    count, folds, exact = filed.agg(F.count("*"), F.bool_or("folds"), F.bool_or(~F.col("folds"))).first()
    parts = -(-count * LEAST_EACH // BITS)
    size = min(BITS, max(1 << 15, 1 << (count * BITS_EACH - 1).bit_length()))
    for k in range(parts):
        part = filed.where(F.pmod(F.xxhash64("_window"), F.lit(parts)) == k) if parts > 1 else filed
        yield part, _bitmap(part, size, folds, exact)


def _windows_in(sent: Broadcast, text: Column) -> Column:
    @F.arrow_udf("array<bigint>")
    def windows(texts: pa.Array) -> pa.Array:
        found = sent.value.of(texts.to_pylist())
        ends = np.cumsum([0, *map(len, found)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))

    return windows(text)


def _met(units: DataFrame, filed: DataFrame, text: str, *keep: Column | str) -> DataFrame:
    """``keep`` of the units and the literals filed under one of their windows, a row for each."""
    context = units.sparkSession.sparkContext
    return reduce(DataFrame.unionByName, [
        units.select(*keep, F.explode(_windows_in(context.broadcast(bitmap), F.col(text))).alias("_window")).join(part, "_window")
        for part, bitmap in _parts(filed)])


def _number(units: DataFrame) -> Column:
    """A number that a unit's columns give it; several may share one."""
    plain = [f.name for f in units.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return F.xxhash64(*plain)


def spread_by_number(units: DataFrame) -> DataFrame:
    """The units, in the tasks in which ``find_filed`` joins them: this moves the texts, once for all that reads them."""
    return units.repartition(_number(units))


def _to_texts(units: DataFrame, filed: DataFrame, text: str) -> DataFrame:
    """The regexes that a unit met go to it, each once: also where it has several literals of a rule, or shares its number."""
    met = _met(units, filed, text, _number(units).alias("_unit")).select("_unit", "rule_ord", "_regex").distinct()
    matches = F.filter(F.array(F.regexp_extract_all(F.col(text), F.col("_regex"), F.lit(0))), lambda m: F.size(m) > 0)
    return units.withColumn("_unit", _number(units)).join(met, "_unit").select(
        *units.columns, "rule_ord", F.explode(matches).alias("matches"))


def _to_rules(units: DataFrame, filed: DataFrame, text: str) -> DataFrame:
    """A text goes to the rules once for each of its windows that may be filed. A rule with several
    literals looks at a text for the first of them that it has, so it does so once."""
    t = F.col(text)
    plain = F.when(F.col("folds"), F.lower(F.translate(t, FOLDING_LETTERS, FOLDED))).otherwise(t)
    # at one literal the regex tells by itself
    first = F.when(F.size("literals") == 1, True).otherwise(
        plain.contains(F.element_at("literals", F.col("_no") + 1))
        & ~F.exists(F.slice("literals", 1, F.col("_no")), lambda x: F.contains(plain, x)))
    matches = F.when(first, F.filter(F.array(F.regexp_extract_all(t, F.col("_regex"), F.lit(0))), lambda m: F.size(m) > 0))
    return _met(units, filed, text, "*").select(*units.columns, "rule_ord", F.explode(matches).alias("matches"))


def find_filed(units: DataFrame, table: RuleTable, text: str) -> DataFrame | None:
    """``find_matches`` for the rules with a literal that is filed; None if there are none.

    The units are read twice, and have to be the same both times.
    """
    filed = table.filed
    rules_of = filed.groupBy("_window").agg(F.count("*").alias("n"))
    literals, crowded = rules_of.agg(F.count("*"), F.count_if(F.col("n") > SHARED)).first()
    if not literals:
        return None
    if not crowded:
        return _to_texts(units, filed, text)
    apart = filed.join(rules_of.where(F.col("n") > SHARED), "_window").select("rule_ord").distinct()
    many = _to_rules(units, filed.join(apart, "rule_ord", "left_semi"), text)
    rest = filed.join(apart, "rule_ord", "left_anti")
    return many if rest.isEmpty() else many.unionByName(_to_texts(units, rest, text))

"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm import (
    bpe, embedding_dedup, licenses, lm, minhash, packing, phrases, quality, suffix_dedup, superkmer, toxicity, warc, whitening)
from keysift.llm.common import cut, scratch, table

#: Label columns in the order of the chain: a document of low quality is hardly ever labelled toxic.
CATEGORIES = ["quality", "toxic"]


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    return bpe.encode(table(spark, sf, "documents"), _vocabulary(), ids=False).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """The chain's probabilities on every document, and whether it is rejected."""
    docs = table(spark, sf, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf, "labels"), CATEGORIES))


def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes that repeated 200-byte strings cover, removed from every document."""
    return suffix_dedup.dedup(table(spark, sf, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Links and class of every vector."""
    return embedding_dedup.classes(table(spark, sf, "embeddings"))


def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Every page written to archives and read back by way of the index."""
    folder = scratch(spark, "warc")
    captures = warc.write(table(spark, sf, "pages"), folder)
    warc.build_index(captures, folder)
    records = cut(warc.look_up(spark, folder, captures, payloads=False), "records")  # the archives are read once
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    responses = records.where("record_type = 'response'")
    pages = responses.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to")).distinct()
    revisits = records.where("record_type = 'revisit'").join(pages, "refers_to_record", "left")
    return responses.select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select(*columns, "refers_to"))


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, compression bands and the verdict on every document."""
    return quality.judge(table(spark, sf, "documents"))


def op7_minhash(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minhash.classes(table(spark, sf, "documents"))


def op8_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """Licences that documents or lines of them state."""
    return licenses.scan(table(spark, sf, "documents"), licenses.known_licenses(spark))


def op9_superkmer_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Passages that a document of smaller id has, removed from every document."""
    return superkmer.dedup(table(spark, sf, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place in bins of 4096 words."""
    return packing.pack(table(spark, sf, "documents"), packing.word_count(F.col("text")), F.col("source"),
                        packing.cluster_key(F.col("text")))


def op11_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """The phrases of each language that stick together most."""
    return phrases.mine(table(spark, sf, "documents"))


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Whitened coordinates of every vector on the first components."""
    return whitening.whiten(table(spark, sf, "embeddings"))


def op13_lm(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's probability by a model of the documents that are not held out."""
    docs = table(spark, sf, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2
    return lm.score(docs, lm.fit(docs.where(~held_out)), extra={"held_out": held_out})


QUERIES = {f.__name__: f for f in (
    op1_bpe, op2_toxicity, op3_suffix_dedup, op4_embedding_dedup, op5_warc, op6_quality_rules, op7_minhash,
    op8_licenses, op9_superkmer_dedup, op10_packing, op11_phrases, op12_whitening, op13_lm)}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _license_sql() -> str:
    known = ", ".join(f"({_text(name)}, {_text(t)})" for name, texts in licenses.NOTICES.items() for t in texts)

    def lines(text: str) -> str:
        lower = f"translate(replace({text}, chr(13), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        out = f"regexp_replace({lower}, {_text(licenses.COPYRIGHT)}, '', 'g')"
        out = f"regexp_replace(replace({out}, '&', ' and '), '[^a-z0-9\\n]+', ' ', 'g')"
        for a, b in licenses.SPELLINGS:
            out = f"replace({out}, {_text(a)}, {_text(b)})"
        return f"[trim(x, ' ') for x in string_split({out}, chr(10))]"

    joined = "array_to_string([x for x in lines if x <> ''], ' ')"
    return f"""
    WITH known AS (SELECT DISTINCT license, sha256({joined}) AS digest
                   FROM (SELECT license, {lines('t')} AS lines FROM (VALUES {known}) v(license, t))),
    canonical AS (SELECT doc_id, {lines('text')} AS lines FROM documents),
    units AS (SELECT doc_id, 'text' AS scope, {joined} AS unit FROM canonical
              UNION ALL SELECT doc_id, 'line', unnest(lines) FROM canonical)
    SELECT doc_id, scope, license, count(*) AS n FROM units JOIN known ON sha256(unit) = digest
    WHERE unit <> '' GROUP BY ALL"""


def _warc_sql() -> str:
    letter = ("substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT "
              ">> (15 - 5 * (i % 4))) & 31), 1)")
    return f"""
    WITH rows AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
    latest AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS newest FROM rows)
    SELECT page_id, strlen(payload) AS payload_bytes,
           array_to_string([{letter} for i in range(32)], '') AS payload_digest,
           CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id < newest THEN newest END AS refers_to
    FROM latest"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# The windows by their words in full: exact, for tables that fit in one process.
_REPEATS = rf"""
    WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)),
    first AS (SELECT k, min(doc_id) AS low FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
             FROM windows JOIN first USING (k) WHERE doc_id > low),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
    counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM docs LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_PHRASES = r"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    grams AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
              FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM split, range(1, 5) sizes(size))),
    counts AS (SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 30),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
    candidates AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1),
    cuts AS (SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS one, array_to_string(w[k + 1:], ' ') AS two
             FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
    scored AS (SELECT c.lang, c.phrase, a, k, x.n AS l, y.n AS r, ((2000000::HUGEINT * a) // (x.n::HUGEINT + y.n))::BIGINT AS score
               FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = one JOIN counts y ON y.lang = c.lang AND y.phrase = two),
    worst AS (SELECT lang, phrase, a, l, r, score FROM scored
              QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_ AS (SELECT lang, f, array_to_string(w[i:i + m - 1], ' ') AS phrase
               FROM (SELECT *, unnest(range(1, size - m + 2)) AS i
                     FROM (SELECT lang, a AS f, size, w, unnest(range(2, size)) AS m FROM candidates WHERE size > 2))),
    over_ AS (SELECT lang, phrase, max(f) AS f FROM inner_ GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM worst JOIN totals USING (lang) LEFT JOIN over_ USING (lang, phrase)
    WHERE f IS NULL OR 100::HUGEINT * f < 80::HUGEINT * a
    QUALIFY rank <= 2000"""

ORACLE: dict[str, str] = {"op5_warc": _warc_sql(), "op8_licenses": _license_sql(), "op9_superkmer_dedup": _REPEATS,
                          "op11_phrases": _PHRASES}

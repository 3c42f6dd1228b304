"""The pipeline, each stage against a plain version on the documents that it got."""

import corpus_pipeline
from keysift.llm import packing, toxicity
from keysift.llm.common import cut, table
from keysift.llm.queries import CATEGORIES
from tests.conftest import SF
from tests.llm import plain
from tests.llm.test_other_operators import check_bins


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut(stage(spark, docs, SF), "test")
        assert after.columns == columns
        before, now = rows_of(docs), rows_of(after)
        if name == "toxicity":
            chain = toxicity.fit(docs, table(spark, SF, "labels"), CATEGORIES)
            bad = toxicity.score_texts(chain, [r[1].encode() for r in before])[1]
            assert now == [r for r, b in zip(before, bad) if not b]
        elif name == "quality_rules":
            assert now == [r for r in before if plain.quality_keeps(r[1])]
            assert 0 < len(now) < len(before)
        elif name == "minhash_near_dedup":
            classes = plain.near_duplicates([(r[0], r[1]) for r in before], corpus_pipeline.SIMILAR)
            assert now == [r for r in before if classes[r[0]][1] == r[0]] and len(now) < len(before)
        else:
            want = [p[3].decode("utf-8", "ignore") for p in plain.repeated_bytes([r[1] for r in before])]
            got = {r[0]: r for r in now}
            assert len(now) == len(before)
            for r, text in zip(before, want):
                assert got[r[0]][2:4] == r[2:4]
                assert got[r[0]][1] == text and got[r[0]][4] == (len(text) if text != r[1] else r[4])
        docs, kept[name] = after, len(now)
    found = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_bins(found, {r[0]: (len(plain.words(r[1])), r[3], b" ".join(plain.words(r[1])).lower() or None) for r in rows_of(docs)},
               packing.CAPACITY, packing.PER_SOURCE)


def test_hard_rows(spark):
    rows = [(1, None, None, None, None), (None, None, "en", "s", 3), (2, "", "en", "s", 0), (3, "word " * 9000, "en", "s", 45000),
            (4, "some words", None, "s", 10), (4, "some words", None, "s", 10), (4, "other words", None, "s", 11)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, kept string, `n` int")
    near = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    # the two texts of id 4 are documents of their own, of which one has a copy
    assert near.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in near.collect()) == [
        (0, ""), (1, ""), (2, ""), (3, "word " * 9000), (4, "other words"), (4, "some words")]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        after = stage(spark, docs, SF)
        assert after.count() >= 0 and (name == "best_fit_packing" or after.columns == docs.columns), name


def test_columns_of_any_name(spark):
    """Every stage leaves columns of any name and type as they are, also where an id repeats."""
    text = " ".join(f"word{k} of a text that stays" for k in range(60))
    rows = [(1, text, "en", "s", len(text), "x", {"k": 1}), (1, text, "en", "s", len(text), "w", {"k": 2}), (2, text + " end", "en", "s", 3, "y", None),
            (1, "another text with enough words to be kept by the rules of quality as it has more than twenty of them in all "
                "and none of them twice over", "en", "t", 100, "z", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `meta.lang` string, `a map` map<string,int>")
    near = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    # one row of the class of 1 and 2 stays, and the other text of id 1, which is no near duplicate of anything
    assert sorted(r["meta.lang"] for r in near.collect()) in (["w", "z"], ["x", "z"]) and near.columns == docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        assert {r["meta.lang"]: r["a map"] for r in after.collect()}.items() <= {r[5]: r[6] for r in rows}.items(), name


def test_run(spark):
    assert [r for r in corpus_pipeline.run(spark, SF).take(3)]

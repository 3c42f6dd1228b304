"""What lasts between runs or appears at once: the cache of answers, published documents, large reports, providers."""

import json
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from catalog.clients import absent_in, line_flagger
from keysift import schemas
from keysift.operators import inference
from keysift.operators.prompts import ModelOptions
from keysift.operators.rules import default_rules
from keysift.plans.report import flatten_reports, report_document
from keysift.plans.scan import scan_texts
from keysift.sources.cache import AnswerCache
from keysift.sources.published import (
    Documents, folder_name, publish_documents, published_folder, read_published, remove_unpublished)
from keysift.sources.reports import read_large_reports
from keysift.sources.tables import read_reports
from tests.test_rules import POSITIVE

RULES = default_rules()
MODEL = ModelOptions()


# --- cache

def answers(spark, rows):
    return spark.createDataFrame(rows, "cache_key string, response string, error string")


def test_cache(spark, tmp_path):
    cache = AnswerCache(spark, str(tmp_path / "cache"), 8)
    assert cache.table().count() == 0
    cache.compact()
    cache.extend(answers(spark, [(f"k{i}", f"a{i}", None) for i in range(50)] + [("bad", "", "RuntimeError: x"), (None, "y", None)]))
    cache.extend(answers(spark, [(f"k{i}", f"b{i}", None) for i in range(40, 60)]))
    assert AnswerCache(spark, str(tmp_path / "cache"), 8).table().count() == 70
    cache.compact()
    rows = {r.cache_key: r.response for r in cache.table().collect()}
    assert rows == {f"k{i}": f"a{i}" if i < 50 else f"b{i}" for i in range(60)}
    cache.extend(answers(spark, [("new", "n", None)]))
    cache.drop_old()
    assert cache.table().count() == 61 and len(os.listdir(tmp_path / "cache")) == 1
    with pytest.raises(ValueError, match="buckets"):
        AnswerCache(spark, str(tmp_path / "cache"), 4).table()


def above(lines, i):
    """The plan nodes above line i, nearest first."""
    depth = len(lines[i])
    for line in reversed(lines[:i + 1]):
        at = next(k for k, c in enumerate(line) if c.isalpha())
        if at < depth:
            depth = at
            yield line[at:]


def test_cache_is_not_shuffled(spark, tmp_path):
    cache = AnswerCache(spark, str(tmp_path / "cache"), 8)
    cache.extend(answers(spark, [(f"k{i}", "[]", None) for i in range(200)]))
    asked = spark.range(500).select(F.concat(F.lit("k"), "id").alias("cache_key"), F.lit("x").alias("content"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        distinct = inference.distinct_chunks(asked)
        for df, n in ((inference.not_cached(distinct, cache.table()), 300), (inference.known_answers(distinct, cache.table()), 200)):
            lines = df._jdf.queryExecution().executedPlan().toString().rstrip().split("\n")
            at = next(i for i, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
            side = list(above(lines, at))
            join = next(i for i, node in enumerate(side) if "Join" in node)
            assert not [node for node in side[:join] if "Exchange" in node], lines
            assert df.count() == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# --- providers

def contents(spark, n=60):
    return spark.createDataFrame([(f"k{i}", f"token = {i}") for i in range(n)], "cache_key string, content string")


def test_absent_provider_fails_its_contents_only(spark):
    chunks = contents(spark)
    distinct = inference.distinct_chunks(chunks)
    found = inference.ask(inference.contents_of(distinct, chunks), RULES, absent_in(line_flagger("token", "t"), "odd"), MODEL, tasks=4).collect()
    lost = [r for r in found if r.error]
    assert len(found) == 60 and 0 < len(lost) < 60
    assert {r.error for r in lost} == {"ProviderUnavailable: is_available() says no"} and not any(r.response for r in lost)
    assert all('"token"' in json.dumps(json.loads(r.response)[0]["snippet"].split()[0]) for r in found if not r.error)


def broken_factory(_options):
    raise OSError("no route")


class Late:
    """A provider that says at first that it is not there, and notes in a folder how it was used."""

    def __init__(self, folder, turns):
        self.folder, self.turns = folder, turns

    def __call__(self, options):
        return LateClient(self.folder, self.turns)


class LateClient:
    def __init__(self, folder, turns):
        self.folder, self.turns, self.open, self.most, self.lock = folder, turns, 0, 0, threading.Lock()

    def note(self, what):
        open(f"{self.folder}/{what}-{random.random()}", "w").close()

    def is_available(self):
        self.note("asked")
        return len([n for n in os.listdir(self.folder) if n.startswith("asked")]) > self.turns

    def initialize(self):
        self.note("ready")

    def __call__(self, prompt):
        with self.lock:
            self.open += 1
            self.most = max(self.most, self.open)
        time.sleep(0.01)
        with self.lock:
            self.open -= 1
        return "[]"

    def close(self):
        self.note(f"most{self.most}")


def test_another_turn_for_lost_contents(spark, tmp_path):
    chunks = contents(spark)
    found = inference.answers_for(chunks, RULES, Late(str(tmp_path), 2), None, MODEL, tasks=2, in_flight=3, turns=3).collect()
    assert len(found) == 60 and all(r.error is None and r.response == "[]" for r in found)
    names = [n.split("-")[0] for n in os.listdir(tmp_path)]
    assert names.count("ready") == 2 and "most3" in names and not {"most4", "most5"} & set(names)
    lost = inference.answers_for(chunks, RULES, broken_factory, None, MODEL, tasks=2, turns=2).collect()
    assert len(lost) == 60 and {r.error for r in lost} == {"ProviderUnavailable: no route"}


# --- published documents

def findings(spark, units):
    return scan_texts(units(*POSITIVE.values(), "é " + POSITIVE["npm_token"]), RULES)


def test_published_reports(spark, units, tmp_path):
    path, found = str(tmp_path / "out"), findings(spark, units).cache()
    both = found.unionByName(found.withColumn("repository", F.lit('odd/%"name é')))
    publish_documents(report_document(both), path)
    rows = read_published(spark, path)
    columns = ["repository", "commit_hash", "file_path", "line_number", "snippet", "finding_type", "confidence", "rationale"]
    assert sorted(map(tuple, rows.select(*columns).collect())) == sorted(map(tuple, both.select(*columns).collect()))
    with pytest.raises(Exception, match="already"):
        publish_documents(report_document(found), path)
    publish_documents(report_document(found), path, overwrite=True)
    assert read_published(spark, path).count() == found.count() and sum(n.startswith("job-") for n in os.listdir(path)) == 2
    remove_unpublished(spark, path)
    assert read_published(spark, path).count() == found.count() and sum(n.startswith("job-") for n in os.listdir(path)) == 1
    folder = published_folder(spark, path)
    parts = sorted((f, d) for d, _, names in os.walk(folder) for f in names if f.endswith(".txt"))
    text = "".join(open(f"{d}/{f}").read() for f, d in parts)
    assert json.loads(text)["scan_info"]["total_findings"] == found.count()


def test_a_failed_task_leaves_nothing(spark, units, tmp_path):
    path, document = str(tmp_path / "out"), report_document(findings(spark, units))
    publish_documents(document, path)
    spark.dataSource.register(Documents)
    broken = document.select("repository", F.when(F.rand() >= 0, F.raise_error(F.lit("lost"))).otherwise(F.col("line")).alias("line"))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("keysift_documents").option("path", path).mode("overwrite").save()
    assert read_published(spark, path).count() > 20
    assert sum(n.startswith("job-") for n in os.listdir(path)) == 1 and not [n for n in os.listdir(path) if n.endswith(".tmp")]


def test_publishing_needs_a_mounted_folder(spark, units):
    with pytest.raises(Exception, match="mounts"):
        publish_documents(report_document(findings(spark, units)), "hdfs://somewhere/out")
    assert folder_name("a/b%") == "repository=a%2Fb%25" and folder_name(None).endswith("PARTITION__")


# --- large reports

def big_report(rng, name):
    kinds = ["api_key", None, 'quo"te', "x {\n      y"]
    return {"scan_info": {"repository": name, "commits_scanned": 3, "total_findings": 7}, "findings_by_commit": {
        f"c{i}\"é" if i % 4 == 0 else f"c{i}": [
            {} if rng.random() < 0.1 else {"file_path": f"f{j}", "line_number": j, "snippet": rng.choice(['a "b"', "},\n      {", "    \"z\": [", "é"]),
             "finding_type": rng.choice(kinds), "confidence": "high", "extra": {"list": [{"a": 1}, {}]}, "is_uncommitted": False}
            for j in range(rng.choice([0, 0, 1, 2, 9]))] for i in range(30)},
        "summary": {"finding_types": {"api_key": 3}}}


@pytest.mark.parametrize("split", ["128m", "700"])
def test_large_reports(spark, tmp_path, split):
    rng = random.Random(4)
    for name in ("one", "two"):
        (tmp_path / f"{name}.json").write_text(json.dumps(big_report(rng, name), indent=2, ensure_ascii=rng.random() < 0.5))
    (tmp_path / "none.json").write_text(json.dumps({"scan_info": {"repository": "none"}, "findings_by_commit": {}, "summary": {}}, indent=2))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = sorted(map(repr, flatten_reports(read_reports(spark, str(tmp_path))).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = read_large_reports(spark, str(tmp_path))
        rows = sorted(map(repr, got.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == want and len(want) > 60 and got.columns[:5] == ["repository", "report", "commit_ord", "commit_hash", "finding_ord"]
    assert schemas.REPORT is not None


def test_large_report_of_another_indent(spark, tmp_path):
    report = big_report(random.Random(1), "r")
    (tmp_path / "r.json").write_text(json.dumps(report, indent=4))
    assert read_large_reports(spark, str(tmp_path)).count() == 0
    assert read_large_reports(spark, str(tmp_path), indent=4).count() == sum(map(len, report["findings_by_commit"].values()))

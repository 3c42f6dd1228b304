"""Streams of commits and patches, of findings by time, and of counts."""

import random
import time

from pyspark.sql import functions as F

from keysift import schemas
from keysift.operators.rules import default_rules
from keysift.plans.scan import scan
from keysift.plans.summary import scan_summary, type_counts
from keysift.streaming import summary
from keysift.streaming.history import history_findings, newest_commits, write_history_stream
from tests.test_rules import POSITIVE

RULES = default_rules()
SECRETS = list(POSITIVE.values())
COLUMNS = ["repository", "commit_hash", "commit_rank", "file_path", "line_number", "finding_type", "author", "date", "secret_sha256", "snippet"]


def history(rng, n, repositories=3):
    import datetime
    commits, patches = [], []
    for i in range(n):
        repo, h = f"r{rng.randrange(repositories)}", f"{rng.randrange(16 ** 8):08x}{i}"
        date = None if rng.random() < 0.1 else datetime.datetime(2024, 1, 1, 0, rng.randrange(60), rng.randrange(3))
        commits.append((repo, h, rng.choice(["ann", None]), date, rng.choice([None, "fix\n" + rng.choice(SECRETS)])))
        for k in range(rng.randrange(3)):
            text = "\n".join("+" + x for x in rng.choice(SECRETS).split("\n"))
            patches.append((repo, h, rng.choice(["commit", None]), f"f{k}", f"@@ -1 +{rng.randrange(9) + 1} @@\n{text}"))
    patches += [(f"r{k % 3}", "uncommitted", "unstaged", "w", "@@ -1 +1 @@\n+" + SECRETS[0]) for k in range(4)]
    patches += [("r0", "never", "commit", "f", "@@ -1 +1 @@\n+" + SECRETS[0]), ("r0", "never", "commit", "f", None)]
    return commits, patches


def test_streamed_history_equals_the_batch(spark, tmp_path):
    rng = random.Random(1)
    commits, patches = history(rng, 60)
    rng.shuffle(commits), rng.shuffle(patches)
    tables = {"commits": (commits, schemas.COMMITS),
              "patches": (patches, "repository string, commit_hash string, origin string, file_path string, patch string")}
    path, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    batches = 3
    for k in range(batches):
        for name, (rows, schema) in tables.items():
            part = rows[k * len(rows) // batches:(k + 1) * len(rows) // batches]
            spark.createDataFrame(part + part[:2], schema).write.mode("append").parquet(str(tmp_path / name))
        streams = [spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(tmp_path / name))
                   for name, (_, schema) in tables.items()]
        write_history_stream(newest_commits(*streams, n=4, parts=2), RULES, path, checkpoint).awaitTermination()
    done = [spark.createDataFrame(rows, schema) for rows, schema in tables.values()]
    want = sorted(map(repr, scan(*done, RULES, n=4).select(*COLUMNS).collect()))
    got = sorted(map(repr, history_findings(spark, path, 4).select(*COLUMNS).collect()))
    assert got == want and len(got) > 10


def test_state_is_forgotten_after_a_while(spark, tmp_path):
    """With a time to live the state is declared so; the results of one batch are the same."""
    commits, patches = history(random.Random(3), 10)
    for name, rows, schema in (("commits", commits, schemas.COMMITS), ("patches", patches[:-1], schemas.PATCHES)):
        spark.createDataFrame([r if name == "commits" else (*r[:2], r[2] or "commit", *r[3:]) for r in rows], schema).write.parquet(str(tmp_path / name))
    streams = [spark.readStream.schema(s).parquet(str(tmp_path / n)) for n, s in (("commits", schemas.COMMITS), ("patches", schemas.PATCHES))]
    query = write_history_stream(newest_commits(*streams, n=4, parts=1, ttl_ms=3_600_000), RULES, str(tmp_path / "t"), str(tmp_path / "c"),
                                 trigger={"processingTime": "1 second"})
    end = time.time() + 90
    while time.time() < end and not (query.lastProgress and query.lastProgress["batchId"] > 0):
        time.sleep(1)
    query.stop()
    want = scan(*[spark.read.schema(s).parquet(str(tmp_path / n)) for n, s in (("commits", schemas.COMMITS), ("patches", schemas.PATCHES))], RULES, n=4)
    assert sorted(map(repr, history_findings(spark, str(tmp_path / "t"), 4).select(*COLUMNS).collect())) == sorted(
        map(repr, want.select(*COLUMNS).collect()))


def test_summary_of_batches(spark, units, tmp_path):
    """Three batches, the last one run twice: its folder is replaced."""
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "counts", "checkpoint"))
    texts = [SECRETS[:10], SECRETS[5:15], SECRETS[:3] * 2]
    everything = None
    for k, part in enumerate(texts):
        df = units(*part, repository=f"r{k % 2}")
        df.write.mode("append").parquet(source)
        everything = df if everything is None else everything.unionByName(df)
        stream = spark.readStream.schema(df.schema).parquet(source)
        from keysift.operators.match import regex_findings
        found = summary.first_findings(regex_findings(stream, RULES))
        summary.write_summary_stream(found, path, checkpoint).awaitTermination()
    from keysift.operators.dedup import dedup_findings
    batch = dedup_findings(regex_findings(everything, RULES))
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "counts").iterdir() if p.name.startswith("batch="))
    for _ in range(2):
        assert sorted(map(tuple, summary.stream_summary(spark, path).collect())) == sorted(map(tuple, scan_summary(batch).collect()))
        assert sorted(map(tuple, summary.stream_type_counts(spark, path).collect())) == sorted(map(tuple, type_counts(batch).collect()))
        # the checkpoint forgets that the last batch was done, so the next start runs it again
        commits = tmp_path / "checkpoint" / "commits"
        for f in commits.iterdir():
            if f.name in (str(last), f".{last}.crc"):
                f.unlink()
        summary.write_summary_stream(found, path, checkpoint).awaitTermination()
    assert summary.stream_uncommitted_counts(spark, path).agg(F.sum("findings")).first()[0] == batch.count()


def test_counts_by_arrival(spark, units, tmp_path):
    df = units(SECRETS[0]).withColumn("arrived", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    from keysift.operators.match import regex_findings
    for _ in range(2):
        df.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        found = summary.first_findings(regex_findings(stream, RULES, ("arrived",)), "arrived", "1 hour")
        summary.write_summary_stream(found, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert summary.stream_summary(spark, str(tmp_path / "out")).first().total_findings == 1

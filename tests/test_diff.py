import datetime as dt

import pytest
from pyspark.sql import functions as F

from keysift import schemas
from keysift.operators import diff, history
from keysift.operators.joins import may_match
from keysift.plans.scan import scan


def patch(*lines):
    return "\n".join(lines)


TWO_HUNKS = patch(
    "--- a/x", "+++ b/x", "@@ -1,4 +1,5 @@ def f():", " one", "-two", "+2", "+2b", " three", "",
    "@@ -40,2 +41,3 @@", " ctx", "+++ counter", "+last", "\\ No newline at end of file")
CASES = {
    "two": (TWO_HUNKS, [(1, 2, "2"), (1, 3, "2b"), (2, 42, "++ counter"), (2, 43, "last")]),
    "no_counts": (patch("@@ -1 +1 @@", "-a", "+b"), [(1, 1, "b")]),
    "new_file": (patch("--- /dev/null", "+++ b/n", "@@ -0,0 +1,2 @@", "+x", "+"), [(1, 1, "x"), (1, 2, "")]),
    "deleted": (patch("--- a/n", "+++ /dev/null", "@@ -1,2 +0,0 @@", "-password=12345678", "-y"), []),
    "header_like_text": (patch("@@ -1,2 +1,3 @@", " a", "+@@ -9 +9 @@", " b"), [(1, 2, "@@ -9 +9 @@")]),
    "carriage_return": (patch("@@ -1 +5,2 @@", "+a\r", "+b @@ -1 +1 @@"), [(1, 5, "a\r"), (1, 6, "b @@ -1 +1 @@")]),
    "merge": (patch("diff --cc x", "@@@ -1,2 -1,3 +1,4 @@@ f", "  both", "- mine", " -theirs", "++new", " +of one", "+ of two",
                    "--gone", "  end", "@@@@ -9 -9 -9 +20,2 @@@@", "+++all", "   kept", " + some"),
              [(1, 2, "new"), (1, 3, "of one"), (1, 4, "of two"), (2, 20, "all"), (2, 22, "some")]),
    "no_hunk": ("Binary files differ", []),
}


@pytest.fixture
def patches(spark):
    def build(*rows):
        return spark.createDataFrame([("r", *row) for row in rows], schemas.PATCHES)
    return build


def test_added_lines(patches):
    df = patches(*[("c", "commit", name, text) for name, (text, _) in CASES.items()])
    got = {}
    for r in diff.diff_lines(df).collect():
        got.setdefault(r.file_path, []).append((r.hunk_no, r.line_no, r.line))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, (_, v) in CASES.items() if v}


@pytest.fixture
def commits(spark):
    def build(n, repository="r"):
        day = dt.datetime(2024, 1, 1)
        return spark.createDataFrame(
            [(repository, f"{repository}{i:06d}", f"a{i}", day + dt.timedelta(hours=i), f"message {i}") for i in range(n)],
            schemas.COMMITS)
    return build


@pytest.mark.parametrize("n", [0, 1, 10, 1500])
def test_last_n(commits, n):
    df = commits(2000).unionByName(commits(3, "s"))
    got = history.last_n(df, n).orderBy("repository", "commit_rank").collect()
    want = [("r", f"r{1999 - i:06d}", i + 1) for i in range(n)] + [("s", f"s{2 - i:06d}", i + 1) for i in range(min(n, 3))]
    assert [(r.repository, r.commit_hash, r.commit_rank) for r in got] == want


def test_equal_dates_rank_by_hash(spark):
    df = spark.createDataFrame([("r", h, None, dt.datetime(2024, 1, 1), None) for h in "cab"], schemas.COMMITS)
    assert [r.commit_hash for r in history.last_n(df, 2).orderBy("commit_rank").collect()] == ["a", "b"]


def test_scan(spark, commits, patches):
    secret = "password = hunter2hunter2"
    df = patches(
        ("r000003", "commit", "new.py", patch("@@ -1 +7 @@", f"+{secret}", f"-{secret}gone")),
        ("r000000", "commit", "old.py", patch("@@ -1 +1 @@", f"+{secret}")),
        ("HEAD", "staged", "staged.py", patch("@@ -1 +3 @@", f"+{secret}")),
        ("HEAD", "unstaged", "staged.py", patch("@@ -1 +3 @@", f"+{secret}")),
        ("HEAD", "untracked", "notes.txt", f"line\n{secret}"),
        ("HEAD", "untracked", "empty.txt", None))
    history_ = commits(4).withColumn("message", F.when(F.col("commit_hash") == "r000002", f"fix\n\n{secret}"))
    rows = scan(history_, df, n=2).orderBy("commit_rank", "file_path").collect()
    assert [(r.commit_hash, r.commit_rank, r.file_path, r.line_number, r.is_uncommitted) for r in rows] == [
        ("uncommitted", 0, "notes.txt", 2, True),
        ("uncommitted", 0, "staged.py", 3, True),
        ("r000003", 1, "new.py", 7, False),
        ("r000002", 2, "COMMIT_MESSAGE", 3, False)]
    assert {r.snippet for r in rows} == {"password = ..."}
    assert [(r.author, r.date) for r in rows[1:3]] == [(None, None), ("a3", "2024-01-01T03:00:00")]
    assert rows[0].confidence == "medium" and rows[0].finding_type == "password"
    assert scan(history_, df, n=2, redaction=False).where(F.col("snippet") == secret).count() == 4


def test_a_commit_counts_once(commits):
    df = commits(5)
    got = history.last_n(df.unionByName(df.limit(2)).unionByName(df), 4).orderBy("commit_rank").collect()
    assert [(r.commit_hash, r.commit_rank) for r in got] == [(f"r{4 - i:06d}", i + 1) for i in range(4)]


def test_patches_of_no_origin_are_committed(commits, patches):
    df = patches(("r000001", "commit", "a", patch("@@ -1 +1 @@", "+password = hunter2hunter2")))
    df = df.withColumn("origin", F.lit(None).cast("string"))
    assert [r.commit_rank for r in scan(commits(3), df).collect()] == [2]
    assert diff.diff_lines(df).count() == 1


def test_may_match(spark):
    """No row with a key is dropped, and hardly any other is kept."""
    keys = spark.range(0, 5000, 7).select(F.col("id").alias("k"), F.col("id").cast("string").alias("s"))
    big = spark.range(20_000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("s"), F.lit("x").alias("text"))
    got = may_match(big, keys, ["k", "s"])
    assert got.columns == big.columns
    assert got.join(keys, ["k", "s"]).count() == keys.count() and got.count() <= keys.count() + 20


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_other_patches_are_not_shuffled(spark, commits, patches):
    """Without automatic broadcasts, patches meet the key set before any exchange."""
    df = patches(*[(f"r{i:06d}", "commit", f"f{i}", "x") for i in range(50)])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tracker = spark.sparkContext.statusTracker()
        before = len(tracker.getJobIdsForGroup(None))
        found = diff.windowed_patches(df, history.last_n(commits(50), 3))
        assert len(tracker.getJobIdsForGroup(None)) == before  # nothing runs while it is built
        lines = plan_of(found.select("patch")).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    scan_at = next(i for i, x in enumerate(lines) if "patch#" in x and "Scan" in x)
    above = [x for x in lines[:scan_at] if "Exchange hashpartitioning" in x or "BroadcastHashJoin" in x]
    assert "BroadcastHashJoin" in above[-1] and any("SortMergeJoin" in x for x in lines)


def test_filters_and_columns_reach_the_scan(spark, commits, patches):
    from keysift.operators import match
    from keysift.operators.rules import default_rules
    from keysift.plans import summary
    df = patches(("r000001", "commit", "a", "x"), ("HEAD", "untracked", "b", "y"))
    plan = plan_of(summary.uncommitted(scan(commits(3), df, redaction=False)))
    aggregate = plan.index("HashAggregate") if "HashAggregate" in plan else plan.index("Aggregate")
    assert "commit_hash" in plan[aggregate:] and "Filter (is_uncommitted" not in plan[:aggregate]
    units = diff.text_units(spark.range(2).withColumn("t", F.lit("x")), F.lit("r"), F.col("id"), F.col("t"))
    assert "regexp_replace" not in plan_of(match.type_counts(units, default_rules()))

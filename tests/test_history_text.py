"""Histories as text."""

import datetime

import pytest
from pyspark.sql import functions as F

from keysift.operators.diff import diff_lines
from keysift.operators.rules import default_rules
from keysift.plans.scan import scan
from keysift.sources.history import commit_date, file_path, read_history, unquoted

# What a log with patches prints: no contents, quoted names, a deletion, a merge, a rename, an indented line like a record's first.
LOG = """commit fa5c68559371f3e942797e48cea472776b3e4695
Author: Ann Lee <a@x>
Date:   Fri Dec 4 06:48:04 2026 +0100

    bin

diff --git a/bin b/bin
new file mode 100644
index 0000000..bdc955b
Binary files /dev/null and b/bin differ
diff --git "a/q\\"uote\\ttab" "b/q\\"uote\\ttab"
new file mode 100644
index 0000000..2e427b5
--- /dev/null
+++ "b/q\\"uote\\ttab"
@@ -0,0 +1 @@
+quo"te

commit bb192ac87ad955902efda325e2ff7edb77045a7f (HEAD -> main, tag: v1)
Author: Ann Lee <a@x>
Date:   Fri Dec 4 06:48:04 2026 +0000

    gone

diff --git a/a/c.txt b/a/c.txt
old mode 100644
new mode 100755
diff --git "a/caf\\303\\251.txt" "b/caf\\303\\251.txt"
deleted file mode 100644
index f1f0fa1..0000000
--- "a/caf\\303\\251.txt"
+++ /dev/null
@@ -1,3 +0,0 @@
-x
-z
-++ plus

commit 8ee470c96d32482d5233259c6316610e3489c1c4
Merge: cd7db14 435f550
Author: Ann Lee <a@x>
Date:   Fri Dec 4 06:48:03 2026 +0000

    merged

diff --cc sp ace.txt
index ba2906d,fcf9ee8..49f33a8
--- a/sp ace.txt
+++ b/sp ace.txt
@@@ -1,1 -1,3 +1,1 @@@
- main
 -a
 -b
 -side
++both

commit 435f550938c1079682287cccc40748fae200e462
Author: Ann Lee <a@x>
Date:   Fri Dec 4 06:48:03 2026 +0000

    side

diff --git a/sp ace.txt b/sp ace.txt
index 422c2b7..fcf9ee8 100644
--- a/sp ace.txt\t
+++ b/sp ace.txt\t
@@ -1,2 +1,3 @@
 a
 b
+side
commit 901fa0d9c0adb9f673ad65b62c2922256cc6498f
Author: Ann Lee <a@x>
Date:   Fri Dec 4 06:48:03 2026 +0000

    first
    
      indented body
    
    commit not a commit
    last

 a/c.txt | 0
 1 file changed

diff --git a/a/b.txt b/a/c.txt
similarity index 100%
rename from a/b.txt
rename to a/c.txt
diff --git "a/caf\\303\\251.txt" "b/caf\\303\\251.txt"
index b77b4eb..f1f0fa1 100644
--- "a/caf\\303\\251.txt"
+++ "b/caf\\303\\251.txt"
@@ -1,2 +1,3 @@
 x
-y
+z
+++ plus

commit 01bc9236b6237f7ac4f86093100f8bc3e451e787
Author: Nobody
"""
PATHS = {("fa5c", "bin"), ("fa5c", 'q"uote\ttab'), ("bb19", "a/c.txt"), ("bb19", "café.txt"), ("8ee4", "sp ace.txt"),
         ("435f", "sp ace.txt"), ("901f", "a/c.txt"), ("901f", "café.txt")}


@pytest.mark.parametrize("split", ["128m", "64"])
def test_log(spark, tmp_path, split):
    (tmp_path / "tool.log").write_text(LOG)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        commits, patches = read_history(spark, str(tmp_path / "tool.log"))
        rows = {r.commit_hash[:4]: r for r in commits.collect()}
        files = patches.collect()
        lines = {(r.commit_hash[:4], r.file_path, r.line_no, r.line) for r in diff_lines(patches).collect()}
        assert commits.rdd.getNumPartitions() > (20 if split == "64" else 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(rows) == {"fa5c", "bb19", "8ee4", "435f", "901f", "01bc"} and {r.repository for r in rows.values()} == {"tool"}
    assert rows["901f"].message == "first\n\n  indented body\n\ncommit not a commit\nlast" and rows["8ee4"].message == "merged"
    assert rows["01bc"].author == "Nobody" and rows["01bc"].message == "" and rows["01bc"].commit_date is None
    assert rows["fa5c"].commit_date == datetime.datetime(2026, 12, 4, 5, 48, 4) and rows["fa5c"].author == "Ann Lee <a@x>"
    assert {(r.commit_hash[:4], r.file_path) for r in files} == PATHS and len(files) == len(PATHS)
    assert lines == {("fa5c", 'q"uote\ttab', 1, 'quo"te'), ("8ee4", "sp ace.txt", 1, "both"), ("435f", "sp ace.txt", 3, "side"),
                     ("901f", "café.txt", 2, "z"), ("901f", "café.txt", 3, "++ plus")}


def test_repositories(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"repository={name}").mkdir()
        (tmp_path / f"repository={name}" / "log.txt").write_text(LOG)
    (tmp_path / "repository=b" / "empty.txt").write_text("")
    commits, patches = read_history(spark, str(tmp_path))
    assert {tuple(r) for r in commits.groupBy("repository").count().collect()} == {("a", 6), ("b", 6)}
    named, _ = read_history(spark, str(tmp_path), F.lit("one"))
    assert {r.repository for r in named.collect()} == {"one"}
    assert scan(commits, patches, default_rules()).count() == 0


def test_dates(spark):
    want = datetime.datetime(2026, 12, 4, 6, 8, 9)
    texts = ["Fri Dec 4 06:08:09 2026 +0000", "Fri Dec 04 07:08:09 2026 +0100", "2026-12-04 01:08:09 -0500", "2026-12-04T06:08:09Z",
             "2026-12-04T08:08:09+02:00", "1796364489 +0300", "1796364489", "Fri, 4 Dec 2026 06:08:09 +0000"]
    rows = spark.createDataFrame([(t,) for t in [*texts, "yesterday", None]], "t string").select(commit_date(F.col("t")).alias("d")).collect()
    assert [r.d for r in rows] == [want] * len(texts) + [None, None]


def test_paths(spark):
    quoted = {r'"a\\b"': "a\\b", r'"\360\237\230\200\001"': "😀\x01", '"': '"', '""': "", "plain \\x": "plain \\x", r'"é\n"': "é\n"}
    rows = spark.createDataFrame([(q,) for q in quoted], "q string").select(unquoted(F.col("q")).alias("p")).collect()
    assert [r.p for r in rows] == list(quoted.values())
    diffs = {"diff --git x y\n--- x\n+++ y\n@@ -1 +1 @@\n++++ b/z": "y", "diff --git a b\nold mode 1": None, "diff --git same same\nold mode 1": "same"}
    rows = spark.createDataFrame([(d,) for d in diffs], "d string").select(file_path(F.col("d"), prefixes=False).alias("p")).collect()
    assert [r.p for r in rows][0::2] == ["y", "same"]

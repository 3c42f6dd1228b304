"""Patches, messages and files as scannable units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift import schemas
from keysift.operators.joins import may_match

# A merge has a hunk of several parents: one more @, and one more column, for each.
HUNK = r"^@(@+)(?: -\d+(?:,\d+)?)+ \+(\d+)(?:,\d+)? @@+"
# UNIX_LINES and MULTILINE: ^ only after a newline
BEFORE_HUNK = r"(?dm)(?=^@@+(?: -\d+(?:,\d+)?)+ \+\d+(?:,\d+)? @@+)"


def added_lines(patch: Column) -> Column:
    """``array<array<struct<line_no, line>>>``: per hunk, its added lines.

    Without the removed lines and the no-newline marker, the lines after a hunk
    header are the new file's lines in a row, so a line's number is the hunk's
    start plus its position. A line of a merge is removed if one of its columns has a minus, and
    added if one has a plus: it differs from that parent. No window over the lines, hence no shuffle of the text.
    """
    hunks = F.filter(F.split(patch, BEFORE_HUNK), lambda h: F.regexp_like(h, F.lit(HUNK)))
    # the header is read here, once per hunk; below it would be read for each line
    parsed = F.transform(hunks, lambda h: F.struct(
        F.regexp_extract(h, HUNK, 2).cast("int").alias("start"),
        F.length(F.regexp_extract(h, HUNK, 1)).alias("parents"),
        F.slice(F.split(h, "\n"), 2, F.length(h) + 1).alias("lines")))
    parsed = F.transform(parsed, lambda p: F.struct(
        p["start"].alias("start"), p["parents"].alias("parents"),
        F.filter(p["lines"], lambda x: ~(x.substr(F.lit(1), p["parents"]).contains("-") | x.startswith("\\"))).alias("new_file")))

    def added(p: Column) -> Column:
        numbered = F.transform(p["new_file"], lambda x, i: F.struct(
            (p["start"] + i).alias("line_no"), x.alias("line")))
        added = F.filter(numbered, lambda x: x["line"].substr(F.lit(1), p["parents"]).contains("+"))
        return F.transform(added, lambda x: F.struct(
            x["line_no"].alias("line_no"),
            x["line"].substr(p["parents"] + 1, F.length(x["line"])).alias("line")))

    return F.transform(parsed, added)


def with_origin(patches: DataFrame) -> DataFrame:
    """A patch of no known origin counts as part of its commit."""
    return patches.withColumn("origin", F.coalesce("origin", F.lit("commit")))


def diff_lines(patches: DataFrame) -> DataFrame:
    """One row per added line of a diff, with its line number in the new file."""
    keys = ["repository", "commit_hash", "origin", "file_path"]
    return (with_origin(patches).where(F.col("origin") != "untracked")
            .select(*keys, F.posexplode(added_lines(F.col("patch"))).alias("_hunk", "_lines"))
            .select(*keys, (F.col("_hunk") + 1).alias("hunk_no"), F.inline("_lines")))


def patch_units(patches: DataFrame) -> DataFrame:
    """Units of patches that carry commit_rank, author and date: one per hunk with
    added lines, and one per untracked file, whose ``patch`` is the whole file."""
    keys = ["repository", "commit_hash", "commit_rank", "origin", "file_path", "author", "date"]
    whole_file = F.struct(
        F.col("patch").alias("text"), F.lit(None).cast("array<int>").alias("line_nos"))
    per_hunk = F.transform(
        F.filter(added_lines(F.col("patch")), lambda a: F.size(a) > 0),
        lambda a: F.struct(F.array_join(a["line"], "\n").alias("text"), a["line_no"].alias("line_nos")))
    units = F.when(F.col("origin") == "untracked", F.array(whole_file)).otherwise(per_hunk)
    return patches.select(*keys, F.inline(units)).where(F.col("text").isNotNull())


def message_units(window: DataFrame) -> DataFrame:
    """The messages of the commits in the window."""
    return window.where(F.col("message").isNotNull()).select(
        "repository", "commit_hash", "commit_rank",
        F.lit("message").alias("origin"), F.lit(schemas.MESSAGE_PATH).alias("file_path"),
        "author", date_string(F.col("commit_date")).alias("date"),
        F.col("message").alias("text"), F.lit(None).cast("array<int>").alias("line_nos"))


def date_string(ts: Column) -> Column:
    """yyyy-mm-ddThh:mm:ss; a timestamp without zone is never shifted."""
    return F.replace(F.substring(ts.cast("string"), 1, 19), F.lit(" "), F.lit("T"))


def windowed_patches(patches: DataFrame, window: DataFrame) -> DataFrame:
    """The patches to scan with commit_rank, author and date: those of commits in
    the window, and everything not committed yet (rank 0, no author or date).

    Patches of other commits are dropped before the join, so their texts are not shuffled;
    a commit with very many patches is split by Spark's skew join."""
    patches = with_origin(patches)
    committed = F.col("origin") == "commit"
    key = ["repository", "commit_hash"]
    about = window.select("repository", "commit_hash", "commit_rank", "author",
                          date_string(F.col("commit_date")).alias("date"))
    of_commits = may_match(patches.where(committed), window, key).join(about, key)
    local = patches.where(~committed).select(
        "*", F.lit(0).alias("commit_rank"),
        F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("date"))
    return of_commits.unionByName(local.withColumn("commit_hash", F.lit(schemas.UNCOMMITTED)))


def scan_units(commits_window: DataFrame, patches: DataFrame) -> DataFrame:
    """Diffs, messages, and working-tree changes of all repositories as units."""
    return patch_units(windowed_patches(patches, commits_window)).unionByName(
        message_units(commits_window))


def text_units(df: DataFrame, repository: Column, file_path: Column, text: Column, *carry: str) -> DataFrame:
    """Rows of a plain corpus as units: whole texts, nothing committed. ``carry`` names further columns to keep."""
    return df.select(
        repository.cast("string").alias("repository"),
        F.lit(schemas.UNCOMMITTED).alias("commit_hash"), F.lit(0).alias("commit_rank"),
        F.lit("untracked").alias("origin"), file_path.cast("string").alias("file_path"),
        F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("date"),
        text.alias("text"), F.lit(None).cast("array<int>").alias("line_nos"), *carry)

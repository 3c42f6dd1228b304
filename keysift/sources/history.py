"""Commits and patches from a history as text, as ``log -p`` prints it.

A record is what stands between two lines that begin with ``commit``: messages are indented and
lines of a diff have a mark, so no other line begins so. With that as the line separator, Spark's text source splits
a file of any size at records, and everything else is column expressions on one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "\ncommit "
HASH = r"^(?:commit )?([0-9a-f]{7,64})\b"
# what --source prints after the hash: the ref that led to the commit, here one of a remote
SOURCE = r"^(?:commit )?[0-9a-f]{7,64}\trefs/remotes/([^/\s]+)/"
# UNIX_LINES and MULTILINE: ^ and $ at newlines only
BEFORE_DIFF = r"(?dm)(?=^diff --(?:git|cc|combined) )"
#: Date formats, after the weekday is taken off; ISO 8601 and seconds since 1970 besides.
DATES = ["MMM d HH:mm:ss yyyy Z", "yyyy-MM-dd HH:mm:ss Z", "d MMM yyyy HH:mm:ss Z"]


def _line(text: Column, start: str) -> Column:
    """The rest of the first line that begins with ``start`` (a regex); null without one."""
    found = F.regexp_extract(text, f"(?dm)^{start}(.*)$", 1)
    return F.when(F.regexp_like(text, F.lit(f"(?dm)^{start}")), found)


def commit_date(text: Column) -> Column:
    """A printed date in UTC, without a zone; null if it is none of the known formats."""
    plain = F.trim(F.regexp_replace(text, r"^[A-Za-z]{3},? ", ""))
    seconds = F.regexp_extract(plain, r"^(\d+)(?: [+-]\d{4})?$", 1)
    parsed = F.coalesce(
        F.timestamp_seconds(F.when(seconds != "", seconds).cast("long")),
        *[F.try_to_timestamp(plain, F.lit(f)) for f in DATES], F.try_to_timestamp(plain))
    return F.to_utc_timestamp(parsed, F.current_timezone()).cast("timestamp_ntz")


def unquoted(path: Column) -> Column:
    r"""A path as it is: one in quotes has its escapes resolved, ``\303\251`` by bytes."""
    named = {"n": "0A", "t": "09", "r": "0D", "a": "07", "b": "08", "f": "0C", "v": "0B"}
    inner = path.substr(F.lit(2), F.length(path) - 2)

    def code(token: Column) -> Column:
        octal = F.lpad(F.hex(F.conv(token.substr(2, 3), 8, 10).cast("long")), 2, "0")
        out = F.when(F.regexp_like(token, F.lit(r"^\\[0-3][0-7]{2}$")), octal)
        for letter, value in named.items():
            out = out.when(token == "\\" + letter, F.lit(value))
        out = out.when(token.startswith("\\"), F.hex(F.encode(token.substr(F.lit(2), F.length(token)), "UTF-8")))
        return out.otherwise(F.hex(F.encode(token, "UTF-8")))

    tokens = F.regexp_extract_all(inner, F.lit(r"\\[0-3][0-7]{2}|\\.|[^\\]+"), F.lit(0))
    clean = F.decode(F.unhex(F.array_join(F.transform(tokens, code), "")), "UTF-8")
    return F.when(path.startswith('"') & path.endswith('"') & (F.length(path) > 1), clean).otherwise(path)


def file_path(diff: Column, prefixes: bool = True) -> Column:
    """The file that a diff is about: its new name, or the old one of a deleted file."""
    head = F.substring_index(diff, "\n@@", 1)

    def side(mark: str) -> Column:
        path = unquoted(F.regexp_replace(_line(head, mark), "\t$", ""))
        bare = F.regexp_replace(path, "^[a-z]/", "") if prefixes else path
        return F.when(path != "/dev/null", bare)

    # without contents, both names are alike in the first line, or the new one has a line of its own
    both = F.regexp_extract(head, r"(?d)^diff --git (.*)", 1)
    half = both.substr(F.lit(1), ((F.length(both) - 1) / 2).cast("int"))
    same = unquoted(half)
    combined = F.regexp_extract(head, r"(?d)^diff --(?:cc|combined) (.*)", 1)
    return F.coalesce(
        side(r"\+\+\+ "), side("--- "), unquoted(_line(head, "(?:rename|copy) to ")),
        F.when(combined != "", unquoted(combined)), F.when(both != "", F.regexp_replace(same, "^[a-z]/", "") if prefixes else same))


def source_repository() -> Column:
    """The repository of a record by the ref that ``--source`` prints, ``refs/remotes/<repository>/…``; null without one. For
    files with the logs of many repositories: a file each would cost more than its text."""
    name = F.regexp_extract("value", SOURCE, 1)
    return F.when(name != "", name)


def _records(spark: SparkSession, path: str, repository: Column | None) -> DataFrame:
    rows = spark.read.option("lineSep", SEPARATOR).text(path)
    if repository is None:
        name = F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
        repository = F.col("repository").cast("string") if "repository" in rows.columns else name
    return rows.select(repository.alias("repository"), F.regexp_extract("value", HASH, 1).alias("commit_hash"),
                       F.split("value", BEFORE_DIFF).alias("parts")).where("commit_hash <> ''")


def read_history(spark: SparkSession, path: str, repository: Column | None = None,
                 prefixes: bool = True) -> tuple[DataFrame, DataFrame]:
    """The commits and the patches of histories as text: of files, or of folders ``repository=…``.

    ``repository`` is a column over the files (``_metadata``) or a record's text (``value``, see ``source_repository``); by default the partition of that name, else the file's name
    without its ending. ``prefixes`` tells that paths begin with ``a/`` and ``b/``. A commit that is printed once for each
    parent has a row for each; text before the first commit is left out. Dates are in UTC. A file
    is split between records; one commit's text is one row.
    """
    records = _records(spark, path, repository)
    head = F.element_at("parts", 1)
    # what follows the headers, its indented and its empty lines
    lines = F.filter(F.split(F.regexp_extract(head, r"(?s)\n\n(.*)$", 1), "\n"), lambda x: x.startswith("    ") | (x == ""))
    message = F.regexp_replace(F.array_join(F.transform(lines, lambda x: x.substr(F.lit(5), F.length(x))), "\n"), r"\n+$", "")
    commits = records.select(
        "repository", "commit_hash", F.trim(_line(head, "Author:")).alias("author"),
        commit_date(F.trim(_line(head, "(?:Author)?Date:"))).alias("commit_date"), message.alias("message"))
    diffs = records.select("repository", "commit_hash", F.explode(F.slice("parts", 2, F.size("parts"))).alias("patch"))
    patches = diffs.select("repository", "commit_hash", F.lit("commit").alias("origin"),
                           file_path(F.col("patch"), prefixes).alias("file_path"), "patch")
    return commits, patches

"""The commit window: the last N commits of each repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 64


def last_n(commits: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` commits per repository with ``commit_rank`` from 1. A commit that is listed
    more than once, as one of several branches, counts once.

    A repository is first cut down in SALTS independent parts, so that a hot one does not
    sit in one task whole; then at most SALTS times ``n`` rows are ranked together.
    """
    newest = (F.col("commit_date").desc_nulls_last(), F.col("commit_hash"))
    part = W.partitionBy("repository", "_part").orderBy(*newest)
    columns = commits.columns
    # copies of a commit have its rank, and are in its part
    cut = (commits.withColumn("_part", F.pmod(F.xxhash64("commit_hash"), F.lit(SALTS)))
           .withColumn("_part_rank", F.dense_rank().over(part))
           .where(F.col("_part_rank") <= n))
    copy = W.partitionBy("repository", "_part", "commit_hash").orderBy(F.col("commit_date").desc_nulls_last())
    once = cut.withColumn("_copy", F.row_number().over(copy)).where("_copy = 1").select(*columns)
    rank = F.row_number().over(W.partitionBy("repository").orderBy(*newest))
    return once.withColumn("commit_rank", rank).where(F.col("commit_rank") <= n)

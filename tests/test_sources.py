import pytest

from keysift import schemas
from keysift.functions.levels import score
from keysift.operators.rules import default_rules
from keysift.session import shared_dir
from keysift.sources.tables import read_commits, read_patches, read_responses
from keysift.streaming.scan import stream_findings, stream_table, write_stream
from tests.test_rules import POSITIVE

RULES = default_rules()


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_readers(spark, tmp_path, fmt):
    patches = spark.createDataFrame([("r", "c", "commit", "f", "@@ -1 +1 @@\n+x")], schemas.PATCHES)
    patches.write.format(fmt).save(str(tmp_path / "patches"))
    assert read_patches(spark, str(tmp_path / "patches"), fmt).collect() == patches.collect()
    commits = spark.createDataFrame([("r", "c", None, None, "m")], schemas.COMMITS)
    commits.write.format(fmt).save(str(tmp_path / "commits"))
    assert read_commits(spark, str(tmp_path / "commits"), fmt).collect() == commits.collect()
    responses = spark.createDataFrame([("k", "[]")], schemas.RESPONSES)
    responses.write.format(fmt).save(str(tmp_path / "responses"))
    assert read_responses(spark, str(tmp_path / "responses"), fmt).collect() == responses.collect()


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_stream(spark, units, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    texts = [POSITIVE["aws_access_key"], POSITIVE["npm_token"], "nothing"]

    def run():
        stream = spark.readStream.schema(schemas.UNITS).parquet(source)
        write_stream(stream_findings(stream, RULES), out, checkpoint).awaitTermination()
        return spark.read.parquet(out)

    units(*texts).write.parquet(source)
    assert {r.snippet for r in run().collect()} == {"AKIA...", "0123..."}
    assert run().count() == 2  # nothing new
    units(POSITIVE["stripe_key"], repository="s").write.mode("append").parquet(source)
    assert {r.snippet for r in run().collect()} == {"AKIA...", "0123...", "sk_l..."}
    units(*texts).write.mode("append").parquet(source)
    assert run().count() == 5 and stream_table(spark, out).count() == 3  # found again in another batch


def test_stream_drops_repeats_in_time(spark, units, tmp_path):
    from pyspark.sql import functions as F
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    df = units(POSITIVE["aws_access_key"]).withColumn("arrived", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    for _ in range(2):
        df.write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        found = stream_findings(stream, RULES, arrival="arrived")
        write_stream(found, out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 1


def test_score_is_exact(spark):
    from pyspark.sql import functions as F
    row = spark.range(1).select(score(F.lit("0.2").cast("decimal(3,2)"), F.lit(True)).alias("s"))
    assert dict(row.dtypes)["s"] == "decimal(3,2)" and str(row.first().s) == "0.80"

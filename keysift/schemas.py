"""Fixed schemas of the relations keysift reads and writes."""

from pyspark.sql import types as T

UNCOMMITTED = "uncommitted"
MESSAGE_PATH = "COMMIT_MESSAGE"

RULES = T.StructType([
    T.StructField("rule_ord", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("regex", T.StringType(), True),
    T.StructField("keywords", T.ArrayType(T.StringType(), False), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("confidence_boost", T.DecimalType(3, 2), False),
])

COMMITS = T.StructType([
    T.StructField("repository", T.StringType(), False),
    T.StructField("commit_hash", T.StringType(), False),
    T.StructField("author", T.StringType(), True),
    T.StructField("commit_date", T.TimestampNTZType(), True),
    T.StructField("message", T.StringType(), True),
])

PATCHES = T.StructType([
    T.StructField("repository", T.StringType(), False),
    T.StructField("commit_hash", T.StringType(), False),
    T.StructField("origin", T.StringType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("patch", T.StringType(), True),
])

# One scannable text; line_nos[i] is the file line of text line i (null: i + 1).
UNITS = T.StructType([
    T.StructField("repository", T.StringType(), False),
    T.StructField("commit_hash", T.StringType(), False),
    T.StructField("commit_rank", T.IntegerType(), False),
    T.StructField("origin", T.StringType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("author", T.StringType(), True),
    T.StructField("date", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
    T.StructField("line_nos", T.ArrayType(T.IntegerType()), True),
])

FINDINGS = T.StructType([
    T.StructField("repository", T.StringType(), False),
    T.StructField("commit_hash", T.StringType(), False),
    T.StructField("commit_rank", T.IntegerType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("line_number", T.IntegerType(), True),
    T.StructField("snippet", T.StringType(), False),
    T.StructField("finding_type", T.StringType(), False),
    T.StructField("confidence", T.StringType(), False),
    T.StructField("rationale", T.StringType(), False),
    T.StructField("author", T.StringType(), True),
    T.StructField("date", T.StringType(), True),
    T.StructField("is_uncommitted", T.BooleanType(), False),
    T.StructField("detector", T.StringType(), False),
    T.StructField("secret_sha256", T.StringType(), False),
])

RESPONSES = T.StructType([
    T.StructField("cache_key", T.StringType(), False),
    T.StructField("response", T.StringType(), False),
])

ANSWERS = T.ArrayType(T.StructType([
    T.StructField("line", T.IntegerType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("rationale", T.StringType()),
]))

REPORT_FINDING = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("finding_type", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("rationale", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("is_uncommitted", T.BooleanType()),
])

REPORT = T.StructType([
    T.StructField("scan_info", T.StructType([
        T.StructField("repository", T.StringType()),
        T.StructField("commits_scanned", T.LongType()),
        T.StructField("total_findings", T.LongType()),
        T.StructField("high_confidence", T.LongType()),
        T.StructField("medium_confidence", T.LongType()),
        T.StructField("low_confidence", T.LongType()),
    ])),
    T.StructField("findings_by_commit",
                  T.MapType(T.StringType(), T.ArrayType(REPORT_FINDING))),
    T.StructField("summary", T.StructType([
        T.StructField("finding_types", T.MapType(T.StringType(), T.LongType())),
    ])),
])

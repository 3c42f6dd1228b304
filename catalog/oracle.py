"""What each registered query computes, as SQL for DuckDB on the same tables.

The SQL takes other ways than the engine where it can: line numbers come from the text
before a match, diff lines from running sums, de-duplication from row_number.
"""

from __future__ import annotations

from catalog import inputs
from catalog.queries import FINDING, MODEL, PIN_RULE, RULES, TOKEN_RULE
from keysift.functions.redact import ASSIGNMENT
from keysift.operators.prompts import AFTER_CONTENT, BEFORE_CONTENT, BEFORE_RULES
from keysift.operators.rules import Rule, RuleSet
from keysift.plans import sarif


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def nl(expr: str) -> str:
    """Newlines in a text."""
    return f"(length({expr}) - length(replace({expr}, chr(10), '')))"


def with_(*ctes: tuple[str, str], select: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes) + "\n" + select


PLANTED = ("planted", inputs.PLANTED)
PLANTED_UNITS = ("u", """
SELECT source AS repository, 'uncommitted' AS commit_hash, 0 AS commit_rank, CAST(doc_id AS VARCHAR) AS file_path,
       NULL::VARCHAR AS author, NULL::VARCHAR AS date, t, NULL::INTEGER[] AS line_nos FROM planted""")
DOCUMENT_UNITS = ("u", """
SELECT source AS repository, 'uncommitted' AS commit_hash, 0 AS commit_rank, CAST(doc_id AS VARCHAR) AS file_path,
       NULL::VARCHAR AS author, NULL::VARCHAR AS date, text AS t, NULL::INTEGER[] AS line_nos FROM documents""")


def hits(rules: RuleSet | list[Rule]) -> list[tuple[str, str]]:
    """CTEs from ``u`` to ``located``: every match with its rule, line and keyword flag."""
    per_rule = "\nUNION ALL\n".join(
        f"""SELECT u.*, {i} AS rule_ord, {q(r.name)} AS rule, CAST({r.confidence_boost} AS DECIMAL(3,2)) AS boost,
       {q(r.description)} AS descr, {list(r.keywords)} AS kws,
       string_split_regex(t, {q(r.regex)}) AS p, regexp_extract_all(t, {q(r.regex)}, 0) AS g
FROM u WHERE regexp_matches(t, {q(r.regex)})"""
        for i, r in enumerate(rules))
    before = "array_to_string(p[1:i], '')"
    done = "array_to_string(g[1:i-1], '')"
    return [
        ("h", per_rule),
        ("m", "SELECT *, unnest(range(1, len(g) + 1)) AS i FROM h"),
        ("s", f"SELECT *, g[i] AS match, 1 + {nl(before)} + {nl(done)} AS start FROM m"),
        ("k", f"""SELECT *, lower(array_to_string(string_split(t, chr(10))[start:start + {nl('match')}], chr(10))) AS seg
FROM s"""),
        ("located", f"""
SELECT repository, commit_hash, commit_rank, file_path, author, date, rule_ord, rule, boost, descr, match, i,
       CAST(coalesce(line_nos[start], start) AS INTEGER) AS line_number, CAST({nl('match')} + 1 AS INTEGER) AS n_lines,
       len(list_filter(kws, lambda w: contains(seg, w))) > 0 AS kw FROM k"""),
        ("f", """
SELECT repository, commit_hash, commit_rank, file_path, line_number, match AS snippet, rule AS finding_type,
       CASE WHEN score >= 0.80 THEN 'high' WHEN score >= 0.60 THEN 'medium' ELSE 'low' END AS confidence,
       descr AS rationale, author, date, commit_hash = 'uncommitted' AS is_uncommitted, 'regex' AS detector,
       sha256(match) AS secret_sha256
FROM (SELECT *, 0.50 + boost + CASE WHEN kw THEN 0.10 ELSE 0.00 END AS score FROM located)"""),
    ]


REDACTED = f"""CASE WHEN regexp_matches(snippet, {q(ASSIGNMENT)})
  THEN regexp_replace(snippet, {q(ASSIGNMENT)}, '\\1...')
  WHEN length(snippet) > 4 THEN substr(snippet, 1, 4) || '...' ELSE '...' END"""
COLUMNS = ", ".join(FINDING)
REDACTED_COLUMNS = COLUMNS.replace("snippet", f"{REDACTED} AS snippet")


def planted(select: str, *more: tuple[str, str]) -> str:
    return with_(PLANTED, PLANTED_UNITS, *hits(RULES), *more, select=select)


# --- documents

def typed(name: str) -> str:
    return f"""array_to_string(list_transform(string_split(replace({name}, '_', ' '), ' '),
  lambda w: upper(w[1]) || w[2:]), ' ')"""


COUNTS = """SELECT repository, count(*) AS total_findings,
  count(*) FILTER (confidence = 'high') AS high_confidence,
  count(*) FILTER (confidence = 'medium') AS medium_confidence,
  count(*) FILTER (confidence = 'low') AS low_confidence FROM f GROUP BY repository"""
FIRST = "CASE WHEN row_number() OVER (PARTITION BY repository ORDER BY {}) = 1 THEN '' ELSE ',' END"
BY_ITEM = "file_path, line_number, finding_type, secret_sha256"

FIRST_COMMIT = "CASE WHEN row_number() OVER (PARTITION BY repository ORDER BY commit_rank, commit_hash) = 1 THEN '' ELSE ',' END"
FIRST_ITEM = ("CASE WHEN row_number() OVER (PARTITION BY repository, commit_rank, commit_hash ORDER BY "
              "file_path, line_number, finding_type, secret_sha256) = 1 THEN '' ELSE ',' END")
REPORT_LINES = f"""
SELECT repository, 0 AS block, 0 AS part, '{{"scan_info":' || json_object('repository', repository,
  'commits_scanned', 0, 'total_findings', total_findings, 'high_confidence', high_confidence,
  'medium_confidence', medium_confidence, 'low_confidence', low_confidence)::VARCHAR
  || ',"findings_by_commit":{{' AS line FROM c
UNION ALL SELECT repository, 1, 0, {FIRST_COMMIT} || '"' || commit_hash || '":[' FROM rk
UNION ALL SELECT repository, 1, 1, {FIRST_ITEM} || json_object('file_path', file_path,
  'line_number', line_number, 'snippet', snippet, 'finding_type', finding_type, 'confidence', confidence,
  'rationale', rationale, 'author', author, 'date', date, 'is_uncommitted', is_uncommitted)::VARCHAR FROM r
UNION ALL SELECT repository, 1, 2, ']' FROM rk
UNION ALL SELECT repository, 2, 0, '}},"summary":{{"finding_types":{{' FROM c
UNION ALL SELECT repository, 3, 0, {FIRST.format('finding_type')} || '"' || finding_type || '":' || n
  FROM (SELECT repository, finding_type, count(*) AS n FROM r GROUP BY ALL)
UNION ALL SELECT repository, 4, 0, '}}}}}}' FROM c"""

TEXT = "json_object('text', {})"
RULE_JSON = f"""json_object('id', id, 'name', {typed('id')}, 'shortDescription', {TEXT.format("'Detects ' || w")},
  'fullDescription', {TEXT.format("'This rule identifies potential ' || w || ' in the codebase.'")},
  'help', {TEXT.format(q(sarif.RULE_HELP))}, 'defaultConfiguration', json_object('level', 'error'),
  'properties', json_object('tags', ['security', 'secrets'], 'precision', 'high'))::VARCHAR"""
LEVEL = "CASE lower(confidence) WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END"


def result_json(rule: str, message: str, commit: str, author: str, date: str) -> str:
    return f"""json_object('ruleId', {rule}, 'level', {LEVEL}, 'message', {TEXT.format(message)},
  'locations', [json_object('physicalLocation', json_object(
     'artifactLocation', json_object('uri', file_path, 'uriBaseId', 'SRCROOT'),
     'region', json_object('startLine', line_number, 'snippet', {TEXT.format('snippet')})))],
  'partialFingerprints', json_object('commitHash', {commit}),
  'properties', json_object('confidence', confidence, 'commit', {commit}, 'author', {author}, 'date', {date}))::VARCHAR"""


SARIF_HEAD = (f'{{"$schema":"{sarif.SCHEMA_URL}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"keysift",'
              '"informationUri":"https://example.com/keysift","version":"1.0.0","rules":[')
SHORT = "CASE WHEN commit_hash = 'uncommitted' THEN commit_hash ELSE substr(commit_hash, 1, 8) END"


def sarif_lines(results: str, order: str, rule: str, message: str) -> str:
    return f"""
SELECT repository, 0 AS block, {q(SARIF_HEAD)} AS line FROM c
UNION ALL SELECT repository, 1, {FIRST.format('id')} || {RULE_JSON}
  FROM (SELECT DISTINCT repository, {rule} AS id, replace({rule}, '_', ' ') AS w FROM {results})
UNION ALL SELECT repository, 2, ']}}}},"results":[' FROM c
UNION ALL SELECT repository, 3, {FIRST.format(order)} || {result_json(
        rule, message, SHORT, "coalesce(author, 'unknown')", "coalesce(date, 'unknown')")} FROM {results}
UNION ALL SELECT repository, 4, ']}}]}}' FROM c"""


# A report of each document, read back: a finding in each line, the last one also uncommitted.


def report_rows(repository: str) -> list[tuple[str, str]]:
    kind = "CASE n % 3 WHEN 0 THEN 'api_key' WHEN 1 THEN 'weird kind' END"
    rest = "'High' AS confidence, NULL::VARCHAR AS rationale, 'a' AS author, NULL::VARCHAR AS date"
    return [PLANTED, ("ls", f"""
SELECT doc_id, CAST({repository} AS VARCHAR) AS repository, CAST(doc_id AS VARCHAR) AS report,
       'docs/' || doc_id AS file_path, string_split(t, chr(10)) AS ls FROM planted"""), ("rows", f"""
SELECT repository, report, 0 AS commit_ord, md5(CAST(doc_id AS VARCHAR)) AS commit_hash, CAST(n - 1 AS INTEGER) AS finding_ord,
  file_path, CAST(n AS INTEGER) AS line_number, ls[n] AS snippet, {kind} AS finding_type, {rest}
FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS n FROM ls)
UNION ALL
SELECT repository, report, 1, 'uncommitted', 0, file_path, CAST(len(ls) AS INTEGER), ls[len(ls)],
  {kind.replace('n %', 'len(ls) %')}, 'High', NULL, 'a', NULL FROM ls""")]


# --- the text model


def chunked(table: str, key: str, text: str, size: int, name: str = "ch") -> tuple[str, str]:
    return (name, f"""
SELECT *, CAST(off // {size} AS INTEGER) AS chunk_no, substr(text, off + 1, {size}) AS content,
       CAST(1 + {nl('substr(text, 1, off)')} AS INTEGER) AS start_line
FROM (SELECT CAST({key} AS VARCHAR) AS file_path, {text} AS text, * EXCLUDE ({text}),
             unnest(range(0, greatest(length({text}), 1), {size})) AS off FROM {table})""")


def braced_chunks() -> list[tuple[str, str]]:
    """Slices of 2048 characters, those too long with doubled braces in parts of 1500."""
    doubled = "length(content) + len(regexp_extract_all(content, '[{}]'))"
    return [("braced", inputs.BRACED), chunked("braced", "page_id", "t", 2048, "whole"), ("ch", f"""
SELECT 'web' AS source, file_path, substr(content, cut + 1, size) AS content,
       start_line + {nl('substr(content, 1, cut)')} AS start_line
FROM (SELECT *, unnest(range(0, greatest(length(content), 1), size)) AS cut FROM (
  SELECT *, CASE WHEN {doubled} > 3000 THEN 1500 ELSE 2048 END AS size FROM whole))""")]


DOC_CHUNKS = chunked("documents", "doc_id", "text", 2048)
PAGE_CHUNKS = chunked("pages", "page_id", "html", 2048)
KEY = (f"sha256(concat_ws(chr(0), {q(MODEL.model)}, {q(MODEL.options_text())}, {q(RULES.digest())}, content))")


def clamped(content: str) -> str:
    return f"substr(replace(replace(substr({content}, 1, 3000), '{{', '{{{{'), '}}', '}}}}'), 1, 3000)"


CHUNK_LINES = ("cl", """
SELECT source AS repository, file_path, start_line + unnest(range(0, len(ls))) AS line_number, unnest(ls) AS line
FROM (SELECT *, string_split(content, chr(10)) AS ls FROM ch)""")
MODEL_FINDINGS = ("mf", """
SELECT repository, 'uncommitted' AS commit_hash, 0 AS commit_rank, file_path,
       CAST(line_number AS INTEGER) AS line_number, line AS snippet, 'api_key' AS finding_type,
       'medium' AS confidence, 'Has token = ' AS rationale, NULL::VARCHAR AS author, NULL::VARCHAR AS date,
       true AS is_uncommitted, 'model' AS detector, sha256(line) AS secret_sha256
FROM cl WHERE contains(line, 'token = ')""")

# --- commits and diffs

COMMITS = ("commits", inputs.COMMITS)


def window(n: int) -> tuple[str, str]:
    return ("w", f"""
SELECT *, CAST(row_number() OVER (PARTITION BY repository ORDER BY commit_date DESC, commit_hash) AS INTEGER)
         AS commit_rank, strftime(commit_date, '%Y-%m-%dT%H:%M:%S') AS date
FROM commits QUALIFY commit_rank <= {n}""")


PATCH_KEY = "repository, commit_hash, file_path"
HEADER = r"regexp_matches(line, '^@@ -\d+(,\d+)? \+\d+(,\d+)? @@')"
DIFF = [
    ("patches", inputs.PATCHES),
    ("pl", f"""SELECT {PATCH_KEY}, origin, unnest(string_split(patch, chr(10))) AS line,
  generate_subscripts(string_split(patch, chr(10)), 1) AS pos FROM patches WHERE origin <> 'untracked'"""),
    ("ph", f"""SELECT *, CAST(sum(CASE WHEN {HEADER} THEN 1 ELSE 0 END)
  OVER (PARTITION BY {PATCH_KEY} ORDER BY pos) AS INTEGER) AS hunk_no FROM pl"""),
    ("pn", f"""SELECT *, max(CASE WHEN {HEADER} THEN CAST(regexp_extract(line, '\\+(\\d+)', 1) AS INTEGER) END)
  OVER (PARTITION BY {PATCH_KEY}, hunk_no)
  + sum(CASE WHEN {HEADER} OR line LIKE '-%' OR starts_with(line, chr(92)) THEN 0 ELSE 1 END)
  OVER (PARTITION BY {PATCH_KEY}, hunk_no ORDER BY pos) - 1 AS line_no FROM ph WHERE hunk_no > 0"""),
    ("added", "SELECT * REPLACE (substr(line, 2) AS line, CAST(line_no AS INTEGER) AS line_no) "
              "FROM pn WHERE line LIKE '+%'"),
]
UNITS = [COMMITS, window(10), *DIFF, ("hu", f"""
SELECT {PATCH_KEY}, origin, hunk_no, string_agg(line, chr(10) ORDER BY pos) AS t, list(line_no ORDER BY pos) AS line_nos
FROM added GROUP BY ALL"""), ("u", """
SELECT repository, commit_hash, commit_rank, origin, file_path, author, date, t, line_nos
FROM hu JOIN w USING (repository, commit_hash) WHERE origin = 'commit'
UNION ALL
SELECT repository, commit_hash, 0, origin, file_path, NULL, NULL, t, line_nos FROM hu WHERE origin <> 'commit'
UNION ALL
SELECT repository, commit_hash, 0, origin, file_path, NULL, NULL, patch, NULL FROM patches WHERE origin = 'untracked'
UNION ALL
SELECT repository, commit_hash, commit_rank, 'message', 'COMMIT_MESSAGE', author, date, message, NULL FROM w""")]
SCAN = [*UNITS, *hits(RULES), ("d", "SELECT DISTINCT * FROM f")]
SCANNED = ("r", f"SELECT * REPLACE ({REDACTED} AS snippet) FROM d")
MESSAGES = ("u", """SELECT repository, commit_hash, commit_rank, author, date, 'COMMIT_MESSAGE' AS file_path,
  message AS t, NULL::INTEGER[] AS line_nos FROM w""")

LINK_COUNTS = """
SELECT rule, sum(n)::BIGINT AS hits FROM (
  SELECT 'page_path' AS rule, len(regexp_extract_all(t, 'href="/[A-Za-z]+"', 0)) AS n FROM x
  UNION ALL SELECT rule, 1 FROM located) GROUP BY rule HAVING sum(n) > 0"""
OTHER_TEXTS = [("x", "SELECT html AS t FROM pages UNION ALL SELECT text FROM conversations"), ("u", """
SELECT '' AS repository, '' AS commit_hash, 0 AS commit_rank, '' AS file_path, '' AS author, '' AS date, t,
       NULL::INTEGER[] AS line_nos FROM x""")]

# Every match of rules that are rows of a table, on texts of column t.
RULE_VALUES = "SELECT *, unnest(regexp_extract_all(t, regex, 0)) AS match, generate_subscripts(regexp_extract_all(t, regex, 0), 1) AS i"
STREAMED = ("again", f"SELECT CAST(doc_id AS VARCHAR) AS file_path, doc_id AS first, last, {inputs.AGAIN.format(last='last')} AS second "
                     "FROM documents, (SELECT max(doc_id) AS last FROM documents)")
# A log prints whole seconds, and nothing that is not committed.
LOGGED = [(name, sql.replace("ts AS commit_date", "date_trunc('second', ts) AS commit_date") if name == "commits"
           else f"SELECT * FROM ({sql}) WHERE origin = 'commit'" if name == "patches" else sql) for name, sql in SCAN]

ORACLE = {
    "stream_summary": planted("""
SELECT repository, 0::BIGINT AS commits_scanned, total_findings, high_confidence, medium_confidence, low_confidence
FROM c""", ("e", "SELECT DISTINCT * FROM f"), ("c", COUNTS.replace("FROM f", "FROM e"))),
    "large_report": with_(*report_rows("source"), ("o", """
SELECT md5(CAST(doc_id AS VARCHAR)) AS commit_hash,
       CAST(2 * (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS INTEGER) AS commit_ord FROM documents"""), select="""
SELECT rows.* EXCLUDE (report) REPLACE (o.commit_ord AS commit_ord) FROM rows JOIN o USING (commit_hash)"""),
    "published_report": with_(*SCAN, SCANNED, select="""
SELECT repository, commit_hash, file_path, line_number, snippet, finding_type, confidence, rationale, author, date, is_uncommitted
FROM r"""),
    "lasting_cache": with_(
        DOCUMENT_UNITS, *hits(RULES.add(TOKEN_RULE)), (
            "ch0", DOC_CHUNKS[1]), ("ch", """
SELECT * FROM ch0 WHERE content NOT IN (SELECT content FROM ch0 WHERE doc_id IN (SELECT doc_id FROM labels))"""),
        CHUNK_LINES, MODEL_FINDINGS, select=f"""
SELECT {REDACTED_COLUMNS} FROM (SELECT DISTINCT * FROM (SELECT * FROM f UNION ALL SELECT * FROM mf))"""),
    "model_absent": with_(DOC_CHUNKS, select="""
SELECT source AS repository, count(*) AS failed_chunks, 'ProviderUnavailable: is_available() says no' AS error FROM ch GROUP BY 1"""),
    "model_half_absent": with_(DOC_CHUNKS, select="""
SELECT source AS repository, count(*) AS chunks, count(*) AS told FROM ch GROUP BY 1"""),
    "table_rule_hits": with_(PLANTED, ("rules", inputs.TABLE_RULES), select="""
SELECT name AS rule, sum(len(regexp_extract_all(t, regex, 0)))::BIGINT AS hits FROM planted, rules
GROUP BY name HAVING sum(len(regexp_extract_all(t, regex, 0))) > 0"""),
    "many_rule_values": planted("""
SELECT CAST(file_path AS BIGINT) AS doc_id, rule, CAST(i - 1 AS INTEGER) AS match_no, match FROM located
UNION ALL SELECT doc_id, name, CAST(i - 1 AS INTEGER), match FROM part_values""", ("rules", inputs.PART_RULES), ("part_values", f"""
{RULE_VALUES} FROM planted JOIN rules ON contains(lower(t), literal)""")),
    "stream_repository_scan": with_(*SCAN, select=f"""
SELECT repository, commit_hash, commit_rank, file_path, line_number, {REDACTED} AS snippet, finding_type,
       confidence, author, date, is_uncommitted, secret_sha256 FROM d"""),
    "stream_event_dedup": planted("""
SELECT DISTINCT repository, file_path, line_number, finding_type, secret_sha256,
       CASE WHEN second > last - 30 AND first <= last - 60 THEN 2 ELSE 1 END::BIGINT AS times
FROM f JOIN again USING (file_path)""", STREAMED),
    "history_dump_scan": with_(*LOGGED, select=f"""
SELECT repository, commit_hash, commit_rank, file_path, line_number, {REDACTED} AS snippet, finding_type,
       confidence, author, date, secret_sha256 FROM d"""),
    "rule_hits": planted("SELECT rule, count(*) AS hits FROM located GROUP BY rule"),
    "rule_hit_values": planted(
        "SELECT CAST(file_path AS BIGINT) AS doc_id, rule, CAST(i - 1 AS INTEGER) AS match_no, match FROM located"),
    "custom_rule_token": with_(DOCUMENT_UNITS, *hits(RULES.add(TOKEN_RULE)), select="""
SELECT repository, file_path, rule_ord, rule, CAST(i - 1 AS INTEGER) AS match_no, match FROM located"""),
    "raw_text_hits": with_(*OTHER_TEXTS, *hits(RULES), select=LINK_COUNTS),
    "findings_lines": planted("SELECT file_path, rule, line_number, n_lines, match FROM located"),
    "findings_scored": planted(f"SELECT {COLUMNS} FROM f"),
    "findings_redacted": planted(f"SELECT {REDACTED_COLUMNS} FROM f"),
    "findings_dedup": planted(f"""
SELECT {COLUMNS} FROM (SELECT * FROM f UNION ALL SELECT * FROM f UNION ALL
  SELECT * REPLACE ('model' AS detector, 'Looks like a secret' AS rationale,
    CASE length(snippet) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence) FROM f)
QUALIFY row_number() OVER (
  PARTITION BY repository, commit_hash, file_path, line_number, finding_type, secret_sha256
  ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, detector <> 'regex') = 1"""),
    "finding_rules": planted("""
SELECT file_path, rule AS finding_type, line_number, descr AS description, boost AS confidence_boost,
       array_to_string(kws, ',') AS keywords
FROM located JOIN (SELECT DISTINCT rule, kws FROM h) USING (rule)"""),
    "document_findings": with_(
        DOCUMENT_UNITS, *hits(RULES.add(TOKEN_RULE)), DOC_CHUNKS, CHUNK_LINES, MODEL_FINDINGS, select=f"""
SELECT {REDACTED_COLUMNS} FROM (SELECT DISTINCT * FROM (SELECT * FROM f UNION ALL SELECT * FROM mf))"""),
    "by_source": planted("""
SELECT repository, 0::BIGINT AS commits_scanned, total_findings, high_confidence, medium_confidence, low_confidence
FROM c""", ("c", COUNTS)),
    "finding_types": planted("SELECT repository, finding_type, count(*) AS findings FROM f GROUP BY ALL"),
    "findings_nested": with_(("planted", inputs.NESTED), PLANTED_UNITS, *hits(RULES.add(PIN_RULE)), select=f"""
SELECT file_path, line_number, finding_type, regexp_replace({REDACTED}, '(PIN[0-9])[0-9]{{5}}', '\\1...', 'g') AS snippet,
       secret_sha256 FROM f"""),
    "report_json": with_(*SCAN, SCANNED, ("c", COUNTS.replace("FROM f", "FROM r")), (
        "rk", "SELECT DISTINCT repository, commit_rank, commit_hash FROM r"), select=REPORT_LINES),
    "report_flatten": with_(*report_rows("doc_id"), select="SELECT * EXCLUDE (report) FROM rows"),
    "sarif_two_reports": with_(*report_rows("source"), ("c", "SELECT DISTINCT repository FROM rows"), select=sarif_lines(
        "rows", "report, commit_ord, finding_ord", "coalesce(finding_type, 'unknown')", "'Potential secret detected'")),
    "sarif_of_reports": with_(*report_rows("doc_id"), select=f"""
SELECT repository, commit_ord, finding_ord, {result_json(
        "coalesce(finding_type, 'unknown')", "'Potential secret detected'", SHORT, "author", "'unknown'")} AS result
FROM rows"""),
    "sarif_rules": planted(f"""
SELECT DISTINCT repository, finding_type AS id, {typed('finding_type')} AS title,
  'Detects ' || replace(finding_type, '_', ' ') AS short_text,
  'This rule identifies potential ' || replace(finding_type, '_', ' ') || ' in the codebase.' AS full_text,
  'error' AS level FROM f"""),
    "sarif_results": planted(f"""
SELECT repository, finding_type AS rule_id, {LEVEL} AS level, rationale AS message, file_path AS uri,
  line_number AS start_line, {REDACTED} AS snippet, {SHORT} AS commit, 'unknown' AS author FROM f"""),
    "sarif_json": with_(*SCAN, SCANNED, ("c", "SELECT DISTINCT repository FROM r"), select=sarif_lines(
        "r", f"commit_rank, commit_hash, {BY_ITEM}", "finding_type", "rationale")),
    "chunks": with_(DOC_CHUNKS, select="SELECT file_path, chunk_no, start_line, content FROM ch"),
    "page_chunks": with_(chunked("pages", "page_id", "html", 500),
                         select="SELECT file_path, chunk_no, start_line, content FROM ch"),
    "prompt_content": f"SELECT page_id, {clamped('repeat(html, 2)')} AS content FROM pages",
    "prompts": with_(PAGE_CHUNKS, select=f"""
SELECT file_path, chunk_no, {q(BEFORE_RULES + RULES.describe() + BEFORE_CONTENT)} || {clamped('content')}
  || {q(AFTER_CONTENT)} AS prompt FROM ch"""),
    "inference_distinct": with_(DOC_CHUNKS, select=f"SELECT {KEY} AS cache_key, count(*) AS copies FROM ch GROUP BY 1"),
    "cache_miss": with_(DOC_CHUNKS, select=f"""
SELECT {KEY} AS cache_key, count(*) AS copies FROM ch GROUP BY 1
HAVING {KEY.replace('content', 'any_value(content)')} NOT IN (
  SELECT {KEY} FROM ch WHERE doc_id IN (SELECT doc_id FROM labels))"""),
    "scan_with_cache": with_(
        DOCUMENT_UNITS, *hits(RULES.add(TOKEN_RULE)), (
            "ch0", DOC_CHUNKS[1]), ("ch", """
SELECT * FROM ch0 WHERE content NOT IN (SELECT content FROM ch0 WHERE doc_id IN (SELECT doc_id FROM labels))"""),
        CHUNK_LINES, MODEL_FINDINGS, select=f"""
SELECT {REDACTED_COLUMNS} FROM (SELECT DISTINCT * FROM (SELECT * FROM f UNION ALL SELECT * FROM mf))"""),
    "model_scan_braces": with_(*braced_chunks(), CHUNK_LINES, MODEL_FINDINGS, select="""
SELECT file_path, line_number, snippet FROM mf"""),
    "model_failures": with_(DOC_CHUNKS, select="""
SELECT source AS repository, count(*) AS failed_chunks, 'RuntimeError: refused' AS error
FROM ch WHERE contains(content, 'token = "') GROUP BY 1"""),
    "merge_diff_lines": """
SELECT source AS repository, md5(CAST(doc_id AS VARCHAR)) AS commit_hash, CAST(doc_id AS VARCHAR) AS file_path,
       1 AS hunk_no, CAST(10 + n AS INTEGER) AS line_no, ls[n] AS line
FROM (SELECT *, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)""",
    "cached_answers": with_(DOC_CHUNKS, select="""
SELECT source AS repository, file_path, chunk_no, 'token' AS type FROM ch WHERE contains(content, 'token = "')"""),
    "model_answers": with_(PAGE_CHUNKS, ("k", f"SELECT DISTINCT {KEY} AS cache_key, content FROM ch"),
                           ("kl", f"SELECT cache_key, string_split({clamped('content')}, chr(10)) AS ls FROM k"),
                           select=f"""
SELECT cache_key, copies, array_to_string(list_filter(range(1, len(ls) + 1),
  lambda i: contains(ls[i], '<script>')), ',') AS lines, NULL::VARCHAR AS error
FROM kl JOIN (SELECT {KEY} AS cache_key, count(*) AS copies FROM ch GROUP BY 1) USING (cache_key)"""),
    "model_parse": with_(("a", f"SELECT conv_id, turn, {inputs.ANSWER_TEXT} AS s FROM conversations"), select="""
SELECT conv_id, turn, CAST(item_no AS INTEGER) AS item_no, CAST(turn + 1 AS INTEGER) AS line, s AS snippet,
       'password' AS type, 'high' AS confidence, 'r' || conv_id AS rationale
FROM (SELECT *, unnest(range(0, CASE turn % 8 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2
                                WHEN 4 THEN 2 ELSE 0 END)) AS item_no FROM a)"""),
    "model_scan": with_(DOC_CHUNKS, CHUNK_LINES, MODEL_FINDINGS, select="""
SELECT repository, file_path, line_number, snippet, finding_type, confidence, rationale, detector FROM mf"""),
    "last_n": with_(COMMITS, window(10), select="SELECT repository, commit_hash, commit_rank FROM w"),
    "commits_scanned": with_(COMMITS, select="""
SELECT repository, least(count(*), 50) AS commits_scanned FROM commits GROUP BY repository"""),
    "diff_lines": with_(*DIFF, select=f"SELECT {PATCH_KEY}, hunk_no, line_no, line FROM added"),
    "message_units": with_(COMMITS, window(10), MESSAGES, select="""
SELECT repository, commit_hash, commit_rank, file_path, author, date, t AS text FROM u"""),
    "scan_units": with_(*UNITS, select="""
SELECT repository, commit_hash, commit_rank, origin, file_path, author, date, t AS text,
       array_to_string(line_nos, ',') AS line_nos FROM u"""),
    "repository_scan": with_(*SCAN, select=f"""
SELECT repository, commit_hash, commit_rank, file_path, line_number, {REDACTED} AS snippet, finding_type,
       confidence, author, date, is_uncommitted, secret_sha256 FROM d"""),
    "uncommitted_findings": with_(*SCAN, select="""
SELECT repository, file_path, line_number, snippet, finding_type, author FROM d WHERE is_uncommitted"""),
    "commit_details": with_(COMMITS, window(10), MESSAGES, *hits(RULES), select="""
SELECT repository, commit_hash, finding_type, author, date FROM f"""),
    "repository_summary": with_(*SCAN, select="""
SELECT repository, coalesce(n, 0) AS commits_scanned, coalesce(total, 0) AS total_findings,
  coalesce(high, 0) AS high_confidence, coalesce(medium, 0) AS medium_confidence, coalesce(low, 0) AS low_confidence
FROM (SELECT repository, count(*) AS n FROM w GROUP BY 1) FULL JOIN
  (SELECT repository, count(*) AS total, count(*) FILTER (confidence = 'high') AS high,
     count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low
   FROM d GROUP BY 1) USING (repository)"""),
    "stream_scan": planted(f"SELECT DISTINCT {REDACTED_COLUMNS} FROM f"),
}

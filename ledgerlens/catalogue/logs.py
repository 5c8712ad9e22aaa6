"""Error-log, run-metric, message and response queries.

The tables hold no such logs, so every query derives one row per row of a given table:
errors and runs from events, requests from conversations, responses from documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.catalogue.registry import r, register, rounded, table
from ledgerlens.functions.rules import first_match
from ledgerlens.operators import error_log, messages, responses, runs

# fmt: off

MESSAGES = (
    "test.csv not found for user ", "Permission denied on upload by user ", "File size exceeds the limit for user ",
    "Unsupported format from user ", "Failed to connect to OpenAI API for user ", "Invalid API key configuration of user ",
    "Rate limit reached by user ", "Model llm unavailable to user ", "Connection timeout for user ", "Host unreachable for user ",
    "Validation failed: bad schema from user ", "Workflow step failed for user ", "Out of memory for user ", "division by zero for user ",
)
LOG = ("log AS (SELECT event_id, ts AS timestamp, CASE event_id % 14 " + " ".join(
    f"WHEN {i} THEN '{m}'" for i, m in enumerate(MESSAGES)) + " END || user_id || ' ' || event_type || ' ' || props AS message FROM events)")


def _log(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    texts = F.array(*[F.lit(m) for m in MESSAGES])
    message = F.concat(
        F.get(texts, (F.col("event_id") % 14).cast("int")), F.col("user_id").cast("string"),
        F.lit(" "), "event_type", F.lit(" "), "props",
    )
    return events.select("event_id", F.col("ts").alias("timestamp"), message.alias("message"))


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(lower(message), '{w}')" for w in words) + ")"


# The words of each category in the order they are tried, as the twins have them.
_WORDS = (("file_processing", ("file", "csv", "upload", "size", "format")), ("llm_api", ("api", "llm", "openai", "ollama", "rate limit", "quota")),
          ("network", ("network", "connection", "timeout", "unreachable")), ("validation", ("invalid", "validation", "format", "schema")),
          ("workflow", ("workflow",)), ("system", ("memory",)))
_CATEGORY = "CASE " + " ".join(f"WHEN {_any(w)} THEN '{c}'" for c, w in _WORDS) + " ELSE 'system' END"
_SEVERITY = (f"CASE WHEN category = 'llm_api' AND {_any(['configuration'])} THEN 'high' WHEN category = 'workflow' THEN 'high' "
             f"WHEN category = 'system' AND {_any(['memory'])} THEN 'critical' ELSE 'medium' END")
CLASSIFIED = (LOG, f"placed AS (SELECT *, {_CATEGORY} AS category FROM log)", f"errors AS (SELECT *, {_SEVERITY} AS severity FROM placed)")


def _errors_sql(body: str) -> str:
    return f"WITH {', '.join(CLASSIFIED)} {body}"


@register("classify_errors", _errors_sql("SELECT event_id, category, severity FROM errors"))
def classify_errors(spark, sf_dir):
    return error_log.classify_errors(_log(spark, sf_dir)).select("event_id", "category", "severity")


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_USER_TEXT = "CASE " + " ".join(
    f"WHEN category = '{c}'{' AND ' + _any(words) if words else ''} THEN {_quote(reply)}"
    for c, cases in error_log.USER_MESSAGES.items() for words, reply in cases
) + f" WHEN severity = 'critical' THEN {_quote(error_log.CRITICAL_MESSAGE)} ELSE {_quote(error_log.SYSTEM_MESSAGE)} END"


@register("error_user_message", _errors_sql(f"SELECT event_id, {_USER_TEXT} AS user_message FROM errors"))
def error_user_message(spark, sf_dir):
    found = error_log.error_user_message(error_log.classify_errors(_log(spark, sf_dir)))
    return found.select("event_id", "user_message")


def _list(texts) -> str:
    return "[" + ", ".join(_quote(t) for t in texts) + "]"


def _suggested(c: str) -> str:
    if c not in error_log.EXTRA_SUGGESTIONS:
        return _list(error_log.SUGGESTIONS[c])
    word, more = error_log.EXTRA_SUGGESTIONS[c]
    return f"{_list(error_log.SUGGESTIONS[c])} || CASE WHEN {_any([word])} THEN {_list(more)} ELSE [] END"


_SUGGESTIONS = "CASE category " + " ".join(f"WHEN '{c}' THEN {_suggested(c)}" for c in error_log.SUGGESTIONS) + " END"


@register("recovery_suggestions", _errors_sql(f"SELECT event_id, array_to_string(({_SUGGESTIONS})[1:3], '|') AS suggestions FROM errors"))
def recovery_suggestions(spark, sf_dir):
    found = error_log.recovery_suggestions(error_log.classify_errors(_log(spark, sf_dir)))
    return found.select("event_id", F.array_join("recovery_suggestions", "|").alias("suggestions"))


@register("all_suggestions", _errors_sql(f"SELECT event_id, array_to_string({_SUGGESTIONS}, '|') AS suggestions FROM errors"))
def all_suggestions(spark, sf_dir):
    found = error_log.recovery_suggestions(error_log.classify_errors(_log(spark, sf_dir)), first=None)
    return found.select("event_id", F.array_join("recovery_suggestions", "|").alias("suggestions"))


# What forbids a retry, as the twin has it.
_NO_RETRY = ("not found", "permission denied", "invalid format", "authentication failed", "api key", "quota exceeded")
_RETRY = f"category IN ('network', 'llm_api', 'system') AND NOT {_any(_NO_RETRY)}"


@register("retry_possible", _errors_sql(f"SELECT event_id, {_RETRY} AS retry_possible FROM errors"))
def retry_possible(spark, sf_dir):
    found = error_log.retry_possible(error_log.classify_errors(_log(spark, sf_dir)))
    return found.select("event_id", "retry_possible")


# Exception types by event, derived ones among them, and what each says about the category.
TYPES = ("ConnectionRefusedError", "JSONDecodeError", "AnalyserAgentError", "FileNotFoundError", "KeyError", "MemoryError", "ReporterAgentError", "WorkflowError")
# The category of each of these types, as the twin has it.
_OF_TYPE = {"network": ("ConnectionRefusedError",), "validation": ("JSONDecodeError",), "llm_api": ("AnalyserAgentError", "ReporterAgentError"),
            "file_processing": ("FileNotFoundError",), "workflow": ("WorkflowError",), "system": ("MemoryError",)}
_TYPED = ("typed AS (SELECT event_id, nullif(event_type, 'error') AS message, CASE event_id % 8 " + " ".join(
    f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES)) + " END AS error_type FROM events)")
_TYPED_CATEGORY = "CASE " + " ".join(
    f"WHEN coalesce({_any(w)}, false) OR error_type IN ({', '.join(map(_quote, _OF_TYPE[c]))}) THEN '{c}'" for c, w in _WORDS) + " ELSE 'system' END"
_TYPED_SEVERITY = ("CASE category WHEN 'file_processing' THEN CASE WHEN error_type = 'FileNotFoundError' THEN 'high' ELSE 'medium' END "
                   "WHEN 'workflow' THEN 'high' WHEN 'system' THEN CASE WHEN error_type = 'MemoryError' THEN 'critical' ELSE 'medium' END ELSE 'medium' END")


@register("classify_by_type", f"WITH {_TYPED}, placed AS (SELECT *, {_TYPED_CATEGORY} AS category FROM typed) SELECT event_id, category, {_TYPED_SEVERITY} AS severity, "
          f"category IN ('network', 'llm_api', 'system') AND NOT coalesce({_any(_NO_RETRY)}, false) AS retry_possible FROM placed")
def classify_by_type(spark, sf_dir):
    """Exception types and their subclasses decide where the message does not; some are missing."""
    types = F.array(*[F.lit(t) for t in TYPES])
    log = table(spark, sf_dir, "events").select(
        "event_id", F.nullif("event_type", F.lit("error")).alias("message"),
        F.get(types, (F.col("event_id") % 8).cast("int")).alias("error_type"))
    found = error_log.retry_possible(error_log.classify_errors(log, error_type="error_type"))
    return found.select("event_id", "category", "severity", "retry_possible")


ERROR_STATISTICS = _errors_sql(f"""
SELECT 'total_errors' AS metric, NULL AS key, count(*) AS value FROM errors
UNION ALL SELECT 'recent_errors_1h', NULL, count(*) FROM errors WHERE timestamp > (SELECT max(timestamp) FROM errors) - INTERVAL 1 HOUR
UNION ALL SELECT 'retry_capable_errors', NULL, count(*) FROM errors WHERE {_RETRY}
UNION ALL SELECT 'by_category', category, count(*) FROM errors GROUP BY category
UNION ALL SELECT 'by_severity', severity, count(*) FROM errors GROUP BY severity""")


@register("error_statistics", ERROR_STATISTICS)
def error_statistics(spark, sf_dir):
    log = error_log.enrich_errors(_log(spark, sf_dir))
    return error_log.error_statistics(log, log.agg(F.max("timestamp")).scalar())


# -- runs -------------------------------------------------------------------------------

def _runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("operation_name"), F.col("ts").alias("start_time"),
        F.col("value").alias("duration_seconds"), (F.col("user_id") * 100).alias("rows_processed"),
        F.col("user_id").cast("double").alias("memory_before_mb"),
        (F.col("user_id") + F.col("event_id") % 7).cast("double").alias("memory_after_mb"))


@register("operation_stats", f"""SELECT event_type AS operation, count(*) AS count, {r('avg(value)')} AS avg_duration, {r('min(value)')} AS min_duration,
{r('max(value)')} AS max_duration, {r('sum(value)', 4)} AS total_duration FROM events GROUP BY event_type""")
def operation_stats(spark, sf_dir):
    return rounded(runs.operation_stats(_runs(spark, sf_dir)).withColumn("total_duration", F.round("total_duration", 4)))


@register("throughput", f"""SELECT event_id, {r('CASE WHEN user_id <> 0 AND value > 0 THEN user_id * 100 / value END', 4)} AS throughput_rows_per_sec,
CAST(event_id % 7 AS DOUBLE) AS memory_delta_mb FROM events""")
def throughput(spark, sf_dir):
    found = runs.throughput(_runs(spark, sf_dir))
    return rounded(found.select("event_id", "throughput_rows_per_sec", "memory_delta_mb"), 4)


@register("recent_runs", "SELECT event_id, event_type AS operation_name FROM events ORDER BY ts DESC, event_id LIMIT 10")
def recent_runs(spark, sf_dir):
    return runs.recent_runs(_runs(spark, sf_dir), 10, "start_time", "event_id").select("event_id", "operation_name")


# -- messages ---------------------------------------------------------------------------

PHRASES = (
    "Analyze the temporal trend", "Any unusual outlier?", "Show the correlation of features", "Is this fraud?", "Describe the data overview",
    "Write a summary report", "Please download the export", "How does it work", "Good morning",
)
ASKED = ("asked AS (SELECT conv_id, turn, role, text || ' ' || CASE (conv_id + turn) % 9 " + " ".join(
    f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END AS content FROM conversations)")


def _asked(spark, sf_dir):
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), ((F.col("conv_id") + F.col("turn")) % 9).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat_ws(" ", "text", phrase).alias("content"))


def _rules_sql(rules, default: str) -> str:
    tests = " ".join("WHEN " + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + f" THEN '{name}'" for name, words in rules)
    return f"CASE {tests} ELSE '{default}' END"


@register("route_messages", f"WITH {ASKED} SELECT conv_id, turn, {_rules_sql(messages.ROUTES, 'general')} AS route FROM asked")
def route_messages(spark, sf_dir):
    return messages.route_messages(_asked(spark, sf_dir)).select("conv_id", "turn", "route")


@register("route_counts", f"WITH {ASKED} SELECT {_rules_sql(messages.ROUTES, 'general')} AS route, count(*) AS count FROM asked GROUP BY route")
def route_counts(spark, sf_dir):
    return messages.route_messages(_asked(spark, sf_dir)).groupBy("route").agg(F.count("*").alias("count"))


@register("analysis_type", f"WITH {ASKED} SELECT conv_id, turn, {_rules_sql(messages.ANALYSIS_TYPES, 'comprehensive')} AS analysis_type FROM asked")
def analysis_type(spark, sf_dir):
    return messages.analysis_type(_asked(spark, sf_dir)).select("conv_id", "turn", "analysis_type")


def _talk(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumn("timestamp", F.col("turn").cast("string"))


_MARK = "CASE role " + " ".join(f"WHEN '{k}' THEN '{m}'" for k, m in messages.ROLE_MARKS.items()) + f" ELSE '{messages.OTHER_MARK}' END"
_MD = f"'## ' || {_MARK} || ' ' || upper(role[1]) || lower(role[2:]) || chr(10) || '*' || turn || '*' || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10)"
_TXT = f"upper(role) || ' (' || turn || '):' || chr(10) || text || chr(10) || '{'-' * 30}'"


def _transcript_sql(head: str, piece: str) -> str:
    return (f"SELECT conv_id, turn // 2 AS part, CASE WHEN turn // 2 = 0 THEN {head} ELSE '' END || chr(10) || string_agg({piece}, chr(10) ORDER BY turn) AS transcript "
            "FROM conversations GROUP BY conv_id, turn // 2")


@register("transcripts_markdown", _transcript_sql("'# Chat History' || chr(10)", _MD))
def transcripts_markdown(spark, sf_dir):
    return messages.transcripts(_talk(spark, sf_dir), "conv_id", "turn", "markdown", content="text", part_turns=2)


@register("transcripts_text", _transcript_sql(f"'Chat History' || chr(10) || '{'=' * 50}' || chr(10)", _TXT))
def transcripts_text(spark, sf_dir):
    return messages.transcripts(_talk(spark, sf_dir), "conv_id", "turn", "text", content="text", part_turns=2)


@register("transcripts_json", """SELECT conv_id, turn // 1000 AS part, count(*) AS messages, string_agg(role || ':' || text, '|' ORDER BY turn) AS said
FROM conversations GROUP BY conv_id, turn // 1000""")
def transcripts_json(spark, sf_dir):
    """The JSON transcript parsed back, so that both engines compare values, not escapes."""
    found = messages.transcripts(_talk(spark, sf_dir), "conv_id", "turn", "json", content="text")
    said = F.from_json("transcript", "array<struct<role string, content string, timestamp string>>")
    texts = F.transform(said, lambda s: F.concat_ws(":", s["role"], s["content"]))
    return found.select("conv_id", "part", F.size(said).cast("bigint").alias("messages"), F.array_join(texts, "|").alias("said"))


# -- responses ---------------------------------------------------------------------------

# (text before, JSON body with the document number at @ and its text at ~, text after); no body means none
RESPONSES = (
    ("```json\n", '{"analysis_summary": {"key_findings": ["n @ ~"]}, "fraud_specific_analysis": {"fraud_rate": 0.1},\n "recommendations": {"further_analysis": []}}', "\n```\nDone {"),
    ("", '{"analysis_summary": {"key_findings": []}, "recommendations": {}, "note": "~", "id": @}', ""),
    ("Here it is: ", '{"report_metadata": {"id": @}, "markdown_report": "x ~", "key_metrics": {"n": 5}}', " thanks }"),
    ("No structure here @ ~", None, ""),
    ("Sure.\n```\n", '{"analysis_summary": {"key_findings": ["a ~", "b"]}, "id": @,\n"confidence_scores": {"analysis_confidence": 0.8, "pattern_strength": 0.6}}', "\n```"),
    ("", '{"broken": [1, @', ""),
    ("  \n ", '{"analysis_summary": "text ~", "fraud_specific_analysis": 1, "recommendations": {"a": @}}', "\n trailing"),
)


def _responses(spark, sf_dir):
    number, kind = F.col("doc_id").cast("string"), F.col("doc_id") % len(RESPONSES)
    plain = F.regexp_replace("text", "[^A-Za-z0-9 ]", "")
    filled = [F.replace(F.replace(F.lit(a + (b or "") + c), F.lit("@"), number), F.lit("~"), plain) for a, b, c in RESPONSES]
    rules = [(kind == i, text) for i, text in enumerate(filled)]
    text = first_match(rules, F.lit(None).cast("string"))
    return responses.extract_json(table(spark, sf_dir, "documents").select("doc_id", text.alias("response")))


_BODY = f"CASE doc_id % {len(RESPONSES)} " + " ".join(
    f"WHEN {i} THEN replace(replace({_quote(b)}, '@', CAST(doc_id AS VARCHAR)), '~', regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'))" for i, (_, b, _c) in enumerate(RESPONSES) if b) + " END"
BODIES = f"bodies AS (SELECT doc_id, {_BODY} AS json FROM documents), parsed AS (SELECT doc_id, json, CASE WHEN json_valid(json) THEN json END AS j FROM bodies)"


@register("extract_json", f"WITH {BODIES} SELECT doc_id, json FROM bodies")
def extract_json(spark, sf_dir):
    return _responses(spark, sf_dir).select("doc_id", "json")


def _has_all(role: str) -> str:
    return f"coalesce(list_has_all(json_keys(j), {_list(responses.REQUIRED_KEYS[role])}), FALSE)"


@register("validate_required", f"WITH {BODIES} SELECT doc_id, {_has_all('analyser')} AS analyser, {_has_all('reporter')} AS reporter FROM parsed")
def validate_required(spark, sf_dir):
    found = responses.validate_required(_responses(spark, sf_dir), "analyser", out="analyser")
    return responses.validate_required(found, "reporter", out="reporter").select("doc_id", "analyser", "reporter")


_COMPLETE = ("least(coalesce(len(list_intersect(json_keys(j), " + _list(responses.REQUIRED_KEYS["analyser"]) + ")), 0) / 3.0 "
             "+ CASE WHEN coalesce(json_array_length(j, '$.analysis_summary.key_findings'), 0) > 0 THEN 0.1 ELSE 0 END "
             "+ CASE WHEN coalesce(len(json_keys(j, '$.recommendations')), 0) > 0 THEN 0.1 ELSE 0 END, 1.0)")


@register("completeness_score", f"WITH {BODIES} SELECT doc_id, {r(_COMPLETE)} AS completeness FROM parsed")
def completeness_score(spark, sf_dir):
    return rounded(responses.completeness_score(_responses(spark, sf_dir)).select("doc_id", "completeness"))


_STATED = " + ".join(f"coalesce(CAST(json_extract(j, '$.confidence_scores.{k}') AS DOUBLE), 0.5)" for k in responses.CONFIDENCE_KEYS)


@register("confidence_score", f"WITH {BODIES} SELECT doc_id, {r(f'''CASE WHEN coalesce(len(json_keys(j, '$.confidence_scores')), 0) > 0 THEN ({_STATED}) / 3 ELSE {_COMPLETE} END''')} AS confidence FROM parsed")
def confidence_score(spark, sf_dir):
    return rounded(responses.confidence_score(_responses(spark, sf_dir)).select("doc_id", "confidence"))

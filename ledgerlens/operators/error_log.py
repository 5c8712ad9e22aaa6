"""Error-log tables: category, severity, user text, suggestions, retry, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.rules import first_match, mentions

# Categories in the order they are tried, with the words that select them.
CATEGORY_WORDS = (
    ("file_processing", ("file", "csv", "upload", "size", "format")),
    ("llm_api", ("api", "llm", "openai", "ollama", "rate limit", "quota")),
    ("network", ("network", "connection", "timeout", "unreachable")),
    ("validation", ("invalid", "validation", "format", "schema")),
    ("workflow", ("workflow",)),
    ("system", ("memory",)),
)
# Exception types that select a category whatever the message says.
CATEGORY_TYPES = {
    "file_processing": ("FileNotFoundError", "PermissionError", "FileValidationError"),
    "llm_api": (
        "LLMConfigurationError", "LLMConnectionError", "AnalyserAgentError", "ReporterAgentError",
    ),
    "network": ("RequestException", "ConnectionError"),
    "validation": ("ValueError", "TypeError"),
    "workflow": ("WorkflowError",),
    "system": ("MemoryError",),
}
# Well-known exceptions derived from those above; a class counts as what it
# is derived from.
DERIVED_TYPES = {
    "ConnectionError": (
        "ConnectionRefusedError", "ConnectionResetError", "ConnectionAbortedError",
        "BrokenPipeError",
    ),
    "RequestException": (
        "HTTPError", "ConnectTimeout", "ReadTimeout", "Timeout", "ProxyError", "SSLError",
        "TooManyRedirects", "ChunkedEncodingError", "InvalidURL",
    ),
    "ValueError": (
        "JSONDecodeError", "UnicodeError", "UnicodeDecodeError", "UnicodeEncodeError",
        "UnicodeTranslateError", "ParserError", "EmptyDataError",
    ),
}
# Texts shown to the user, by category and the words that select them.
USER_MESSAGES = {
    "file_processing": (
        (("not found", "does not exist"),
         "The selected file could not be found. Please check the file path and try again."),
        (("permission",),
         "Permission denied accessing the file. Please check file permissions."),
        (("size", "large"),
         "The file is too large to process. Please try with a smaller file or check available memory."),
        (("format", "csv"),
         "The file format is not valid. Please ensure you're uploading a properly formatted CSV file."),
        ((), "An error occurred while processing the file. Please check the file and try again."),
    ),
    "llm_api": (
        (("api key", "authentication"),
         "LLM service authentication failed. Please check your API key configuration."),
        (("rate limit", "quota"),
         "API rate limit exceeded. Please wait a moment and try again."),
        (("connection", "network"),
         "Cannot connect to the LLM service. Please check your internet connection."),
        (("model",),
         "The requested LLM model is not available. Please check your configuration."),
        ((), "An error occurred with the AI service. Please try again or check your configuration."),
    ),
    "network": (
        (("timeout",),
         "Connection timed out. Please check your internet connection and try again."),
        (("unreachable",),
         "Service is unreachable. Please check your network connection."),
        ((), "Network connectivity issue. Please check your internet connection."),
    ),
    "validation": (
        ((), "Invalid data format detected. Please check your input and try again."),
    ),
    "workflow": (
        ((), "An error occurred during data processing. The operation has been stopped."),
    ),
}
# The remaining texts shown to the user.
CRITICAL_MESSAGE = "A critical system error occurred. Please restart the application."
SYSTEM_MESSAGE = "A system error occurred. Please try again."
UNKNOWN_MESSAGE = (
    "An unexpected error occurred. Please try again or contact support if the problem persists."
)
# Recovery suggestions per category, and extras selected by a word.
SUGGESTIONS = {
    "file_processing": (
        "Verify the file exists and is accessible",
        "Check file permissions and ownership",
        "Ensure the file is a valid CSV format",
        "Try with a smaller file if memory issues occur",
    ),
    "llm_api": (
        "Check your API key configuration",
        "Verify your internet connection",
        "Try switching to a different LLM provider",
        "Check API service status",
    ),
    "network": (
        "Check your internet connection",
        "Try again in a few moments",
        "Verify firewall settings",
        "Check if the service is running",
    ),
    "validation": (
        "Verify input data format",
        "Check for missing required fields",
        "Ensure data types are correct",
    ),
    "workflow": (
        "Retry the operation",
        "Check input data quality",
        "Verify system resources are available",
    ),
    "system": (
        "Restart the application",
        "Check system resources (memory, disk space)",
        "Update application dependencies",
    ),
}
# More suggestions, by category and the word that adds them.
EXTRA_SUGGESTIONS = {
    "file_processing": ("size", (
        "Reduce the file size by sampling the data",
        "Increase available memory/RAM",
        "Use chunked processing if available",
    )),
    "llm_api": ("rate limit", (
        "Wait before retrying the request",
        "Reduce request frequency",
        "Check your API quota limits",
    )),
}
# Words that forbid a retry, and categories that allow one.
NO_RETRY_WORDS = (
    "not found", "permission denied", "invalid format",
    "authentication failed", "api key", "quota exceeded",
)
RETRY_CATEGORIES = ("network", "llm_api", "system")


def classify_errors(
    log: DataFrame, message: str = "message", error_type: str | None = None
) -> DataFrame:
    """Add ``category`` and ``severity``; the first matching rule wins."""
    text = F.lower(message)
    rules = []
    for name, words in CATEGORY_WORDS:
        test = mentions(text, words)
        if error_type:
            types = [t for base in CATEGORY_TYPES[name] for t in (base, *DERIVED_TYPES.get(base, ()))]
            test = test | F.coalesce(F.col(error_type).isin(*types), F.lit(False))
        rules.append((test, name))
    category = first_match(rules, "system")
    missing_file = F.lit(False)
    out_of_memory = mentions(text, ["memory"])
    if error_type:
        missing_file = F.coalesce(F.col(error_type) == "FileNotFoundError", F.lit(False))
        out_of_memory = out_of_memory | F.coalesce(
            F.col(error_type) == "MemoryError", F.lit(False)
        )
    of = F.col("category")
    severity = first_match(
        [
            ((of == "file_processing") & missing_file, "high"),
            ((of == "llm_api") & mentions(text, ["configuration"]), "high"),
            (of == "workflow", "high"),
            ((of == "system") & out_of_memory, "critical"),
        ],
        "medium",
    )
    return log.withColumn("category", category).withColumn("severity", severity)


def error_user_message(log: DataFrame, message: str = "message") -> DataFrame:
    """Add ``user_message`` to a classified log."""
    text = F.lower(message)
    rules: list[tuple[Column, object]] = []
    for name, cases in USER_MESSAGES.items():
        for words, reply in cases:
            test = F.col("category") == name
            rules.append((test & mentions(text, words) if words else test, reply))
    system = F.col("category") == "system"
    rules += [(system & (F.col("severity") == "critical"), CRITICAL_MESSAGE)]
    rules += [(system, SYSTEM_MESSAGE)]
    return log.withColumn("user_message", first_match(rules, UNKNOWN_MESSAGE))


def recovery_suggestions(
    log: DataFrame, message: str = "message", first: int | None = 3
) -> DataFrame:
    """Add ``recovery_suggestions``, the first three unless ``first`` is None."""
    text = F.lower(message)
    rules = []
    for name, texts in SUGGESTIONS.items():
        listed = F.array(*[F.lit(t) for t in texts])
        if name in EXTRA_SUGGESTIONS:
            word, more = EXTRA_SUGGESTIONS[name]
            extra = F.concat(listed, F.array(*[F.lit(t) for t in more]))
            listed = F.when(mentions(text, [word]), extra).otherwise(listed)
        rules.append((F.col("category") == name, listed))
    found = first_match(rules, F.array().cast("array<string>"))
    return log.withColumn("recovery_suggestions", F.slice(found, 1, first) if first else found)


def retry_possible(log: DataFrame, message: str = "message") -> DataFrame:
    """Add the boolean ``retry_possible``."""
    allowed = F.col("category").isin(*RETRY_CATEGORIES)
    text = F.lower(F.coalesce(F.col(message), F.lit("")))  # a missing message forbids nothing
    return log.withColumn("retry_possible", allowed & ~mentions(text, NO_RETRY_WORDS))


def enrich_errors(log: DataFrame, message: str = "message") -> DataFrame:
    """All derived columns of an error record."""
    out = error_user_message(classify_errors(log, message), message)
    return retry_possible(recovery_suggestions(out, message), message)


def error_statistics(log: DataFrame, now: Column, timestamp: str = "timestamp") -> DataFrame:
    """(metric, key, value): total, by category, by severity, last hour, retry-capable."""
    recent = F.count_if(F.col(timestamp) > now - F.expr("INTERVAL 1 HOUR"))
    c, s = F.col("category"), F.col("severity")
    # one small row per (category, severity) before the grouping sets multiply rows
    counts = log.groupBy(c, s).agg(
        F.count("*").alias("n"),
        recent.alias("recent"),
        F.count_if(F.col("retry_possible")).alias("retry"),
    )
    total = {k: F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("n", "recent", "retry")}
    sets = counts.groupingSets([[], [c], [s]], c, s).agg(
        *total.values(),
        F.grouping("category").alias("no_category"),
        F.grouping("severity").alias("no_severity"),
    )

    def entry(metric: str, key: Column, value: str) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"), key.cast("string").alias("key"), F.col(value).alias("value")
        )

    overall = F.array(
        entry("total_errors", F.lit(None), "n"),
        entry("recent_errors_1h", F.lit(None), "recent"),
        entry("retry_capable_errors", F.lit(None), "retry"),
    )
    rows = (
        F.when((F.col("no_category") == 1) & (F.col("no_severity") == 1), overall)
        .when(F.col("no_category") == 0, F.array(entry("by_category", c, "n")))
        .otherwise(F.array(entry("by_severity", s, "n")))
    )
    return sets.select(F.inline(rows))

"""Message tables: routing, analysis type and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.functions.rules import first_match, mentions

# Request kinds in the order they are tried, with their words.
ROUTES = (
    ("analysis", (
        "analyze", "analysis", "examine", "investigate", "study", "pattern", "trend",
        "correlation", "outlier", "distribution", "statistics", "statistical", "fraud", "anomaly",
    )),
    ("report", (
        "report", "summary", "document", "generate", "create", "write", "markdown", "export",
        "download",
    )),
    ("help", ("help", "how", "what can", "what do", "explain", "guide")),
)
# Analysis types in the order they are tried, with their words.
ANALYSIS_TYPES = (
    ("pattern_identification", ("pattern", "trend", "temporal")),
    ("outlier_detection", ("outlier", "anomaly", "unusual")),
    ("relationship_analysis", ("correlation", "relationship", "feature")),
    ("fraud_analysis", ("fraud", "class", "prediction")),
    ("data_description", ("describe", "overview", "summary")),
)
# Marks before a role in a markdown transcript.
ROLE_MARKS = {"user": "👤", "assistant": "🤖", "system": "ℹ️", "error": "⚠️"}
OTHER_MARK = "•"


def _keyword(messages: DataFrame, text: str, rules, default: str) -> Column:
    lowered = F.lower(text)
    return first_match([(mentions(lowered, words), name) for name, words in rules], default)


def route_messages(messages: DataFrame, text: str = "content") -> DataFrame:
    """Add ``route``: analysis, report, help or general."""
    return messages.withColumn("route", _keyword(messages, text, ROUTES, "general"))


def analysis_type(messages: DataFrame, text: str = "content") -> DataFrame:
    """Add ``analysis_type``."""
    found = _keyword(messages, text, ANALYSIS_TYPES, "comprehensive")
    return messages.withColumn("analysis_type", found)


def transcripts(
    messages: DataFrame, thread: str, turn: str, form: str = "markdown", role: str = "role",
    content: str = "content", timestamp: str = "timestamp", part_turns: int = 1000,
) -> DataFrame:
    """(thread, part, transcript): every thread in turn order.

    A thread is written in parts of ``part_turns`` turns, so a very long one is not
    gathered in a single task; text parts concatenate to the whole document and JSON
    parts are arrays whose elements continue each other.
    """
    mark = first_match([(F.col(role) == r, m) for r, m in ROLE_MARKS.items()], OTHER_MARK)
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, content))
    time = F.coalesce(F.col(timestamp).cast("string"), F.lit(""))
    if form == "markdown":
        piece = F.concat(
            F.lit("## "), mark, F.lit(" "), F.initcap(who), F.lit("\n*"), time, F.lit("*\n\n"),
            said, F.lit("\n\n---\n"),
        )
        opening, glue = "# Chat History\n", "\n"
    elif form == "text":
        piece = F.concat(
            F.upper(who), F.lit(" ("), time, F.lit("):\n"), said,
            F.lit("\n" + "-" * 30),
        )
        opening, glue = "Chat History\n" + "=" * 50 + "\n", "\n"
    elif form == "json":
        fields = [F.col(role).alias("role"), F.col(content).alias("content")]
        fields += [F.col(timestamp).alias("timestamp")]
        fields += [F.col(c) for c in ("message_id", "metadata", "charts") if c in messages.columns]
        piece = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
        opening, glue = None, ","
    else:
        raise ValueError(f"unsupported transcript form {form!r}")
    # A turn without a number comes last, in the last part.
    last = F.max(turn).over(Window.partitionBy(thread))
    at = F.coalesce(F.col(turn), last, F.lit(0))
    part = F.floor(at / part_turns)
    lines = messages.select(
        F.col(thread), part.alias("part"), F.col(turn).isNull().alias("_late"), F.col(turn).alias("_turn"), piece.alias("_piece")
    )
    ordered = F.array_sort(F.collect_list(F.struct("_late", "_turn", "_piece")))
    joined = F.array_join(F.transform(ordered, lambda s: s["_piece"]), glue)
    if opening is None:
        body = F.concat(F.lit("["), joined, F.lit("]"))
    else:
        body = F.concat(F.when(F.col("part") == 0, F.lit(opening + glue)).otherwise(F.lit(glue)), joined)
    return lines.groupBy(thread, "part").agg(body.alias("transcript"))

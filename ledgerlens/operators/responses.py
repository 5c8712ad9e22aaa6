"""Model-response tables: JSON extraction, required keys and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Top-level keys a response must have, by role.
REQUIRED_KEYS = {
    "analyser": ("analysis_summary", "fraud_specific_analysis", "recommendations"),
    "reporter": ("report_metadata", "markdown_report", "key_metrics"),
}
CONFIDENCE_KEYS = ("analysis_confidence", "data_quality_score", "pattern_strength")
DEFAULT_CONFIDENCE = 0.5


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _is_fence(line: Column) -> Column:
    return F.startswith(F.ltrim(_trim(line)), F.lit("```"))


def _fenced_or_bare(text: Column) -> Column:
    """Lines from the start of the JSON on, without the fence lines.

    The JSON starts at the first line inside an open fence or beginning with a brace.
    """
    lines = F.split(text, "\n")
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("fences"), F.lit(-1).alias("start")
    )

    def step(state: Column, line: Column) -> Column:
        fence = _is_fence(line)
        opens = ~fence & ((state["fences"] % 2 == 1) | F.startswith(_trim(line), F.lit("{")))
        return F.struct(
            (state["at"] + 1).alias("at"),
            (state["fences"] + fence.cast("int")).alias("fences"),
            F.when((state["start"] < 0) & opens, state["at"]).otherwise(state["start"]).alias("start"),
        )

    first = F.aggregate(lines, start, step, lambda s: s["start"])
    kept = F.filter(lines, lambda line, i: (first >= 0) & (i >= first) & ~_is_fence(line))
    return _trim(F.array_join(kept, "\n"))


def _balanced(text: Column) -> Column:
    """Cut after the brace that closes the first one; unchanged when none does."""
    pieces = F.split(text, r"\}")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("open"), F.lit(0).alias("end"))

    def step(state: Column, piece: Column) -> Column:
        opened = F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit("")))
        at, left = state["at"] + 1, state["open"] + opened - 1
        closes = (state["end"] == 0) & (left == 0) & (at < F.size(pieces))
        return F.struct(
            at.alias("at"), left.alias("open"),
            F.when(closes, at).otherwise(state["end"]).alias("end"),
        )

    end = F.aggregate(pieces, start, step, lambda s: s["end"])
    cut = F.concat(F.array_join(F.slice(pieces, F.lit(1), end), "}"), F.lit("}"))
    return F.when(end > 0, cut).otherwise(text)


def extract_json(responses: DataFrame, text: str = "response", out: str = "json") -> DataFrame:
    """Add the JSON object of each response: fences stripped, balanced, NULL if none."""
    first = responses.withColumn("_fenced", _fenced_or_bare(F.col(text)))
    found = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    taken = F.when(F.startswith("_fenced", F.lit("{")), F.col("_fenced")).otherwise(found)
    whole = first.withColumn(out, taken).drop("_fenced")
    return whole.withColumn(out, _balanced(F.col(out)))


def _has(json: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


def validate_required(
    responses: DataFrame, role: str = "analyser", json: str = "json", out: str = "valid"
) -> DataFrame:
    """Add whether the JSON is an object with all keys of the role."""
    valid = F.lit(True)
    for key in REQUIRED_KEYS[role]:
        valid = valid & _has(F.col(json), key)
    return responses.withColumn(out, valid)


def _completeness(json: Column) -> Column:
    keys = REQUIRED_KEYS["analyser"]
    present = sum((_has(json, k).cast("int") for k in keys[1:]), _has(json, keys[0]).cast("int"))
    findings = F.json_array_length(F.get_json_object(json, "$.analysis_summary.key_findings"))
    advice = F.size(F.json_object_keys(F.get_json_object(json, "$.recommendations")))
    tenth = F.lit(0.1)
    bonus = F.when(F.coalesce(findings, F.lit(0)) > 0, tenth).otherwise(F.lit(0.0)) + F.when(
        F.coalesce(advice, F.lit(0)) > 0, tenth
    ).otherwise(F.lit(0.0))
    return F.least(present / F.lit(float(len(keys))) + bonus, F.lit(1.0))


def completeness_score(
    responses: DataFrame, json: str = "json", out: str = "completeness"
) -> DataFrame:
    """Add the share of required sections plus a tenth each for findings and advice."""
    return responses.withColumn(out, _completeness(F.col(json)))


def confidence_score(
    responses: DataFrame, json: str = "json", out: str = "confidence"
) -> DataFrame:
    """Add the mean of the three stated scores, or the completeness when none is stated."""
    text = F.col(json)
    stated = F.get_json_object(text, "$.confidence_scores")
    some = F.coalesce(F.size(F.json_object_keys(stated)), F.lit(0)) > 0
    total = F.lit(0.0)
    for key in CONFIDENCE_KEYS:
        value = F.get_json_object(text, f"$.confidence_scores.{key}").try_cast("double")
        total = total + F.coalesce(value, F.lit(DEFAULT_CONFIDENCE))
    return responses.withColumn(
        out, F.when(some, total / len(CONFIDENCE_KEYS)).otherwise(_completeness(text))
    )

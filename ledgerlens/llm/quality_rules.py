"""Quality rules, line first: drop failing lines, then reject texts that lose too much."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm import words as W
from ledgerlens.llm.registry import documents, register
from ledgerlens.llm.text_batches import append_struct

SYMBOLS = "#*$%&|<>"
#: What ends the last word of a sentence: these, or one of … ” ’ ».
LINE_ENDS = W.byte_class(".!?\"'):;")
#: Boilerplate that makes a line of at most MAX_BOILER_WORDS words worthless.
BOILERPLATE = (
    r"(?i)all rights reserved|cookie|javascript|terms of (use|service)|privacy policy|"
    r"sign (in|up)|log in|subscribe|click here|read more|copyright|licen[cs]e|"
    r"share (this|on)|powered by|lorem ipsum"
)
MAX_BOILER_WORDS = 30
#: Shares of a line's words above which it fails.
MAX_BARS, MAX_SYMBOL_WORDS, MAX_SHOUTED, MAX_REPEATED = 0.2, 0.2, 0.5, 0.5
#: A text is rejected when fewer words are left, or a larger share of them is lost.
MIN_WORDS, MAX_LOST = 50, 0.5

STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_words",
)
OUTCOME = T.StructType(
    [T.StructField(name, T.LongType()) for name in STATS]
    + [T.StructField(name, T.BooleanType()) for name in ("base_failed", "kept")]
    + [T.StructField("clean_text", T.StringType())]
)


def _boilerplate_lines(data, starts, ends, n_words) -> np.ndarray:
    """Lines that are short enough and match the boilerplate patterns."""
    short = np.flatnonzero((n_words > 0) & (n_words <= MAX_BOILER_WORDS))
    raw = data.tobytes()
    lines = pa.array([raw[s:e] for s, e in zip(starts[short], ends[short], strict=True)],
                     pa.binary()).cast(pa.string())
    hit = pc.match_substring_regex(lines, BOILERPLATE).to_numpy(zero_copy_only=False)
    failed = np.zeros(len(starts), bool)
    failed[short[hit.astype(bool)]] = True
    return failed


def _ends_sentence(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the words that end there end a sentence, by their last UTF-8 bytes."""
    one, two, three = (data[np.maximum(ends - k, 0)] for k in (1, 2, 3))
    curled = (three == 0xE2) & (two == 0x80) & np.isin(one, [0xA6, 0x9D, 0x99])
    return LINE_ENDS[one] | curled | ((two == 0xC2) & (one == 0xBB))


def _outcomes(column: pa.Array, with_text: bool) -> pa.StructArray:
    parts: list[dict[str, np.ndarray]] = []
    texts: list[str | None] = []
    for first, end, data, bounds in W.slices(column):
        n = end - first
        count = lambda rows, n=n: np.bincount(rows, minlength=n)
        starts, ends, rows = W.split_words(data, bounds)
        spans = W.Spans(data)
        hashes = spans.hash(starts, ends)
        chars = W.totals((data & 0xC0) != 0x80)
        row_key = W.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))

        window, window_row = W.shingles(hashes, rows, 3)
        again, _ = W.repeated(window ^ row_key[window_row])
        at = np.flatnonzero(rows[:-2] == rows[2:]) if len(rows) > 2 else np.zeros(0, np.int64)
        in_repeat = np.zeros(len(rows), bool)
        for k in range(3):
            in_repeat[at[again] + k] = True

        line_start, line_end, line_row = W.split_lines(data, bounds)
        word_line = np.searchsorted(line_start, starts, "right") - 1
        # Lines that start together are empty but for the last of them, which search finds.
        per_line = lambda flag, m=len(line_start), x=word_line: np.bincount(
            x[flag], minlength=m
        )
        line_words = per_line(slice(None))
        solid = line_words > 0
        line_hash = spans.hash(line_start[solid], line_end[solid])
        _, later = W.repeated(line_hash ^ row_key[line_row[solid]])

        inside = lambda table: W.totals(table[data])
        in_word = lambda sums: sums[ends] - sums[starts]
        symbols = W.totals(W.byte_class(SYMBOLS)[data])
        bars = inside(W.byte_class("|"))
        upper = in_word(inside(W.byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
        lower = in_word(inside(W.byte_class("abcdefghijklmnopqrstuvwxyz")))
        letters = upper + lower > 0
        n_letters = per_line(letters)
        sentence = per_line(_ends_sentence(data, ends)) > 0
        failed = solid & (
            ~sentence
            | (per_line(in_word(bars) > 0) > MAX_BARS * line_words)
            | (per_line(in_word(symbols) > 0) > MAX_SYMBOL_WORDS * line_words)
            | (per_line((upper >= 2) & (lower == 0)) > MAX_SHOUTED * np.maximum(n_letters, 1))
            | ((line_words >= 12) & (per_line(in_repeat) > MAX_REPEATED * line_words))
            | _boilerplate_lines(data, line_start, line_end, line_words)
        )
        n_words, n_repeat = count(rows), count(rows[in_repeat])
        lost = np.bincount(line_row, line_words * failed, minlength=n).astype(np.int64)
        base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)
        left = n_words - lost
        parts.append(
            {
                "n_words": n_words,
                "word_chars": np.bincount(rows, chars[ends] - chars[starts], minlength=n),
                "n_symbols": symbols[bounds[1:]] - symbols[bounds[:-1]],
                "n_dup_lines": count(line_row[solid][later]),
                "n_repeat_words": n_repeat,
                "kept_words": left,
                "base_failed": base_failed,
                "kept": ~base_failed & (left >= MIN_WORDS) & (lost <= MAX_LOST * n_words),
            }
        )
        if with_text:
            raw = data.tobytes()
            cut = np.zeros(n, bool)
            cut[line_row[failed]] = True
            line_bounds = np.searchsorted(line_row, np.arange(n + 1))
            for row in range(n):
                if not cut[row]:
                    texts.append(raw[bounds[row] : bounds[row + 1]].decode())
                    continue
                own = range(line_bounds[row], line_bounds[row + 1])
                keep = [raw[line_start[i] : line_end[i]] for i in own if not failed[i]]
                texts.append(b"\n".join(keep).decode())
    arrays = []
    for field in OUTCOME.fields[:-1]:
        kind = pa.bool_() if isinstance(field.dataType, T.BooleanType) else pa.int64()
        values = np.concatenate([p[field.name] for p in parts]) if parts else np.zeros(0)
        arrays.append(pa.array(values.astype(kind.to_pandas_dtype()), kind))
    arrays.append(pa.array(texts if with_text else [None] * len(column), pa.string()))
    return pa.StructArray.from_arrays(arrays, names=OUTCOME.names)


def with_quality(
    df: DataFrame,
    text_col: str = "text",
    out: str = "quality",
    with_text: bool = True,
    keep_text: bool = True,
) -> DataFrame:
    """Append one struct column ``out`` (see ``OUTCOME``) to all columns of ``df``.

    Words are runs of anything but ASCII white space. A line fails when no word of
    it ends a sentence, it is navigation (bars), symbols, shouted (no lower-case letters) or repeated
    phrases for the most part, or is short boilerplate; lines without a word never fail.
    ``clean_text`` is what is left. A text is kept unless it has fewer than 50 words, half
    of its words stand in repeated phrases, fewer than 50 words are left, or more than half
    of them are lost. A missing or empty text has zero counts and is not kept. The work is
    one pass without a shuffle, in slices of a batch, so memory does not grow with rows.
    Without ``keep_text`` the result has all columns but the source text.
    """
    return append_struct(df, text_col, out, OUTCOME, partial(_outcomes, with_text=with_text), keep_text)


@register(
    "op3_quality_rules",
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
              string_split(t, chr(10)) AS ls FROM d),
        win AS (SELECT doc_id, i, ws[i : i + 2] AS x FROM (
              SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
        dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
        cov AS (SELECT DISTINCT doc_id, i + k AS p
                FROM dup, (SELECT unnest([0, 1, 2]) AS k)),
        rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM cov GROUP BY doc_id),
        line AS (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS li FROM w),
        lw AS (SELECT doc_id, l, li, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS ws FROM line),
        pos AS (SELECT *, coalesce(sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY li
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM lw),
        lrep AS (SELECT pos.doc_id, li, count(*) AS n FROM pos JOIN cov
                  ON pos.doc_id = cov.doc_id AND p > base AND p <= base + len(ws)
                  GROUP BY ALL),
        f AS (SELECT pos.doc_id, len(ws) AS n, len(ws) > 0 AND (
              NOT regexp_matches(l, '[.!?"'')\x3A;…”’»]([\x20\x09-\x0D]|$)')
              OR len(list_filter(ws, lambda x: contains(x, '|'))) > 0.2 * len(ws)
              OR len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&|<>]'))) > 0.2 * len(ws)
              OR len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z].*[A-Z]')
                       AND NOT regexp_matches(x, '[a-z]')))
                 > 0.5 * greatest(1, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]'))))
              OR (len(ws) >= 12 AND coalesce(lrep.n, 0) > 0.5 * len(ws))
              OR (len(ws) <= 30 AND regexp_matches(l, '"""
    + BOILERPLATE
    + r"""'))) AS failed
              FROM pos LEFT JOIN lrep USING (doc_id, li)),
        lost AS (SELECT doc_id, sum(CASE WHEN failed THEN n ELSE 0 END) AS lost
                 FROM f GROUP BY doc_id),
        s AS (SELECT doc_id, len(ws) AS n_words,
              coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
              len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
              (len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
               - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x,
                     '[^\x20\x09-\x0D]'))))) AS n_dup_lines,
              coalesce(n_repeat_words, 0) AS n_repeat_words, lost
              FROM w LEFT JOIN rep USING (doc_id) JOIN lost USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
                 AND n_words - lost >= 50 AND lost <= 0.5 * n_words AS kept
        FROM s""",
)
def op3(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text")
    done = with_quality(rows, with_text=False)
    columns = [*STATS[:-1], "base_failed", "kept"]
    return done.select("doc_id", *[F.col("quality")[c].alias(c) for c in columns])

"""Personal data, also when disguised: normalise with offsets, detect, map back."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.registry import documents, register
from ledgerlens.llm.text_batches import append_struct

KINDS = ("email", "ip", "card", "phone")
OUTCOME = T.StructType(
    [T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS]
    + [T.StructField(name, T.StringType()) for name in ("base_sha256", "spans", "masked_text")]
)
Span = tuple[int, int, int]  # start, place in KINDS, end; code points

# -- detectors ----------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to both sides, so long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else (2 * digit - 9 if digit > 4 else 2 * digit)
    return total % 10 == 0


def _part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def detect(text: str) -> list[Span]:
    """All identifiers written plainly; per kind leftmost and without overlap."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_part_fits, m.groups()))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# -- transducers --------------------------------------------------------------------

# Letters of other scripts that look like ASCII letters.
_LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТХУІЈЅаеорсухіјѕһԁԛԝ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναι" + "‐‑‒–—−․·•∙",
        "ABEKMHOPCTXYIJSaeopcyxijshdqw" + "ABEZHIKMNOPTYXovai" + "------" + "....",
        strict=True,
    )
)
_INVISIBLE = "­​‌‍⁠﻿"
# The spelled digits.
_SPELLED = dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True))


def _compatible() -> dict[str, str]:
    """Characters whose compatibility form is one ASCII character, such as full-width ones."""
    made = {}
    for block in ((0x2460, 0x24FF), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0x2070, 0x209C)):
        for code in range(block[0], block[1] + 1):
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and "!" <= plain <= "~":
                made[chr(code)] = plain
    for zero in (0x0660, 0x06F0, 0x0966):  # decimal digits of other scripts
        made |= {chr(zero + k): str(k) for k in range(10)}
    return made


GLYPHS = _compatible() | _LOOKALIKES | dict.fromkeys(_INVISIBLE, "")
#: Cheap first look: no Latin-1 character but two is in the table.
_FOREIGN = re.compile("[^\0-\xac\xae-\xb6\xb8-\xff]|[\xad\xb7]")
_GLYPH = re.compile("[" + "".join(map(re.escape, GLYPHS)) + "]")
_ANY = "|".join(_SPELLED)
#: Three digits in a row of which at least one is spelled are a number read aloud.
_ALOUD = re.compile(
    rf"(?<![^\W_])(?:{_ANY}|[0-9])(?:[ \t,-]{{1,3}}(?:{_ANY}|[0-9])(?![^\W_])){{2,}}", re.IGNORECASE
)
_ALOUD_PART = re.compile(rf"({_ANY})|[ \t,-]+|[0-9]", re.IGNORECASE)
_PLUS = re.compile(r"(?:(?<![^\W_])plus|\+)[ \t]{1,3}(?=[0-9])", re.IGNORECASE)
_BRACKETED = re.compile(r"[ \t]{0,3}[\[({<][ \t]{0,3}(at|dot|@|\.)[ \t]{0,3}[\])}>][ \t]{0,3}", re.IGNORECASE)
_WORDED = re.compile(
    r"(?<=[A-Za-z0-9])[ \t]{1,3}(at|@)[ \t]{1,3}(?=[A-Za-z0-9-]+(?:[ \t]{1,3}dot[ \t]{1,3}|\.)[A-Za-z])",
    re.IGNORECASE,
)
_DOTTED = re.compile(r"(?<=[A-Za-z0-9])[ \t]{1,3}dot[ \t]{1,3}(?=[A-Za-z0-9])", re.IGNORECASE)
#: A local part said with "dot" before its last word, and a domain without one.
_DOT_BEFORE = re.compile(r"[ \t]dot[ \t]{1,3}\Z", re.IGNORECASE)
_PLAIN_DOMAIN = re.compile(r"[A-Za-z0-9-]+\.[A-Za-z0-9.-]*+(?![ \t]{1,3}dot[ \t])", re.IGNORECASE)
_SIGN = {"at": "@", "dot": ".", "@": "@", ".": "."}
#: Letters that match an ASCII one when case is ignored.
_FOLDED = {"ſ": "s", "ı": "i", "İ": "i"}
#: What every text that a transducer changes has, on folded text: looser forms of the
#: patterns above, which start with a set of few characters or are plain substrings.
_GATES = tuple(map(re.compile, (
    rf"(?:{_ANY})[ \t,-]{{1,3}}(?:{_ANY}|[0-9])|[0-9][ \t,-]{{1,3}}(?:{_ANY})",
    r"plus[ \t]{1,3}[0-9]",
    r"\+[ \t]{1,3}[0-9]",
    r"[\[({<][ \t]{0,3}(?:at|dot|@|\.)[ \t]{0,3}[\])}>]",
    r"[ \t]at[ \t]{1,3}[a-z0-9-]+(?:\.[a-z]|[ \t]{1,3}dot[ \t])",
)))
_PIECES = (" dot ", "\tdot", "dot\t", "@ ", " @", "@\t", "\t@")
#: Words of prose that stand before "at" and a place; no one's mailbox is called so.
_PROSE = frozenset(
    "am are arrive arrived be been begin begins buy bought check checked ended find found "
    "had has have he held her here him hosted is it listed live lives living look looked "
    "looking looks me meet meeting meets met more not now only or published read register "
    "registered see seen she sign sold started stay stayed stop stopped that them there "
    "they this today us visit was we were work worked working works you".split()
)


class Tape:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, pattern: re.Pattern, change) -> None:
        """Replace each match by ``change(match)``: ``(text, first, end)`` pieces, where
        each character of a piece stands for the match's characters ``first`` to ``end``."""
        parts, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            parts.append(self.text[at : m.start()])
            starts += self.starts[at : m.start()]
            ends += self.ends[at : m.start()]
            for piece, first, end in change(m):
                parts.append(piece)
                starts += [self.starts[first]] * len(piece)
                ends += [self.ends[end - 1]] * len(piece)
            at = m.end()
        if at:
            parts.append(self.text[at:])
            self.text = "".join(parts)
            self.starts, self.ends = starts + [*self.starts[at:]], ends + [*self.ends[at:]]


def _aloud(m: re.Match) -> list[tuple[str, int, int]]:
    if not any(c.isalpha() for c in m[0]):
        return [(c, k, k + 1) for k, c in enumerate(m[0], m.start())]
    out = []
    for part in _ALOUD_PART.finditer(m.string, m.start(), m.end()):
        if part[1]:
            word = "".join(_FOLDED.get(c, c) for c in part[1]).lower()
            out.append((_SPELLED[word], part.start(), part.end()))
        elif part[0].isdigit():
            out.append((part[0], part.start(), part.end()))
    return out


def _sign(m: re.Match) -> list[tuple[str, int, int]]:
    """The sign stands for the word and the space around it."""
    sign = _SIGN[m[m.lastindex].lower()] if m.lastindex else "."
    return [(sign, m.start(), m.end())]


def _worded(m: re.Match) -> list[tuple[str, int, int]]:
    """As ``_sign``, but prose such as "meet at acme.com" stays: a lone word of ``_PROSE``,
    "at", and a domain written plainly."""
    text, start = m.string, m.start()
    while start and m.start() - start < 16 and text[start - 1] in _LOCAL:
        start -= 1
    if m[1] != "@" and text[start : m.start()].lower() in _PROSE:
        if not _DOT_BEFORE.search(text, max(0, start - 7), start) and _PLAIN_DOMAIN.match(text, m.end()):
            return [(c, k, k + 1) for k, c in enumerate(m[0], m.start())]
    return _sign(m)


def _open(text: str) -> bool:
    """Whether a transducer may change the text: true for each that one does change, and
    quick. What is prose and what a disguise is decided at the match."""
    if not text.isascii():
        if _FOREIGN.search(text) and not GLYPHS.keys().isdisjoint(text):
            return True
        for odd, plain in _FOLDED.items():
            text = text.replace(odd, plain)
    text = text.lower()
    return any(x in text for x in _PIECES) or any(x.search(text) for x in _GATES)


def normalised(text: str) -> Tape | None:
    """The text without disguises; None when it has none."""
    if not _open(text):
        return None
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite(_GLYPH, lambda m: [(GLYPHS[m[0]], m.start(), m.end())])
    tape.rewrite(_ALOUD, _aloud)
    tape.rewrite(_PLUS, lambda m: [("+", m.start(), m.end())])
    tape.rewrite(_BRACKETED, _sign)
    tape.rewrite(_WORDED, _worded)
    tape.rewrite(_DOTTED, _sign)
    return tape if tape.text != text else None


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Spans written plainly, and those with the disguised ones besides."""
    base = detect(text)
    tape = normalised(text)
    if tape is None:
        return base, base
    added = []
    for start, kind, end in detect(tape.text):
        span = (tape.starts[start], kind, tape.ends[end - 1])
        # Next to a plain one only if it holds all of that and more.
        near = [(s, e) for s, k, e in base if k == kind and span[0] < e and s < span[2]]
        if all(span[0] <= s and e <= span[2] and (s, e) != (span[0], span[2]) for s, e in near):
            added.append(span)
    return base, sorted(base + added)


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def mask(text: str, spans: list[Span]) -> str:
    """The text with a mark in place of each span; overlapping spans share one mark."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _outcomes(column: pa.Array, with_text: bool) -> pa.StructArray:
    rows: dict[str, list] = {name: [] for name in OUTCOME.names}
    for value in column:
        text = value.as_py() or ""
        base, spans = find(text)
        for k, kind in enumerate(KINDS):
            rows[f"n_{kind}"].append(sum(x[1] == k for x in base))
        rows["base_sha256"].append(hashlib.sha256(_listed(base).encode()).hexdigest())
        rows["spans"].append(_listed(spans))
        rows["masked_text"].append(mask(text, spans) if with_text else None)
    arrays = [
        pa.array(rows[f.name], pa.int64() if f.name[:2] == "n_" else pa.string())
        for f in OUTCOME.fields
    ]
    return pa.StructArray.from_arrays(arrays, names=OUTCOME.names)


def with_personal_data(
    df: DataFrame,
    text_col: str = "text",
    out: str = "personal",
    with_text: bool = True,
    keep_text: bool = True,
) -> DataFrame:
    """Append one struct column ``out`` (see ``OUTCOME``) to all columns of ``df``.

    Plain identifiers (e-mail, IP address, card, phone) are found in the text as it is.
    Then transducers replace look-alike letters and digits of other scripts, remove
    invisible characters, read numbers spelled digit by digit, and undo "at" and "dot"
    disguises (a word of prose, "at" and a plain domain, as in "meet at acme.com", is none);
    identifiers found in that text are mapped back to source characters and added; next to a plain one of the same kind only where they hold all of it and more. Counts and
    ``base_sha256`` are of the plain ones, ``spans`` and ``masked_text`` of all. A missing
    or empty text has none of them and an empty masked text. One pass without a shuffle, in
    slices of a batch. Without ``keep_text`` the result has all columns but the source text.
    """
    return append_struct(df, text_col, out, OUTCOME, partial(_outcomes, with_text=with_text), keep_text)


@register("op4_personal_data")
def op4(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text")
    done = with_personal_data(rows, with_text=False)
    columns = [f"n_{kind}" for kind in KINDS] + ["base_sha256", "spans"]
    return done.select("doc_id", *[F.col("personal")[c].alias(c) for c in columns])

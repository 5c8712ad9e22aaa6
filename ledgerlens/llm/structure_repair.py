"""Cheapest repair of conversation structure, by Four-Russians block tables.

The costs to finish from each state of the turn grammar form a short vector whose
differences are bounded, so there are few of them. For every vector and every block of
``BLOCK`` row symbols a table holds the vector before the block and what it adds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.registry import conversations, crc32_sql, register

#: Rows of a block; the tables hold 9 ** BLOCK entries for each vector.
BLOCK = 4
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: White space of the word rule, for trimming.
BLANKS = " \t\n\x0b\f\r"

# States of `(s?(ua)+)?`: nothing yet, after s, after u, after a. Each has one way on by
# user or assistant, so the letters of an audit alone determine the repair.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ONWARD = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: Role that rerole and insert give in each state.
GIVEN = ("user", "user", "assistant", "user")
KEEPS = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
INITIALS = "sua"
#: Symbol of a row that must go; others are 1 + 2 * initial (of s, u, a, other) + truncated.
GONE, SYMBOLS = 0, 9
END = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")


def _moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row, by letter."""
    moves = [("D", DELETE, state)]
    if symbol != GONE:
        initial, cut = divmod(symbol - 1, 2)
        kept = KEEPS.get(INITIALS[initial : initial + 1], {}).get(state)
        if kept is not None:
            moves.append(("K", TRUNCATED * cut, kept))
        moves.append(("R", REROLE + TRUNCATED * cut, ONWARD[state]))
    return moves


def _before(costs: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs to finish from each state before a row, from those after it."""
    v = [min(cost + costs[to] for _, cost, to in _moves(symbol, s)) for s in range(4)]
    v[AFTER_U], v[AFTER_A] = (
        min(v[AFTER_U], INSERT + v[AFTER_A]), min(v[AFTER_A], INSERT + v[AFTER_U]),
    )
    v[START], v[AFTER_S] = (min(v[s], INSERT + v[AFTER_U]) for s in (START, AFTER_S))
    return tuple(v)


def _letters(after: tuple[int, ...], now: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits up to and with a row: letters and the next state."""
    out = ""
    while True:
        found = {x: to for x, cost, to in _moves(symbol, state) if now[state] == cost + after[to]}
        if now[state] == INSERT + now[ONWARD[state]]:
            found["I"] = ONWARD[state]
        letter = min(found)
        out, state = out + letter, found[letter]
        if letter != "I":
            return out, state


class BlockTables:
    """Transitions of normalised vectors for every symbol and for every block of symbols."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        vectors, ids = [END], {END: 0}
        onward, added, trace = [], [], []
        for v in vectors:  # grows until no vector is new
            row, add, letters = [], [], []
            for symbol in range(SYMBOLS):
                now = _before(v, symbol)
                low = min(now)
                flat = tuple(x - low for x in now)
                if flat not in ids:
                    ids[flat] = len(vectors)
                    vectors.append(flat)
                row.append(ids[flat])
                add.append(low)
                letters.append([_letters(v, now, symbol, s) for s in range(4)])
            onward.append(row)
            added.append(add)
            trace.append(letters)
        self.vectors, self.trace, self.step = vectors, trace, onward
        one, plus = np.array(onward, np.int32), np.array(added, np.int32)
        self.one_added = added
        to, sums = one, plus
        for _ in range(block - 1):  # one more symbol before the block so far
            size = to.shape[1]
            wide = to[:, None, :].repeat(SYMBOLS, 1).reshape(len(to), -1)
            first = np.arange(SYMBOLS).repeat(size)[None, :]
            sums = np.tile(sums, (1, SYMBOLS)) + plus[wide, first]
            to = one[wide, first]
        self.to, self.sums = to, sums
        self.places = SYMBOLS ** np.arange(block - 1, -1, -1)

    def repair(self, symbols: np.ndarray) -> tuple[int, str]:
        """Cost and audit of the cheapest edits of a conversation's row symbols.

        Blocks are taken from the end, by lookup; what is kept is one vector for each. The
        trace then runs from the start, and expands one block at a time backward.
        """
        n, t = len(symbols), self.block
        odd = n % t
        codes = symbols[odd:].reshape(-1, t) @ self.places
        vector, cost, ends = 0, 0, [0] * len(codes)
        for k in range(len(codes) - 1, -1, -1):
            ends[k] = vector
            cost += int(self.sums[vector, codes[k]])
            vector = int(self.to[vector, codes[k]])
        before = vector
        for symbol in symbols[:odd][::-1].tolist():
            cost += self.one_added[vector][symbol]
            vector = self.step[vector][symbol]
        cost += self.vectors[vector][START]
        pieces, state = [], START
        starts = [(0, odd, before)] if odd else []
        starts += [(odd + k * t, odd + (k + 1) * t, end) for k, end in enumerate(ends)]
        for first, last, end in starts:
            rows = symbols[first:last].tolist()
            after = [end]
            for symbol in rows[:0:-1]:
                after.append(self.step[after[-1]][symbol])
            for symbol, vector in zip(rows, reversed(after), strict=True):
                letters, state = self.trace[vector][symbol][state]
                pieces.append(letters)
        return cost, "".join(pieces) + TAIL[state]


@cache
def tables(block: int = BLOCK) -> BlockTables:
    return BlockTables(block)


# -- rows ---------------------------------------------------------------------------


def _facts(df: DataFrame) -> DataFrame:
    """What decides about a row, without its text; ``present`` is false on rows that only
    say that their conversation exists."""
    rest = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    has_initial = F.length("role") > 0
    return df.select(
        "conv_id", "turn", "present", _digest().alias("digest"),
        F.when(has_initial, initial).otherwise(0).cast("byte").alias("initial"),
        (rest == "").alias("blank"), (~F.right(rest, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )


def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


class _Conversation:
    """Running state over the ordered rows of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.seen, self.symbols = conv_id, set(), bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.low, self.last, self.role = 0, None, None, None

    def add(self, turn, digest: bytes, initial: int, blank: bool, cut: bool) -> None:
        if self.role is not None:
            self.illegal += (self.role, initial) not in ((1, 2), (2, 3), (3, 2))
        self.role = initial
        if turn is not None and turn != self.last:
            self.low = turn if self.low is None else self.low
            self.last = turn
            self.turns += 1
        symbol = GONE
        if blank:
            self.blank += 1
        elif digest in self.seen:
            self.duplicate += 1
        else:
            self.truncated += cut
            symbol = 1 + 2 * (initial - 1 if initial else 3) + cut
        self.seen.add(digest)
        self.symbols.append(symbol)

    def row(self) -> tuple:
        cost, audit = tables().repair(np.frombuffer(self.symbols, np.uint8).astype(np.int64))
        gaps = self.last - self.low + 1 - self.turns if self.turns else 0
        faults = self.blank, self.duplicate, self.truncated, self.illegal
        return (self.conv_id, gaps, *faults, cost, audit)


REPORT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
_REPORT_KINDS = [*[pa.int64()] * 7, pa.string()]


def _batch(rows: list[tuple], names, kinds) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, list(names))


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Conversation | None = None
    for batch in batches:
        done = []
        for conv_id, present, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.row())
                now = _Conversation(conv_id)
            if present:
                now.add(*row)
        if done:
            yield _batch(done, REPORT, _REPORT_KINDS)
    if now is not None:
        yield _batch([now.row()], REPORT, _REPORT_KINDS)


def _marked(df: DataFrame) -> DataFrame:
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
        F.col("present") if "present" in df.columns else F.lit(True).alias("present"),
    )
    return rows.withColumn("digest", _digest())


def audits(df: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` per conversation.

    ``df`` has ``conv_id, turn, role, text``, and may have a boolean ``present``: where it
    is false, the row only says that its conversation exists; other columns play no part.
    Rows are taken by turn, missing ones first and equal ones by the MD5 of role and text.
    A missing role or text is one space; rows without a conversation id are one conversation.
    The shuffle carries no texts, and a conversation takes 17 bytes a row in its task.
    """
    rows = _facts(_marked(df)).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest")
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return rows.select("conv_id", "present", "turn", "digest", "initial", "blank", "cut").mapInArrow(
        _audits, schema
    )


def _repaired(report: tuple, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that the audit leaves."""
    state = START
    for letter in report[-1]:
        if letter == "I":
            yield letter, GIVEN[state], ""
            state = ONWARD[state]
            continue
        role, text = next(rows)
        if letter == "K":
            yield letter, role, text
            state = KEEPS[role[:1]][state]
        elif letter == "R":
            yield letter, GIVEN[state], text
            state = ONWARD[state]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[str, str, str]]]]:
    """(report, repaired turns) of one conversation after the other; each comes with its
    report first, then its rows in order. The turns are to be used before the next one."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    report = next(rows, None)
    while report is not None:
        following: list[tuple] = []

        def own(following=following) -> Iterator[tuple[str, str]]:
            for row in rows:
                if row[7] is not None:  # the next conversation's report
                    following.append(row)
                    return
                yield row[8], row[9]

        mine = own()
        yield report[:8], _repaired(report[:8], mine)
        for _ in mine:
            pass
        report = following[0] if following else None


def _ordered(df: DataFrame) -> DataFrame:
    """Every conversation's report, then its rows in order, texts included."""
    rows = _marked(df).where("present")
    none = {c: F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in REPORT[1:]}
    rows = rows.select("conv_id", *none.values(), "role", "text", F.lit(1).alias("kind"), "turn", "digest")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("text", "string"))]
    reports = audits(df).select(
        *REPORT, *empty, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"),
        F.lit(None).cast("binary").alias("digest"),
    )
    both = reports.unionByName(rows).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "kind", "turn", "digest").select(*REPORT, "role", "text")


def repaired_turns(df: DataFrame) -> DataFrame:
    """``conv_id, position, edit, role, text``: the turns after the repair (see :func:`audits`
    for ``df``). ``edit`` is K (kept), R (other role) or I (inserted); a conversation of
    which nothing is left has no turn."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "position", "edit", "role", "text"]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3]
        held, size = [], 0
        for report, turns in _walk(batches):
            for k, turn in enumerate(turns):
                held.append((report[0], k, *turn))
                size += len(turn[2])
                if size > 1 << 20 or len(held) >= 5_000:
                    yield _batch(held, names, kinds)
                    held, size = [], 0
        if held:
            yield _batch(held, names, kinds)

    return _ordered(df).mapInArrow(work, "conv_id long, position long, edit string, role string, text string")


def repair_report(df: DataFrame) -> DataFrame:
    """:func:`audits` with ``repaired_sha256``, the hash of the repaired ``role:text`` lines.

    Texts are streamed through the hash in order, so a task never holds a conversation's.
    Without rows a conversation has zeros, an empty audit and the hash of an empty string;
    an empty table has no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for report, turns in _walk(batches):
            digest = hashlib.sha256()
            for k, (_, role, text) in enumerate(turns):
                digest.update(f"{chr(10) if k else ''}{role}:{text}".encode())
            done.append((*report, digest.hexdigest()))
            if len(done) >= 2_000:
                yield _batch(done, (*REPORT, "repaired_sha256"), [*_REPORT_KINDS, pa.string()])
                done = []
        if done:
            yield _batch(done, (*REPORT, "repaired_sha256"), [*_REPORT_KINDS, pa.string()])

    schema = (
        "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
        "cost long, audit string, repaired_sha256 string"
    )
    return _ordered(df).mapInArrow(work, schema)


def damaged(df: DataFrame) -> DataFrame:
    """Rows as the test of the repair has them: by ``crc32("conv_id:turn") % 20``, 0 is not
    ``present``, 1 has no text, 2 no sentence ends, 3 comes twice, 4 is the user's."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    role, text = shown("role"), shown("text")
    rows = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault"))
    kept = F.when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").otherwise(kept).alias("text"),
        (F.col("fault") > 0).alias("present"), F.explode(copies).alias("copy"),
    ).drop("copy")


# -- the SQL twin: costs and audits as strings that sort by cost, then by letters -----


def _plus(value: str, cost, letter: str) -> str:
    return f"(lpad((left({value}, 9)::INT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({value}, 10))"


def _step_sql() -> str:
    """Best of delete, keep and rerole in each state (b0 to b3), from v0 to v3 and the row."""
    on = (2, 2, 3, 2)
    keep = ((("s", 1), ("u", 2)), (("u", 2),), (("a", 3),), (("u", 2),))
    out = []
    for s in range(4):
        kept = "".join(
            f" WHEN k.ini = '{i}' THEN {_plus(f'v{to}', 'CASE WHEN cut THEN 3 ELSE 0 END', 'K')}"
            for i, to in keep[s]
        )
        out.append(
            f"least({_plus(f'v{s}', 4, 'D')}, CASE WHEN gone THEN '~'{kept} ELSE '~' END, "
            f"CASE WHEN gone THEN '~' ELSE {_plus(f'v{on[s]}', 'CASE WHEN cut THEN 6 ELSE 3 END', 'R')} END) AS b{s}"
        )
    return ", ".join(out)


def _sql() -> str:
    insert = lambda v: _plus(v, 3, "I")
    return rf"""WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role,
            coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' ||
              coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        f AS (SELECT *, {crc32_sql("k")} % 20 AS f FROM o),
        d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
              CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
              unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE f <> 0),
        r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id
                ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS p FROM d),
        s AS (SELECT *, left(role, 1) AS ini, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
              row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS seen,
              NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open,
              lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS prev FROM r),
        k AS (SELECT *, blank OR seen AS gone, open AS cut FROM s),
        c AS (SELECT DISTINCT conv_id FROM conversations),
        base AS (SELECT c.conv_id, count(p) AS n,
              coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
              count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate,
              count(*) FILTER (open AND NOT blank AND NOT seen) AS truncated,
              count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal
              FROM c LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
        v AS (SELECT conv_id, n + 1 AS p, '000000000' AS v0, '000000006II' AS v1,
                '000000003I' AS v2, '000000000' AS v3 FROM base
              UNION ALL
              SELECT conv_id, p, least(b0, {insert("w2")}), least(b1, {insert("w2")}), w2, w3
              FROM (SELECT *, least(b2, {insert("b3")}) AS w2, least(b3, {insert("b2")}) AS w3
                    FROM (SELECT v.conv_id, v.p - 1 AS p, {_step_sql()}
                          FROM v JOIN k ON k.conv_id IS NOT DISTINCT FROM v.conv_id AND k.p = v.p - 1))),
        best AS (SELECT conv_id, left(v0, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM v WHERE p = 1),
        t AS (SELECT conv_id, audit, 0 AS j, 0 AS i, 0 AS s, NULL::VARCHAR AS line FROM best
              UNION ALL
              SELECT t.conv_id, audit, j + 1, CASE WHEN e = 'I' THEN i ELSE i + 1 END,
                CASE WHEN e = 'D' THEN s WHEN e = 'K' AND k.ini = 's' THEN 1
                     WHEN s = 2 THEN 3 ELSE 2 END,
                CASE e WHEN 'D' THEN NULL WHEN 'K' THEN k.role || ':' || k.text
                  WHEN 'I' THEN CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END
                  ELSE CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END || k.text END
              FROM (SELECT *, audit[j + 1] AS e FROM t WHERE j < length(audit)) t
              LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM t.conv_id AND k.p = i + 1),
        h AS (SELECT conv_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY j), '')) AS repaired_sha256
              FROM t GROUP BY conv_id)
        SELECT base.conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256
        FROM base JOIN best ON best.conv_id IS NOT DISTINCT FROM base.conv_id
        JOIN h ON h.conv_id IS NOT DISTINCT FROM base.conv_id"""


@register("op12_structure_repair", _sql())
def op12(spark, sf_dir):
    return repair_report(damaged(conversations(spark, sf_dir)))

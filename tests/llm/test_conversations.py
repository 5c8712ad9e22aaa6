import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import types as T

from ledgerlens.llm.prefix_trie import conversation_trie, sweep
from ledgerlens.llm.structure_repair import BlockTables, damaged, repair_report, repaired_turns

sys.setrecursionlimit(10_000)
SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("key", T.StringType()),  # clash with names inside the operators
        T.StructField("depth", T.LongType()),
        T.StructField("path", T.MapType(T.StringType(), T.StringType())),
        T.StructField("n", T.LongType()),
        T.StructField("audit", T.StringType()),
    ]
)


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, {"a": "b"}, 2, "x") for r in rows], SCHEMA).repartition(3)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text))


def turn_id(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def tried(rows):
    """Brute force: every prefix of every rebuilt conversation is a key."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, turn_id(role or "", text or ""), role or "", text or ""))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].add(c)
        ends[whole].append(c)
    leaves, saved, kids = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * (words(p[-1][1]) if p else 0)
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def trie_rows(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def odd_conversations():
    rng = random.Random(5)
    rows = []
    for c in range(-25, 130):
        for t in range(rng.randrange(0, 6)):
            say = rng.choice(["same words here", "", None, "a b", f"turn {rng.randrange(3)}"])
            rows.append((c, t, rng.choice(["user", "assistant", None, "system"]), say))
    rows += [(200, t, "user", "again and again") for t in (None, 1, 1, 2)] * 2  # ties, repeats
    rows += [(c, t, "user", "a copy of all") for c in range(300, 340) for t in range(20)]
    rows += [(c, t, "user", f"fork {t if t < c - 400 else c}") for c in range(400, 410) for t in range(12)]
    rows += [(None, 1, "user", "nobody's"), (500, 0, "user", "long " * 40_000)]
    return rows


@pytest.mark.parametrize("burst_turns", [5, 60, 100_000])
def test_trie_equals_brute_force(spark, burst_turns):
    rows = odd_conversations()
    df = table(spark, rows)
    assert trie_rows(conversation_trie(df, burst_turns=burst_turns)) == tried(rows)


def test_trie_with_shuffled_heads(spark, monkeypatch):
    from ledgerlens.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "BROADCAST_HEADS", 0)
    rows = odd_conversations()
    assert trie_rows(conversation_trie(table(spark, rows), burst_turns=20)) == tried(rows)


def test_trie_of_nothing(spark):
    assert conversation_trie(table(spark, [])).collect() == []
    assert conversation_trie(table(spark, [(None, 1, "user", "x")])).collect() == []


def test_turnless_conversations(spark):
    rows = [(20, 0, "user", "a"), (21, 0, "user", "b"), (41, 0, "user", "c"), (43, 0, "user", "d")]
    assert trie_rows(conversation_trie(table(spark, rows))) == tried(rows)


def test_sweep_of_one_container():
    a, b = b"a" * 16, b"b" * 16
    rows = [(a, [2], 9, 1, "x"), (a + b, [2, 3], 4, 2, "y"), (b, [5], 7, 1, "z")]
    got = {(n[2], n[3]): n[4:] for n in sweep(b"k", None, 0, rows)}
    assert got[(4, 0)][0] is None and got[(4, 0)][1:5] == [4, 2, 2, 2 * 2 + 3]
    assert got[(4, 1)][:5] == [4, 3, 1, 1, 2 * 2 + 3] and got[(4, 1)][5] == "x"
    assert got[(4, 2)][:5] == [4, 2, 0, 1, 3] and got[(7, 1)][:5] == [4, 1, 0, 1, 0]


# -- structure repair ---------------------------------------------------------------


def best_edits(symbols):
    """(cost, letters) by plain recursion over rows, states and edits, no tables."""
    onward, keeps = (2, 2, 3, 2), ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})

    @cache
    def best(i, state, inserts):
        found = []
        if i == len(symbols) and state in (0, 3):
            found.append((0, ""))
        if inserts:
            cost, rest = best(i, onward[state], inserts - 1)
            found.append((cost + 3, "I" + rest))
        if i < len(symbols):
            initial, gone, cut = symbols[i]
            ways = [(4, "D", state)]
            if not gone:
                if initial in keeps[state]:
                    ways.append((3 * cut, "K", keeps[state][initial]))
                ways.append((3 + 3 * cut, "R", onward[state]))
            for price, letter, to in ways:
                cost, rest = best(i + 1, to, 3)
                found.append((cost + price, letter + rest))
        return min(found, default=(10**9, ""))

    return best(0, 0, 3)


def damage(rows):
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        shown = [" " if x is None else str(x) for x in (c, turn)]
        fault = zlib.crc32(":".join(shown).encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        yield from [(c, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)


def repaired_rows(rows, spoil=damage):
    out = {c: [] for c, *_ in rows}
    for c, turn, role, text in spoil(rows):
        out[c].append((turn is not None, turn or 0, turn_id(role, text), role, text))
    for c, found in out.items():
        found.sort()
        seen, symbols = set(), []
        counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for *_, role, text in found:
            said = re.findall(r"[^\x20\x09-\x0d]", text)
            blank, twice = not said, (role, text) in seen
            cut = not (said and said[-1] in ".!?")
            seen.add((role, text))
            fault = "blank" if blank else "duplicate" if twice else "truncated" if cut else None
            if fault:
                counts[fault] += 1
            symbols.append((role[:1], blank or twice, int(cut)))
        cost, audit = best_edits(tuple(symbols))
        state, lines, left = 0, [], iter(found)
        for letter in audit:
            row = next(left) if letter != "I" else None
            if letter == "D":
                continue
            role = row[3] if letter == "K" else ("assistant" if state == 2 else "user")
            lines.append(f"{role}:{row[4] if row else ''}")
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
        turns = {t for has, t, *_ in found if has}
        pairs = [a[0] + b[0] for a, b in zip(symbols, symbols[1:], strict=False)]
        yield (
            c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )


def by_conversation(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))


def broken_conversations():
    rng = random.Random(8)
    rows = []
    for c in range(-3, 160):
        for t in range(rng.randrange(0, 14)):
            say = rng.choice(["Yes.", "Why?", "cut off", " \n", "", None, "Ends. \x0b", "多.", "a "])
            role = rng.choice(["user", "assistant", "system", None, "", "tool", "assistant", "user"])
            rows.append((c, None if rng.random() < 0.05 else t * rng.choice([1, 1, 2]), role, say))
    rows += [(None, None, None, None), (None, 3, "user", "Hello."), (700, 1, "user", "x. " * 60_000)]
    rows += [(701, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(300)]
    rows += [(702, 5, "user", "Same.")] * 3
    return rows


def test_repair_equals_plain_recursion(spark):
    rows = broken_conversations()
    got = repair_report(damaged(table(spark, rows))).collect()
    assert by_conversation(got) == by_conversation(repaired_rows(rows))


def test_repair_of_rows_as_they_are(spark):
    rows = [r for r in broken_conversations() if r[0] is None or r[0] < 60]
    same = lambda rows: ((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows)
    df = table(spark, rows)
    got = by_conversation(repair_report(df).collect())
    assert got == by_conversation(repaired_rows(rows, same))
    turns = defaultdict(dict)
    for r in repaired_turns(df).collect():
        turns[r.conv_id][r.position] = f"{r.role}:{r.text}"
    for r in got:
        lines = [turns[r[0]][k] for k in range(len(turns[r[0]]))]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == r[-1]


def test_repair_of_nothing(spark):
    df = table(spark, [])
    assert repair_report(damaged(df)).collect() == repaired_turns(df).collect() == []
    gone = next(t for t in range(99) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    (row,) = repair_report(damaged(table(spark, [(1, gone, "user", "All is lost.")]))).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_block_tables(block):
    rng = random.Random(block)
    made = BlockTables(block)
    for _ in range(400):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.randrange(2)) for _ in range(rng.randrange(12))]
        codes = [0 if gone else 1 + 2 * "suax".index(i) + cut for i, gone, cut in rows]
        assert made.repair(np.array(codes, np.int64)) == best_edits(tuple(rows))

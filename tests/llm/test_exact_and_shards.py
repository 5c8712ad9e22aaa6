import re
import zlib
from collections import Counter

from ledgerlens.llm import exact_dedup, ring_shards
from ledgerlens.llm.exact_dedup import exact_duplicates
from ledgerlens.llm.ring_shards import capacities, plan_overflow, ring_shards as shards_of
from ledgerlens.llm.ring_shards import virtual_nodes
from tests.llm.common import odd_rows, prose, table


def norm(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def expected_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    return groups


def check_exact(spark, rows, **options):
    groups = expected_groups(rows)
    got = exact_duplicates(table(spark, rows), **options).collect()
    want = Counter()
    for i, t in rows:
        ids = groups[norm(t)]
        keep = None if None in ids else min(ids)
        want[(i, keep, len(ids), i == keep)] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want
    return got


def test_exact_duplicates(spark):
    assert all(r.text_sha256 for r in check_exact(spark, odd_rows(), digest_all=True))
    lazy = check_exact(spark, odd_rows())
    assert all((r.text_sha256 is not None) for r in lazy if r.group_size > 1)


def test_exact_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 0)
    check_exact(spark, odd_rows())


def test_exact_same_length_and_prefix(spark):
    rows = [(k, prose(5) + f" {k % 3}") for k in range(9)] + [(20, prose(5) + " 0")]
    check_exact(spark, rows)


def test_exact_empty_table(spark):
    assert exact_duplicates(table(spark, [])).collect() == []


def check_shards(spark, rows, shards=8, **options):
    got = shards_of(table(spark, rows), shards=shards, **options).collect()
    data = lambda t: (t or "").encode()
    want = Counter((i, len(data(t)) + 1, zlib.crc32(data(t))) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got, [len(slots.get(k, [])) for k in range(shards)]


def test_ring_is_balanced(spark):
    rows = odd_rows() + [(k, prose(k, 5)) for k in range(100, 400)]
    _, sizes = check_shards(spark, rows)
    assert max(sizes) - min(sizes) <= 1


def test_ring_with_a_hot_row(spark, monkeypatch):
    monkeypatch.setattr(ring_shards, "COPIES", 7)
    rows = [(1, "same")] * 200 + [(k, "other") for k in range(100)]
    _, sizes = check_shards(spark, rows)
    assert max(sizes) - min(sizes) <= 1


def test_slack_moves_only_what_overflows(spark):
    rows = [(k, prose(k, 3)) for k in range(400)]
    got, sizes = check_shards(spark, rows, slack=0.25)
    assert max(sizes) <= 63
    full = {k for k, n in enumerate(sizes) if n == max(capacities(400, 8, 0.25))}
    assert all(r.home_shard in full for r in got if r.shard != r.home_shard)
    got, _ = check_shards(spark, rows, slack=100.0)
    assert all(r.shard == r.home_shard for r in got)


def test_a_new_shard_takes_places_only_for_itself():
    def owner(nodes, place):
        return next((s for p, s in nodes if p >= place), nodes[0][1])

    before, after = virtual_nodes(8, 64), virtual_nodes(9, 64)
    moved = [(owner(before, p), owner(after, p)) for p in range(0, 65536, 7)]
    assert {b for a, b in moved if a != b} == {8}


def test_plan_keeps_every_key():
    pieces = plan_overflow([5, 0, 7, 1], [0, 1, 0, 1], [6, 7])
    assert sum(end - start for _, start, end, _, _ in pieces) == 13


def test_ring_empty_table(spark):
    assert shards_of(table(spark, [])).collect() == []

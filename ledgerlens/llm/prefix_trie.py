"""Prefix trie of conversations, built as a burst trie: containers of suffixes that grow too
large burst by their next turn; the others are sorted and swept into nodes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.registry import SPACE, conversations, crc32_sql, join_keys, register, text_or_empty
from ledgerlens.session import materialise

#: A container of more turns than this bursts, unless it is one sequence; so many turns
#: (about 300 bytes each) are swept in one go.
BURST_TURNS = 4_000
#: Conversation ids that are hashed as one piece of text.
ID_BLOCK_BITS = 12
#: Tables of burst heads up to this many rows are broadcast, larger ones are shuffled.
BROADCAST_HEADS = 50_000

ID_BYTES = 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = (
    "key binary, above binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
RESULT = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
)


def turn_sequences(df: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in order, as (id, words) structs.

    The id is the MD5 of role and text. Missing turn numbers come first, and equal ones go
    by that id. Only ids and word counts are shuffled, never texts.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    turn = F.struct(
        F.col("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("id"),
        F.regexp_count(text, F.lit(f"[^{SPACE}]+")).alias("words"),
    )
    rows = df.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), turn.alias("t"))
    ordered = F.sort_array(F.collect_list("t"))
    plain = F.transform(ordered, lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(plain.alias("turns"))


def rebuilt(turns: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """Give every conversation the first turns of the first one of its family of ids.

    Conversation c starts with the first ``crc32(c) % shared`` turns of conversation
    ``c - c % family``, and goes on with its own turns after as many.
    """
    c = F.col("conv_id")
    own = turns.withColumn("first", c - c % family).withColumn(
        "h", (F.crc32(c.cast("string")) % shared).cast("int")
    )
    heads = turns.where(c % family == 0).select(
        c.alias("first"), F.slice("turns", 1, shared - 1).alias("head")
    )
    none = F.slice(F.col("turns"), 1, 0)
    joined = own.join(heads, "first", "left").withColumn("head", F.coalesce("head", none))
    whole = F.concat(
        F.slice("head", F.lit(1), F.col("h")),
        F.slice("turns", F.col("h") + 1, F.size("turns")),
    )
    return joined.select("conv_id", whole.alias("turns"))


# -- distinct sequences -------------------------------------------------------------


def _hash_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of equal ``ids``, with the SHA-256 of its members; rows come sorted
    by ids and block."""
    names = ["ids", "words", "least", "n", "ends"]
    kinds = [pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]
    now, words, least, n, digest = None, None, 0, 0, None
    for batch in batches:
        done: list[tuple] = []
        for ids, w, low, count, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids != now or digest is None:
                if digest is not None:
                    done.append((now, words, least, n, digest.hexdigest()))
                now, words, least, n, digest = ids, w, low, 0, hashlib.sha256()
            elif n:
                digest.update(b",")
            n += count
            digest.update(members.encode())
        if done:
            columns = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )
    if digest is not None:
        last = [now, words, least, n, digest.hexdigest()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c], k) for c, k in zip(last, kinds, strict=True)], names
        )


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """``ids, words, least, n, ends``: each sequence once, with the least and the number of
    its conversations and the hash of all their ids.

    Ids are first joined in blocks, so a sequence held by a third of all conversations
    sends few rows to the task that hashes it, which streams over them.
    """
    ids = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    rows = convs.select(
        "conv_id", ids.alias("ids"), F.transform("turns", lambda t: t["words"]).alias("words"),
        F.shiftright("conv_id", ID_BLOCK_BITS).alias("block"),
    )
    members = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    blocks = rows.groupBy("ids", "block").agg(
        F.first("words").alias("words"), F.min("conv_id").alias("least"),
        F.count("*").alias("n"), F.array_join(members, ",").alias("members"),
    )
    ordered = blocks.repartition("ids").sortWithinPartitions("ids", "block")
    return ordered.select("ids", "words", "least", "n", "members").mapInArrow(
        _hash_members, "ids binary, words array<int>, least long, n long, ends string"
    )


# -- bursting -----------------------------------------------------------------------


def _size(ids: str = "ids") -> Column:
    return (F.length(ids) / ID_BYTES).cast("int")


def _prefix(depth: Column) -> Column:
    return F.substring(F.col("ids"), F.lit(1), depth * ID_BYTES)


def _key(depth: Column) -> Column:
    return F.unhex(F.md5(_prefix(depth)))


def _shared_turns(low: str, high: str) -> Column:
    """Leading turns that two sequences share."""
    least = F.least(_size(low), _size(high))
    place = lambda c, i: F.substring(F.col(c), i * ID_BYTES + 1, F.lit(ID_BYTES))
    differs = F.filter(
        F.sequence(F.lit(0), least - 1), lambda i: place(low, i) != place(high, i)
    )
    return F.when(least == 0, 0).otherwise(F.coalesce(F.get(differs, 0), least))


def burst(sequences: DataFrame, burst_turns: int) -> tuple[DataFrame, DataFrame]:
    """``(suffixes, heads)``: suffixes in containers small enough to be swept, and the trie
    heads above them.

    A container is named by the prefix that its sequences share. Every round counts the
    containers that are left; the turns that all of an oversized one share are skipped, as
    one head, and its sequences move on by the turn after. Rounds are as many as there are
    oversized branchings above each other, not turns.
    """
    rows = sequences.select(
        "*", F.lit(0).alias("depth"), F.lit(None).cast("binary").alias("above"),
        F.array().cast("array<binary>").alias("path"),
    ).withColumn("key", _key(F.col("depth")))
    columns = rows.columns
    settled, heads = [], []
    while True:
        turns = F.sum((_size() - F.col("depth")).cast("long"))
        big = rows.groupBy("key").agg(
            turns.alias("turns"), F.count("*").alias("sequences"),
            F.min("ids").alias("low"), F.max("ids").alias("high"),
        ).where((F.col("turns") > burst_turns) & (F.col("sequences") > 1))
        big = materialise(big.select("key", _shared_turns("low", "high").alias("stop")))
        if big.isEmpty():
            settled.append(rows)
            break
        marked = materialise(join_keys(rows, big, ["key"], "left", BROADCAST_HEADS))
        settled.append(marked.where("stop is null").select(columns))
        burst_rows = marked.where("stop is not null")
        following = F.substring(F.col("ids"), F.col("stop") * ID_BYTES + 1, F.lit(ID_BYTES))
        ended = _size() == F.col("stop")
        # Branches first, so that a hot head is combined before it meets in one task.
        branches = burst_rows.groupBy("key", following.alias("next")).agg(
            F.first("above").alias("above"), F.first("path").alias("path"),
            F.first("depth").alias("depth"), F.first("stop").alias("stop"),
            F.first(F.slice("words", F.greatest(F.lit(1), F.col("depth")),
                            F.col("stop") - F.greatest(F.lit(1), F.col("depth")) + 1)).alias("words"),
            F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"),
            F.max(F.when(ended, F.col("ends"))).alias("ends"),
        )
        heads.append(
            branches.groupBy("key").agg(
                F.first("above").alias("above"), F.first("path").alias("path"),
                F.first("depth").alias("depth"), F.first("stop").alias("stop"),
                F.first("words").alias("words"), F.min("conv_id").alias("conv_id"),
                F.sum("n_convs").alias("n_convs"),
                F.count_if(F.length("next") > 0).alias("n_children"),
                F.max("ends").alias("ends"),
            )
        )
        deeper = (F.col("stop") + 1).alias("depth")
        rows = burst_rows.where(~ended).select(
            *sequences.columns, deeper, F.col("key").alias("above"),
            F.concat("path", F.array("key")).alias("path"), _key(F.col("stop") + 1).alias("key"),
        )
        rows = rows.select(columns)
    everything = settled[0]
    for more in settled[1:]:
        everything = everything.unionByName(more)
    schema = (
        "key binary, above binary, path array<binary>, depth int, stop int, words array<int>, "
        "conv_id long, n_convs long, n_children long, ends string"
    )
    found = sequences.sparkSession.createDataFrame([], schema)
    for more in heads:
        found = found.unionByName(more)
    return everything, materialise(found)


# -- sweeping -----------------------------------------------------------------------


def sweep(key: bytes, above: bytes | None, top: int, rows: list[tuple]) -> list[list]:
    """Nodes of one container from its sorted sequences ``(ids, words, least, n, ends)``.

    ``top`` is the depth of the node that all of them start with. A stack holds the open
    path; a node is closed, and gives its totals to its parent, when a sequence leaves it.
    """
    nodes: list[list] = []  # of NODE; parents are places in the list until the end
    stack: list[int] = []
    words_of: list[int] = []
    before = b""
    for ids, words, least, n, ends in rows:
        size = len(ids) // ID_BYTES
        common = top - 1
        if stack:
            most = min(size, len(before) // ID_BYTES)
            common = top
            while common < most and (
                ids[common * ID_BYTES : (common + 1) * ID_BYTES]
                == before[common * ID_BYTES : (common + 1) * ID_BYTES]
            ):
                common += 1
        while len(stack) > common - top + 1:
            _close(nodes, stack, words_of)
        for depth in range(top + len(stack), size + 1):
            parent = stack[-1] if stack else None
            nodes.append([key, above if parent is None else None, least, depth, parent, 0, 0, 0, 0, EMPTY_SHA])
            words_of.append(words[depth - 1] if depth else 0)
            if parent is not None:
                nodes[parent][6] += 1
            stack.append(len(nodes) - 1)
        last = nodes[stack[-1]]  # where the sequence ends
        last[5] += n
        last[9] = ends
        last[2] = min(last[2], least)
        before = ids
    while stack:
        _close(nodes, stack, words_of)
    for node in nodes:
        if node[4] is not None:
            node[4] = nodes[node[4]][2]
    return nodes


def _close(nodes: list[list], stack: list[int], words_of: list[int]) -> None:
    place = stack.pop()
    node = nodes[place]
    node[7] = node[7] or 1
    node[8] += (node[5] - 1) * words_of[place]
    if stack:
        parent = nodes[stack[-1]]
        parent[2] = min(parent[2], node[2])
        parent[5] += node[5]
        parent[7] += node[7]
        parent[8] += node[8]


def _sweep_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]
    names = [field.split()[0] for field in NODE.split(", ")]

    def made(nodes: list[list]) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(nodes), 10_000):
            columns = zip(*nodes[first : first + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

    now, held, nodes = None, [], []
    for batch in batches:
        for key, above, depth, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or key != now[0]:
                if now:
                    nodes += sweep(*now, held)
                    if len(nodes) >= 10_000:
                        yield from made(nodes)
                        nodes = []
                now, held = (key, above, depth), []
            held.append(row)
    if now:
        nodes += sweep(*now, held)
    yield from made(nodes)


def prefix_trie(sequences: DataFrame, burst_turns: int = BURST_TURNS) -> DataFrame:
    """One row per node of the trie of ``sequences`` (of :func:`distinct_sequences`).

    Columns: ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. Without sequences
    there is no node. Containers are swept in sorted order by shard; a container has at
    most ``burst_turns`` turns, or is one sequence, which has to fit in a task (20 bytes a
    turn). Totals of containers reach the burst heads above them by one aggregation over
    the path of each head.
    """
    suffixes, heads = burst(materialise(sequences), burst_turns)
    shards = suffixes.repartition("key").sortWithinPartitions("key", "ids")
    nodes = shards.select("key", "above", "depth", "ids", "words", "least", "n", "ends")
    nodes = materialise(nodes.mapInArrow(_sweep_all, NODE))
    tops = nodes.where("above is not null")
    direct = tops.groupBy(F.col("above").alias("key")).agg(
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    # What all nodes of a head save, its last one included.
    of_words = lambda words: F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + w)
    chain = (F.col("n_convs") - 1) * of_words("words")
    heads = heads.withColumn("chain", chain)
    told = heads.join(direct, "key", "left").select(
        F.explode(F.concat("path", F.array("key"))).alias("of"), "key", "chain",
        F.coalesce("leaves", F.lit(0)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"),
    )
    below = F.when(F.col("of") == F.col("key"), 0).otherwise(F.col("chain"))
    totals = told.groupBy(F.col("of").alias("key")).agg(
        F.sum("leaves").alias("n_leaves"), F.sum(F.col("saved") + below).alias("saved")
    )
    parents = materialise(heads.select(F.col("key").alias("above"), F.col("conv_id").alias("parent")))
    # A head stands for its nodes from `depth` to `stop`; the first one's parent is the
    # head above, the others' has the same members as they.
    full = heads.join(totals, "key").join(parents, "above", "left")
    at = F.explode(F.sequence("depth", "stop")).alias("at")
    full = full.select("*", at)
    last = F.col("at") == F.col("stop")
    first = F.greatest(F.lit(1), F.col("at") - F.greatest(F.lit(1), F.col("depth")) + 1)
    from_here = F.slice("words", first, F.size("words"))
    of_heads = full.select(
        "conv_id", F.col("at").cast("long").alias("depth"),
        F.when(F.col("at") > F.col("depth"), F.col("conv_id")).otherwise(F.col("parent"))
        .alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves", (F.col("saved") + (F.col("n_convs") - 1) * of_words(from_here)).alias("saved_tokens"),
        F.when(last & F.col("ends").isNotNull(), F.col("ends")).otherwise(EMPTY_SHA)
        .alias("ends_sha256"),
    )
    of_tops = join_keys(tops, parents, ["above"], "left", BROADCAST_HEADS)
    of_tops = of_tops.withColumn("parent_conv_id", F.col("parent"))
    inner = nodes.where("above is null")
    return inner.select(*RESULT).unionByName(of_tops.select(*RESULT)).unionByName(of_heads.select(*RESULT))


def conversation_trie(
    df: DataFrame, family: int = 20, shared: int = 4, burst_turns: int = BURST_TURNS
) -> DataFrame:
    """Nodes of the prefix trie of rebuilt conversations (:func:`rebuilt`, :func:`prefix_trie`).

    ``df`` has ``conv_id, turn, role, text``; other columns, whatever their names, play no
    part. A missing role or text is empty. Rows without a conversation id belong to no
    conversation. A row given twice is two turns. Texts of any length are one turn; an
    empty table has no nodes.
    """
    rows = df.select("conv_id", "turn", "role", "text")
    turns = materialise(turn_sequences(rows))
    return prefix_trie(distinct_sequences(rebuilt(turns, family, shared)), burst_turns)


@register(
    "op11_prefix_trie",
    r"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')))
                AS p
            FROM conversations WHERE conv_id IS NOT NULL),
        c0 AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS b FROM t),
        c AS (SELECT conv_id, b, """ + crc32_sql("conv_id::VARCHAR") + r""" % 4 AS h FROM c0),
        r AS (SELECT c.conv_id, p, role, text FROM c JOIN t ON t.conv_id = c.b AND p <= h
              UNION ALL
              SELECT c.conv_id, p + 1000000000, role, text FROM c JOIN t USING (conv_id) WHERE p > h),
        s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS d,
              md5(length(role) || ':' || role || text) AS id,
              len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM r),
        x AS (SELECT conv_id, d, w,
              string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY d) AS pre FROM s
              UNION ALL SELECT conv_id, 0, 0, '' FROM c),
        last AS (SELECT conv_id, max(d) AS d FROM x GROUP BY 1),
        n AS (SELECT pre, d, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs
              FROM x GROUP BY pre, d),
        e AS (SELECT pre, string_agg(x.conv_id::VARCHAR, ',' ORDER BY x.conv_id) AS ends
              FROM x JOIN last USING (conv_id, d) GROUP BY pre),
        kids AS (SELECT left(pre, 32 * (d - 1)) AS pre, count(*) AS n_children
                 FROM n WHERE d > 0 GROUP BY 1),
        own AS (SELECT n.*, coalesce(n_children, 0) AS n_children,
                (n_convs - 1) * w AS saved FROM n LEFT JOIN kids ON kids.pre = n.pre),
        up AS (SELECT left(pre, 32 * a) AS pre, n_children, saved
               FROM (SELECT pre, n_children, saved, unnest(range(0, d + 1)) AS a FROM own)),
        sums AS (SELECT pre, count(*) FILTER (n_children = 0) AS n_leaves,
                 sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY pre)
        SELECT own.conv_id, own.d AS depth, parent.conv_id AS parent_conv_id,
               own.n_convs, own.n_children, n_leaves, saved_tokens,
               sha256(coalesce(ends, '')) AS ends_sha256
        FROM own JOIN sums ON sums.pre = own.pre LEFT JOIN e ON e.pre = own.pre
        LEFT JOIN n parent ON own.d > 0 AND parent.pre = left(own.pre, 32 * (own.d - 1))""",
)
def op11(spark, sf_dir):
    return conversation_trie(conversations(spark, sf_dir))

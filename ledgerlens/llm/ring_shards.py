"""Consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.registry import documents, register, text_or_empty
from ledgerlens.session import materialise

#: Places on the ring. Virtual nodes stand on places; the table of places is broadcast.
PLACE_BITS = 16
#: Rows that are numbered together, and copies of one row that are written out together.
CELL_ROWS = 4_096
COPIES = 10_000


def virtual_nodes(shards: int, replicas: int) -> list[tuple[int, int]]:
    """``(place, shard)`` of each virtual node, clockwise; a taken place is stepped over.

    Nodes of a shard depend on its number only, apart from places that are taken.
    """
    if shards * replicas > 2 ** (PLACE_BITS - 2):
        raise ValueError(f"at most {2 ** (PLACE_BITS - 2)} virtual nodes fit the ring")
    taken: dict[int, int] = {}
    for shard in range(shards):
        for replica in range(replicas):
            digest = hashlib.md5(f"{shard}:{replica}".encode()).digest()
            place = int.from_bytes(digest[:4], "big") >> (32 - PLACE_BITS)
            while place in taken:
                place = (place + 1) % 2**PLACE_BITS
            taken[place] = shard
    return sorted(taken.items())


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard: the mean (rounded so that the sum is exact) plus slack."""
    even = [rows // shards + (shard < rows % shards) for shard in range(shards)]
    return [x + int(slack * x) for x in even]


def plan_overflow(
    counts: list[int], owners: list[int], capacity: list[int]
) -> list[tuple[int, int, int, int, int]]:
    """``(arc, first rank, end rank, shard, first slot)``: where the keys of each arc go.

    In each round every arc offers the keys it still has to the virtual node that it has
    come to; a shard takes the first of them up to its capacity, the rest go on to the
    next node clockwise. A full shard stays full, so there are at most ``arcs + shards``
    pieces however many keys there are.
    """
    used = [0] * len(capacity)
    waiting = [(arc, 0, arc) for arc in range(len(counts)) if counts[arc]]
    pieces = []
    while waiting:
        later = []
        for arc, start, node in waiting:
            shard = owners[node]
            take = min(capacity[shard] - used[shard], counts[arc] - start)
            if take:
                pieces.append((arc, start, start + take, shard, used[shard]))
                used[shard] += take
            if start + take < counts[arc]:
                later.append((arc, start + take, (node + 1) % len(owners)))
        waiting = later
    return pieces


def ring_shards(
    df: DataFrame,
    shards: int = 8,
    replicas: int = 64,
    slack: float = 0.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, home_shard, shard, slot``.

    The key of a row (id, size, checksum of the text) hashes to a ring of virtual nodes;
    the next node clockwise is its home. No shard takes more than ``1 + slack`` times its
    even share; keys beyond that go on clockwise, and only they move. With ``slack=0``
    row counts of any two shards differ by one at most. ``slot`` numbers the rows of a
    shard from 0 without gaps.

    Arcs of the ring hold bounded counts, so the overflow is planned from one count per
    arc (``shards * replicas`` numbers); rows are then numbered within small cells of an
    arc. Equal rows are one counted row until the end, so neither a hot id nor a text
    repeated by a third of all rows reaches one task. A missing text has no bytes
    (size 1), a missing id is an id of its own; an empty table gives no rows.
    """
    spark = df.sparkSession
    text = text_or_empty(text_col)
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    keys = materialise(
        rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
        .withColumn("at", F.xxhash64("doc_id", "size", "text_crc32"))
    )
    total = keys.agg(F.sum("copies")).first()[0] or 0
    nodes = virtual_nodes(shards, replicas)
    # Place p belongs to the first node at or after it; the last arc wraps around.
    starts = [(nodes[arc - 1][0] if arc else -1) + 1 for arc in range(len(nodes))]
    arcs = spark.createDataFrame(
        [(arc, starts[arc], nodes[arc][0]) for arc in range(len(nodes))]
        + [(0, nodes[-1][0] + 1, 2**PLACE_BITS - 1)],
        "arc int, low int, high int",
    ).filter("low <= high")
    places = F.broadcast(arcs.select("arc", F.explode(F.sequence("low", "high")).alias("place")))
    bits = max(PLACE_BITS, (max(total, 1) // CELL_ROWS).bit_length())
    cell = F.shiftright(F.col("at"), 64 - bits) + F.lit(1 << (bits - 1))
    keys = keys.withColumn("cell", cell)
    place = F.shiftright("cell", bits - PLACE_BITS).cast("int")

    cells = keys.groupBy("cell").agg(F.sum("copies").alias("n"))
    cells = materialise(cells.withColumn("place", place).join(places, "place"))
    counts = [0] * len(nodes)
    for arc, n in cells.groupBy("arc").agg(F.sum("n")).collect():  # one row per virtual node
        counts[arc] = n
    owners = [shard for _, shard in nodes]
    pieces = plan_overflow(counts, owners, capacities(total, shards, slack))
    plan = spark.createDataFrame(
        pieces, "arc int, first long, end long, shard int, base long"
    ).join(
        spark.createDataFrame(list(enumerate(owners)), "arc int, home_shard int"), "arc"
    )

    before = F.sum("n").over(Window.partitionBy("arc").orderBy("cell")) - F.col("n")
    inside = Window.partitionBy("cell").orderBy("at", "doc_id", "size", "text_crc32")
    ranked = keys.withColumn("inside", F.sum("copies").over(inside) - F.col("copies")).join(
        cells.select("cell", "arc", before.alias("before")), "cell"
    )
    start = (F.col("before") + F.col("inside")).alias("start")
    ranked = ranked.select("doc_id", "size", "text_crc32", "copies", "arc", start)

    def written_out(part: DataFrame) -> DataFrame:
        last = F.col("start") + F.col("copies") - 1
        return part.withColumn("rank", F.explode(F.sequence("start", last)))

    many = ranked.filter(F.col("copies") > COPIES)
    many = (
        many.withColumn("skip", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(COPIES))))
        .withColumn("start", F.col("start") + F.col("skip"))
        .withColumn("copies", F.least(F.lit(COPIES), F.col("copies") - F.col("skip")))
        .repartition("start")
    )
    each = written_out(ranked.filter(F.col("copies") <= COPIES)).select(
        "doc_id", "size", "text_crc32", "arc", "rank"
    ).unionByName(written_out(many).select("doc_id", "size", "text_crc32", "arc", "rank"))
    placed = each.join(F.broadcast(plan), "arc").filter(
        (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    )
    slot = (F.col("base") + F.col("rank") - F.col("first")).alias("slot")
    return placed.select("doc_id", "size", "text_crc32", "home_shard", "shard", slot)


@register("op5_ring_shards")
def op5(spark, sf_dir):
    """Law ``rows``: a full shard overflows, so other rows have a say and ``key`` cannot hold."""
    return ring_shards(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "home_shard",
    )

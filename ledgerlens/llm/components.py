"""Connected components of a table of edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import materialise


#: Pairs of one task; small tables are worked on by few tasks, which leave few files.
PAIRS_PER_TASK = 200_000


def _with_least(pairs: DataFrame, tasks: int) -> DataFrame:
    """``u, v, m``: every pair with the least of u and its partners.

    The least ones are a table of their own, so that the join can split a hub that has a
    third of all rows.
    """
    least = materialise(pairs.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the least node.

    Large-star and small-star steps alternate until the edges no longer change, which
    takes a number of rounds logarithmic in the longest path. Work per round is linear in
    the edges, and nothing but two sums per round comes to the driver.
    """
    stars = materialise(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    tasks = max(1, -(-stars.count() // PAIRS_PER_TASK))
    stars = stars.coalesce(tasks)
    seen = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, tasks).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u <> v").distinct().coalesce(tasks))
        small = _with_least(large, tasks)
        small = small.select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m"))
        stars = small.filter("v <> m").distinct().select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = materialise(stars.coalesce(tasks))
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = stars.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

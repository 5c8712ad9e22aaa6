"""Small tables with everything that can be odd about documents."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("kept", T.StringType()),  # clashes with result columns
        T.StructField("n", T.LongType()),
        T.StructField("h", T.LongType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("shard", T.StringType()),
    ]
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def prose(seed: int, words: int = 80, per_line: int = 20) -> str:
    rng = random.Random(seed)
    picked = [rng.choice(WORDS) + str(rng.randrange(9)) * rng.randrange(2) for _ in range(words)]
    lines = [picked[k : k + per_line] for k in range(0, words, per_line)]
    return "\n".join(" ".join(line).capitalize() + "." for line in lines)


def odd_rows() -> list[tuple[int | None, str | None]]:
    """Nulls in either column, empty and blank texts, ties, repeated rows, long texts."""
    long = prose(7, 9_000, 25)
    return [
        (1, prose(1)), (2, prose(2)), (3, prose(1)), (3, prose(1)), (3, prose(3)),
        (4, ""), (5, None), (None, None), (None, prose(1)), (None, prose(4)), (6, " \n\t\n "),
        (7, "ÉÀ ß ΣΑΣ   wide space 𝒳𝒴"), (8, "x"), (9, "one two"), (10, long),
        (11, long + "\ntail."), (12, "a" * 70_000), (13, "\n" * 500), (-5, prose(2)),
    ]


def table(spark, rows):
    odd = [(i, t, "k", 3, 4, 5, "s") for i, t in rows]
    return spark.createDataFrame(odd, SCHEMA).repartition(3)

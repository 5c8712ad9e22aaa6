"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.registry import SPACE, documents, join_keys, register, text_or_empty
from ledgerlens.session import materialise

#: Key tables up to this many rows (16 bytes each) are broadcast, larger ones are shuffled.
BROADCAST_KEYS = 500_000


def exact_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 64,
    digest_all: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of ASCII white space became one space.
    A missing text counts as empty. The rows are narrowed in three steps: those whose
    length no other row has are done, then those whose (length, prefix hash) no other row
    has; only what is left gets a full hash (``digest_all`` asks for it on every row).

    Equal texts with a missing id: missing ids sort first, so ``keep_id`` is then missing
    and the rows without an id are kept. Rows that repeat id and text are one document
    given twice; all of them carry the same decision. An empty table gives no rows;
    other columns of the input, whatever their names, play no part.
    """
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        F.regexp_replace(text_or_empty(text_col), f"[{SPACE}]+", " ").alias("norm"),
    )
    rows = rows.withColumn("n", F.length("norm"))
    # Step 1: lengths held by more than one row.
    lengths = rows.groupBy("n").count().filter("count > 1").select("n")
    same_length = join_keys(rows, lengths, ["n"], "left_semi", BROADCAST_KEYS)
    # Step 2: (length, prefix hash) held by more than one of these.
    prefix = F.xxhash64(F.substring("norm", 1, prefix_chars))
    prefixes = materialise(
        same_length.withColumn("p", prefix).groupBy("n", "p").count().filter("count > 1")
        .select("n", "p", F.lit(True).alias("survives"))
    )
    # Step 3: the full hash. Without a broadcast the hash comes first, so that the shuffle
    # carries digests and never texts.
    few = prefixes.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    full = F.sha2("norm", 256)
    rows = rows.withColumn("p", prefix)
    if few:
        marked = rows.join(F.broadcast(prefixes), ["n", "p"], "left")
        wanted = F.lit(True) if digest_all else F.col("survives")
        marked = marked.select("doc_id", "survives", F.when(wanted, full).alias("text_sha256"))
    else:
        hashed = rows.select("doc_id", "n", "p", full.alias("text_sha256"))
        marked = hashed.join(prefixes, ["n", "p"], "left").select(
            "doc_id", "survives", "text_sha256"
        )
    marked = materialise(marked)
    low = F.when(F.count("doc_id") == F.count("*"), F.min("doc_id"))
    # A table of its own, so that the join deals out both sides anew and a skewed key of
    # the rows can be split among tasks.
    groups = materialise(
        marked.filter("survives").groupBy("text_sha256")
        .agg(low.alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )
    grouped = marked.join(groups, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return grouped.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


@register(
    "op7_exact_dedup",
    r"""WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''),
            '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size
              FROM t GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM t JOIN g USING (text_sha256)""",
)
def op7(spark, sf_dir):
    return exact_duplicates(documents(spark, sf_dir), digest_all=True)

"""Line dedup: repeated runs of lines by distributed prefix doubling over line ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.registry import SPACE, documents, join_keys, register, text_or_empty
from ledgerlens.session import materialise

#: A repeated run counts from this many words on.
MIN_WORDS = 50
#: Tables of repeated line ids (8 bytes each) up to this size are broadcast.
BROADCAST_KEYS = 500_000

_DOC = ["doc_id", "h"]
_SEGMENT = [*_DOC, "segment"]


def line_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, h, at, line, words``: one row per line with a 64-bit id of its content."""
    text = text_or_empty(text_col)
    rows = df.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"),
        F.posexplode(F.split(text, "\n", -1)).alias("at", "content"),
    )
    words = F.regexp_count("content", F.lit(f"[^{SPACE}]+"))
    return rows.select("doc_id", "h", "at", F.xxhash64("content").alias("line"), words.alias("words"))


def repeated_segments(lines: DataFrame) -> DataFrame:
    """Lines whose id occurs more than once, numbered by unbroken segments of a document.

    A line that occurs once ends every repeated run, so suffixes are those of segments.
    ``upto`` and ``before`` are the words of the segment up to a line, with it or without.
    """
    ids = materialise(lines.groupBy("line").count().filter("count > 1").select("line"))
    live = join_keys(lines, ids, ["line"], "left_semi", BROADCAST_KEYS)
    # The same row given twice has its lines once.
    live = live.dropDuplicates([*_DOC, "at"])
    nth = F.row_number().over(Window.partitionBy(*_DOC).orderBy("at"))
    live = live.withColumn("segment", F.col("at") - nth)
    upto = F.sum("words").over(Window.partitionBy(*_SEGMENT).orderBy("at"))
    return live.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))


def shortest_runs(live: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, h, segment, at, n``: from each line forwards and backwards the fewest lines
    with ``min_words`` words. Every run with as many words is a union of such runs."""

    def events(kind: int, value: Column, asks: bool) -> DataFrame:
        return live.select(
            *_SEGMENT, value.alias("v"), F.lit(kind).alias("kind"), "at",
            F.when(F.lit(not asks), F.col("at")).alias("found"),
        )

    def answered(asked: DataFrame, data: DataFrame, forwards: bool) -> DataFrame:
        # Frames that end at the row are kept up from row to row; frames that begin there
        # would be read again for each of them.
        turn = F.desc if forwards else F.asc
        order = Window.partitionBy(*_SEGMENT).orderBy(turn("v"), turn("kind"), turn("at"))
        found = F.last("found", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        return asked.unionByName(data).withColumn("to", found).filter(
            F.col("found").isNull() & F.col("to").isNotNull()
        )

    # Forwards: the first line up to which there are min_words more than before this one.
    ahead = answered(
        events(0, F.col("before") + min_words, True), events(1, F.col("upto"), False), True
    ).select(*_SEGMENT, "at", (F.col("to") - F.col("at") + 1).alias("n"))
    # Backwards: the last line before which there are min_words fewer than up to this one.
    behind = answered(
        events(1, F.col("upto") - min_words, True), events(0, F.col("before"), False), False
    ).select(*_SEGMENT, F.col("to").alias("at"), (F.col("at") - F.col("to") + 1).alias("n"))
    return ahead.unionByName(behind).filter("n > 0").distinct()


def doubled_ranks(live: DataFrame, longest: int) -> DataFrame:
    """``doc_id, h, at, ranks``: element j names the suffix's first ``2**j`` lines.

    Each round doubles the prefix that a rank stands for, from the ranks of the prefix and
    of the suffix behind it; all suffixes of a segment lie in one partition, so a round is
    a projection. Ranks are 64-bit names: equal prefixes have equal ranks, and no round
    needs a global sort, since only the equality of ranks is used.
    """
    order = Window.partitionBy(*_SEGMENT).orderBy("at")
    ranks, level = [F.col("line").alias("rank0")], 0
    table = live.select(*_SEGMENT, "at", *ranks)
    while 2 ** (level + 1) <= longest:
        behind = F.lead(f"rank{level}", 2**level).over(order)
        both = F.when(behind.isNotNull(), F.xxhash64(f"rank{level}", behind))
        table = table.withColumn(f"rank{level + 1}", both)
        level += 1
    return table.select(
        *_DOC, "at", F.array(*[F.col(f"rank{j}") for j in range(level + 1)]).alias("ranks")
    )


def later_copies(live: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, h, low, high``: the maximal stretches of lines that later copies cover.

    Two overlapping ranks of ``2**j <= n`` lines name a run of n lines. Runs of one name
    are an interval of the suffix array whose longest common prefix has at least n lines;
    its first member by document and line stays, those that do not overlap it go.
    """
    runs = materialise(shortest_runs(live, min_words))
    longest = runs.agg(F.max("n")).first()[0] or 1
    ranks = doubled_ranks(live, longest)
    level = sum(((F.col("n") >= 2**j).cast("int") for j in range(1, longest.bit_length())), F.lit(0))
    runs = runs.select(*_DOC, "at", "n", level.alias("level"))
    runs = runs.withColumn("tail", F.expr("at + n - shiftleft(1, level)"))

    def named(table: DataFrame, place: str, name: str) -> DataFrame:
        right = ranks.withColumnsRenamed({"doc_id": "r_id", "h": "r_h", "at": "r_at"})
        on = (F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h"))
              & (F.col(place) == F.col("r_at")))
        return table.join(right, on).withColumn(name, F.get("ranks", F.col("level"))).drop(
            "r_id", "r_h", "r_at", "ranks"
        )

    runs = materialise(named(named(runs, "at", "head_rank"), "tail", "tail_rank"))
    key = ["n", "head_rank", "tail_rank"]
    place = F.struct("doc_id", "h", "at")
    # A table of its own, so that the join can split a run that a third of all rows share.
    intervals = materialise(
        runs.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1").select(*key, "first")
    )
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.h") == F.col("h"))
    later = runs.join(intervals, key).filter(
        (F.col("first") < place) & ~(same & (F.col("first.at") + F.col("n") > F.col("at")))
    )
    # Runs that overlap or touch are one stretch.
    order = Window.partitionBy(*_DOC).orderBy("at", "end")
    spans = later.select(*_DOC, "at", (F.col("at") + F.col("n") - 1).alias("end")).distinct()
    furthest = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("at") > furthest + 1, F.lit(True)).cast("int")
    stretch = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = spans.withColumn("opens", opens).withColumn("stretch", stretch)
    return spans.groupBy(*_DOC, "stretch").agg(F.min("at").alias("low"), F.max("end").alias("high"))


def with_lines_removed(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    out: str = "lines",
) -> DataFrame:
    """Append a struct column ``out`` (``n_lines, n_removed, clean_text``) to ``df``.

    A line goes when it lies in a run of whole lines with at least ``min_words`` words
    that also stands earlier, by id and then line, without overlapping; so the first copy
    of everything stays. Lines are equal when identical. Built-in functions only.

    A missing text is one empty line and comes out empty, as an empty text does. Missing
    ids come first. Of documents with one id and other texts, a hash of the text decides
    which is earlier; rows that repeat id and text are one document, so each of them
    keeps what the document keeps. An empty table gives no rows.
    """
    if out in df.columns:
        raise ValueError(f"the table has a column {out} already; pass another name")
    live = materialise(repeated_segments(line_table(df, id_col, text_col)))
    gone = later_copies(live, min_words).groupBy(*_DOC).agg(
        F.collect_list(F.struct("low", "high")).alias("\0gone")
    )
    gone = gone.withColumnsRenamed({"doc_id": "\0id", "h": "\0gone_h"})
    text = text_or_empty(text_col)
    rows = df.withColumn("\0h", F.xxhash64(text))
    on = rows[id_col].eqNullSafe(gone["\0id"]) & (rows["\0h"] == gone["\0gone_h"])
    rows = rows.join(gone, on, "left")
    lines = F.split(text, "\n", -1)
    kept = F.filter(
        lines,
        lambda _, i: ~F.exists("\0gone", lambda r: (r["low"] <= i) & (i <= r["high"])),
    )
    removed = F.aggregate("\0gone", F.lit(0), lambda n, r: n + r["high"] - r["low"] + 1)
    outcome = F.struct(
        F.size(lines).alias("n_lines"),
        F.coalesce(removed, F.lit(0)).alias("n_removed"),
        F.when(F.col("\0gone").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("clean_text"),
    )
    return rows.withColumn(out, outcome).select(*df.columns, out)


@register(
    "op10_line_runs",
    r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
        w AS (SELECT doc_id, i, line, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')))
                OVER (PARTITION BY doc_id ORDER BY i) AS upto,
                len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
        runs AS (
          SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM w a JOIN w b ON a.doc_id = b.doc_id
            AND b.i >= a.i AND b.upto - (a.upto - a.n) >= 50 GROUP BY ALL
          UNION
          SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM w a JOIN w b ON a.doc_id = b.doc_id
            AND b.i >= a.i AND b.upto - (a.upto - a.n) >= 50 GROUP BY b.doc_id, b.i),
        named AS (SELECT doc_id, s, e, ls[s : e] AS run FROM runs JOIN d USING (doc_id)),
        first AS (SELECT *, min({'d': doc_id, 's': s}) OVER (PARTITION BY run) AS f FROM named),
        later AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM first
                  WHERE f < {'d': doc_id, 's': s}
                    AND NOT (f.d = doc_id AND f.s + (e - s + 1) > s))
        SELECT l.doc_id, count(*)::INTEGER AS n_lines, count(later.i)::INTEGER AS n_removed,
               coalesce(string_agg(line, chr(10) ORDER BY l.i)
                        FILTER (WHERE later.i IS NULL), '') AS clean_text
        FROM l LEFT JOIN later ON l.doc_id = later.doc_id AND l.i = later.i
        GROUP BY l.doc_id""",
)
def op10(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text")
    return with_lines_removed(rows).select("doc_id", "lines.*")

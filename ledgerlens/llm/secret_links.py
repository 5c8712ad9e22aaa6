"""Secrets, with the parts of multipart credentials linked by the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.registry import documents, register, text_or_empty
from ledgerlens.session import materialise

#: Parts are in one scope when at most this many code points stand between the end of one
#: and the start of the other; parts have any length.
SCOPE = 256

#: In the order of listing. The first three count by themselves; the others are weak and
#: count only beside parts that complete them.
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
_QUOTE = r"""["']?\x20*[:=]\x20*["']?"""
PATTERNS = {
    "assign": rf"(?i)(password|passwd|secret|token|api_?key){_QUOTE}([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "ident": rf"(?i)(?<![a-z0-9_])(client_?id|user_?name|user|login|account_?id|access_?key_?id){_QUOTE}([A-Za-z0-9@._+-]+)",
    "key": r"[A-Za-z0-9+/_-]+",
    "endpoint": rf"(?i)https?://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+|(?<![a-z0-9_])(host|endpoint|server|url){_QUOTE}([A-Za-z0-9._:/-]+)",
}
#: What a text must have for the kind's search to be worth its while.
HINTS = {
    "assign": r"(?i)password|passwd|secret|token|api_?key",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "key": r"[A-Za-z0-9+/_-]{20}",
}


def _found(text: Column, kind: str, wanted: Column) -> Column:
    """``(kind, place, gap, size, counts)`` of each match, failing ones included.

    ``split`` gives the text between matches, so starts are running sums of gaps and sizes.
    """
    pattern = PATTERNS[kind]
    if kind == "hex":  # runs are as long as they can be, so short ones can be left out here
        pattern = r"[0-9a-f]{32,}"
    elif kind == "key":
        pattern = r"[A-Za-z0-9+/_-]{20,}"
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind in ("assign", "ident") else hits
    number = F.lit(KINDS.index(kind))

    def counts(hit: Column, value: Column) -> Column:
        if kind == "assign":
            return F.length(value) >= 8
        if kind == "access":
            return F.length(hit) >= 16
        if kind == "ident":
            return F.length(value) >= 3
        if kind == "key":  # no word, no number, no path: letters of both cases and a digit
            return hit.rlike("[a-z]") & hit.rlike("[A-Z]") & hit.rlike("[0-9]")
        return F.lit(True)

    zipped = F.arrays_zip(hits.alias("hit"), values.alias("value"), gaps.alias("gap"))
    parts = F.transform(
        F.slice(zipped, F.lit(1), F.size(hits)),
        lambda x, i: F.struct(
            number.alias("kind"), i.alias("place"), F.length(x["gap"]).alias("gap"),
            F.length(x["hit"]).alias("size"), counts(x["hit"], x["value"]).alias("counts"),
        ),
    )
    return F.when(wanted, parts)


def secret_parts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, h, kind, start, end`` of all parts, weak ones included.

    ``h`` is a hash of the text: rows with the same id and other texts stay apart.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    rows = rows.select("doc_id", F.xxhash64("t").alias("h"), "t", *[
        F.col("t").rlike(hint).alias(f"has_{kind}") for kind, hint in HINTS.items()
    ])
    # Identifiers and endpoints are nothing without a secret, keys need a digit.
    secret = F.col("has_assign") | F.col("has_hex") | F.col("has_key")
    wanted = {k: F.col(f"has_{k}") for k in ("assign", "access", "hex")}
    wanted |= {"ident": secret, "endpoint": secret, "key": F.col("has_key") & F.col("t").rlike("[0-9]")}
    rows = rows.filter(secret | F.col("has_access"))
    each = F.filter(F.array(*[_found(F.col("t"), k, wanted[k]) for k in KINDS]), lambda x: x.isNotNull())
    parts = rows.select("doc_id", "h", F.explode(F.flatten(each)).alias("p")).select("doc_id", "h", "p.*")
    # The same row given twice has its parts once.
    parts = parts.dropDuplicates(["doc_id", "h", "kind", "place"])
    passed = F.sum(F.col("gap") + F.col("size")).over(
        Window.partitionBy("doc_id", "h", "kind").orderBy("place")
    )
    parts = parts.withColumn("end", passed).withColumn("start", F.col("end") - F.col("size"))
    return parts.filter("counts").select("doc_id", "h", "kind", "start", "end")


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The strong parts, and the weak ones whose complements stand in their scope.

    A key or an identifier needs the other one (an access identifier or any secret will
    do), an endpoint needs both, or one of two that stand in each other's scope. Of the parts that start earlier the last end is nearest, of
    the later ones the first start, so each part meets two bounds of each role and a text
    full of parts makes no pairs.
    """
    kind = F.col("kind")
    number = KINDS.index
    order = ("start", "kind", "end")
    until_here = (Window.unboundedPreceding, -1)
    own = Window.partitionBy("doc_id", "h").orderBy(*order).rowsBetween(*until_here)
    # The later parts by descending order: a frame that shrinks would be summed up anew for each row.
    back = Window.partitionBy("doc_id", "h").orderBy(*[F.desc(c) for c in order]).rowsBetween(*until_here)
    strong = kind <= number("hex")
    # A weak part inside or across a strong one says nothing new.
    past = F.max(F.when(strong, F.col("end"))).over(own)
    next_ = F.min(F.when(strong, F.col("start"))).over(back)
    parts = parts.withColumn("past", past).withColumn("next", next_)
    parts = parts.filter(
        strong | (F.coalesce(F.col("past") <= F.col("start"), F.lit(True))
                  & F.coalesce(F.col("next") >= F.col("end"), F.lit(True)))
    ).select("doc_id", "h", "kind", "start", "end")
    roles = {
        "ident": kind.isin(number("access"), number("ident")),
        "secret": kind.isin(number("assign"), number("hex"), number("key")),
    }

    def reached(is_role: Column) -> Column:
        before = F.max(F.when(is_role, F.col("end"))).over(own)
        after = F.min(F.when(is_role, F.col("start"))).over(back)
        near = (before >= F.col("start") - scope, after <= F.col("end") + scope)
        return F.coalesce(near[0], F.lit(False)) | F.coalesce(near[1], F.lit(False))

    linked = parts.withColumns({f"by_{role}": reached(is_role) for role, is_role in roles.items()})
    paired = (roles["ident"] & F.col("by_secret")) | (roles["secret"] & F.col("by_ident"))
    linked = linked.withColumn("by_pair", reached(paired))
    linked = linked.filter(
        strong
        | ((kind == number("ident")) & F.col("by_secret"))
        | ((kind == number("key")) & F.col("by_ident"))
        | ((kind == number("endpoint")) & (F.col("by_pair") | (F.col("by_secret") & F.col("by_ident"))))
    )
    return linked.select("doc_id", "h", "kind", "start", "end")


def find_secrets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE
) -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base_spans, spans``.

    Built-in functions only. Spans are ``kind:start:end`` in code points, by start and
    kind. Texts without a hint of a secret are left in the first scan; nothing but parts
    is shuffled. A missing or empty text has no parts. Rows with a missing or repeated id
    stay rows of their own; an empty table gives no rows.
    """
    found = materialise(secret_parts(df, id_col, text_col))
    spans = link_parts(found, scope)
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    text_of = lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])
    strong = KINDS.index("hex")

    def count_of(number: int) -> Column:
        return F.size(F.filter("all", lambda x: x["kind"] == number)).cast("long")

    by_doc = spans.groupBy("doc_id", "h").agg(listed.alias("all")).select(
        F.col("doc_id").alias("s_id"), F.col("h").alias("s_h"),
        *[count_of(k).alias(f"n_{KINDS[k]}") for k in range(strong + 1)],
        F.array_join(F.transform(F.filter("all", lambda x: x["kind"] <= strong), text_of), ",").alias("base_spans"),
        F.array_join(F.transform("all", text_of), ",").alias("spans"),
    )
    rows = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("h"))
    on = F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h"))
    joined = rows.join(by_doc, on, "left")
    counts = [f"n_{k}" for k in KINDS[: strong + 1]]
    return joined.select(
        "doc_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")],
    )


@register("op8_secret_links")
def op8(spark, sf_dir):
    return find_secrets(documents(spark, sf_dir)).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2("base_spans", 256).alias("base_sha256"), "spans",
    )

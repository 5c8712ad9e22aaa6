"""Column profiles, types, missing values, histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.catalogue.registry import (
    DOC, EMB, EMB_FEATURES, FEAT, FEATURES, TX, doc, emb, feat, r, register, rounded, table, tx,
    union_all, with_views,
)
from ledgerlens.operators import profile
from ledgerlens.operators.charts import histogram_grid
from ledgerlens.operators.clustering import complete_rows
from ledgerlens.operators.histogram import grid_counts, histogram
from ledgerlens.operators.quantiles import quantiles
from ledgerlens.plans.bundles import numeric_profile, segment_profile
from ledgerlens.roles import (
    categorical_cols, feature_cols, is_labelled_format, normalise_missing, numeric_cols,
)

# fmt: off


def summary_sql(source: str, cols, by: str = "", digits: int = 9) -> str:
    group = f" GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return union_all(
        f"SELECT {lead}'{c}' AS \"column\", count({c}) AS count, {r(f'avg({c})', digits)} AS mean, "
        f"{r(f'stddev_samp({c})', digits)} AS std, {r(f'CAST(min({c}) AS DOUBLE)', digits)} AS min, "
        f"{r(f'quantile_cont({c}, 0.25)', digits)} AS q1, {r(f'quantile_cont({c}, 0.5)', digits)} AS median, "
        f"{r(f'quantile_cont({c}, 0.75)', digits)} AS q3, {r(f'CAST(max({c}) AS DOUBLE)', digits)} AS max, "
        f"{r(f'skewness({c})', digits)} AS skewness, {r(f'kurtosis({c})', digits)} AS kurtosis "
        f"FROM {source}{group}"
        for c in cols
    )


@register("numeric_summary", with_views(summary_sql("feat", FEATURES, digits=7), FEAT))
def numeric_summary(spark, sf_dir):
    return rounded(profile.numeric_summary(feat(spark, sf_dir), FEATURES), 7)


@register("numeric_summary_with_missing", with_views(summary_sql("doc", ["n_chars", "quality", "toxic"]), DOC))
def numeric_summary_with_missing(spark, sf_dir):
    return rounded(profile.numeric_summary(doc(spark, sf_dir), ["n_chars", "quality", "toxic"]))


@register("describe_time_amount", with_views(summary_sql("tx", ["time", "amount"], digits=7), TX))
def describe_time_amount(spark, sf_dir):
    return rounded(profile.numeric_summary(tx(spark, sf_dir), ["time", "amount"]), 7)


@register("moments_embeddings", with_views(union_all(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {r(f'skewness({c})')} AS skewness, "
    f"{r(f'kurtosis({c})')} AS kurtosis FROM emb" for c in EMB_FEATURES), EMB))
def moments_embeddings(spark, sf_dir):
    stats = profile.moments(emb(spark, sf_dir), EMB_FEATURES)
    return rounded(stats.select("column", "count", "skewness", "kurtosis"))


@register("feature_means", with_views(union_all(
    f"SELECT '{c}' AS \"column\", {r(f'avg({c})')} AS mean FROM emb" for c in EMB_FEATURES), EMB))
def feature_means(spark, sf_dir):
    df = emb(spark, sf_dir)
    return rounded(profile.moments(df, feature_cols(df)).select("column", "mean"))


def percentile_sql(source: str, cols) -> str:
    return union_all(
        f"SELECT '{c}' AS \"column\", " + ", ".join(
            f"{r(f'quantile_cont({c}, {p})')} AS p{round(p * 100)}" for p in profile.PERCENTILES
        ) + f" FROM {source}" for c in cols
    )


@register("percentiles", with_views(percentile_sql("feat", FEATURES), FEAT))
def percentiles(spark, sf_dir):
    return rounded(profile.percentiles(feat(spark, sf_dir), FEATURES))


@register("percentiles_selected", with_views(percentile_sql("feat", FEATURES), FEAT))
def percentiles_selected(spark, sf_dir):
    return rounded(profile.percentiles(feat(spark, sf_dir), FEATURES, method="select"))


@register("percentiles_ordered", with_views(percentile_sql("feat", FEATURES), FEAT))
def percentiles_ordered(spark, sf_dir):
    return rounded(profile.percentiles(feat(spark, sf_dir), FEATURES, method="ordered"))


@register("numeric_profile", with_views(union_all(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {r(f'avg({c})', 7)} AS mean, "
    f"{r(f'stddev_samp({c})', 7)} AS std, {r(f'skewness({c})', 7)} AS skewness, {r(f'kurtosis({c})', 7)} AS kurtosis, "
    f"min({c}) AS min, max({c}) AS max, " + ", ".join(
        f"{r(f'quantile_cont({c}, {p})', 7)} AS {n}" for n, p in (
            ("p1", .01), ("p5", .05), ("p10", .1), ("q1", .25), ("median", .5), ("q3", .75),
            ("p90", .9), ("p95", .95), ("p99", .99))
    ) + f", {r(f'100.0 * (count(*) - count({c})) / count(*)', 7)} AS missing_percentage FROM feat"
    for c in FEATURES), FEAT))
def numeric_profile_query(spark, sf_dir):
    return rounded(numeric_profile(feat(spark, sf_dir), FEATURES), 7)


@register("variability", with_views(union_all(
    f"SELECT '{c}' AS \"column\", {r(f'var_samp({c})', 4)} AS variance, "
    f"{r(f'stddev_samp({c}) / avg({c})', 4)} AS variation FROM feat" for c in FEATURES), FEAT))
def variability(spark, sf_dir):
    return rounded(profile.variability(feat(spark, sf_dir), FEATURES), 4)


CATEGORIES = {"l_returnflag": "feat", "l_linestatus": "feat"}


def value_table_sql(source: str, cols, where: str = "") -> str:
    return union_all(
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS count FROM {source} "
        f"WHERE {c} IS NOT NULL {where} GROUP BY {c}" for c in cols
    )


@register("categorical_summary", with_views(
    "SELECT \"column\", count(*) AS unique_count, arg_min(value, (-count, value)) AS most_frequent, "
    "max(count) AS most_frequent_count FROM v GROUP BY \"column\"",
    "v AS (" + value_table_sql("orders", ["o_orderstatus", "o_orderpriority"]) + ")"))
def categorical_summary(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return profile.categorical_summary(orders, ["o_orderstatus", "o_orderpriority"])


TOP_K = ("SELECT \"column\", value, count, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER "
         "(PARTITION BY \"column\" ORDER BY count DESC, value) AS rank FROM v) WHERE rank <= 20")


@register("value_counts", with_views(TOP_K, "v AS (" + value_table_sql(
    "part", ["p_brand", "p_type", "p_name"]) + ")"))
def value_counts(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "part"), 20, ["p_brand", "p_type", "p_name"])


@register("value_counts_positive", with_views(TOP_K.replace("20", "5"), FEAT, "v AS (" + value_table_sql(
    "feat", ["l_linestatus", "l_returnflag"], "AND label = 1") + ")"))
def value_counts_positive(spark, sf_dir):
    df = feat(spark, sf_dir)
    return profile.value_counts(df, 5, ["l_linestatus", "l_returnflag"], F.col("label") == 1)


@register("value_counts_least", with_views(
    TOP_K.replace("20", "5").replace("count DESC", "count"), "v AS (" + value_table_sql("documents", ["lang", "source"]) + ")"))
def value_counts_least(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "documents"), 5, ["lang", "source"], least=True)


@register("mode_by_column", with_views(union_all(
    f"SELECT '{c}' AS \"column\", CAST(arg_min(x, (-n, x)) AS VARCHAR) AS mode, max(n) AS mode_count FROM "
    f"(SELECT {c} AS x, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY {c})"
    for c in ("o_orderstatus", "o_orderpriority"))))
def mode_by_column(spark, sf_dir):
    return profile.mode_by_column(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@register("mode_numeric", with_views(union_all(
    f"SELECT '{c}' AS \"column\", arg_min(x, (-n, x)) AS mode, max(n) AS mode_count FROM "
    f"(SELECT {c} AS x, count(*) AS n FROM feat GROUP BY {c})" for c in FEATURES), FEAT))
def mode_numeric(spark, sf_dir):
    found = profile.mode_by_column(feat(spark, sf_dir), FEATURES)
    return found.withColumn("mode", F.col("mode").cast("double"))


_SEGMENT_COLUMNS = {"few": "CAST(l_linenumber AS DOUBLE)", "half": "CASE WHEN l_linenumber <= 2 THEN l_extendedprice END",
                    "all": "l_extendedprice", "none": "CAST(NULL AS DOUBLE)"}
_SEGMENT_PROBS = (0.1, 0.5, 0.9)


@register("percentiles_by_segment", "SELECT l_linenumber, \"column\", " + ", ".join(
    f"{r(f'quantile_cont(x, {p})', 6)} AS p{round(p * 100)}" for p in _SEGMENT_PROBS) + " FROM (" + union_all(
    f"SELECT l_linenumber, '{c}' AS \"column\", {e} AS x FROM lineitem" for c, e in _SEGMENT_COLUMNS.items()) + ") GROUP BY ALL")
def percentiles_by_segment(spark, sf_dir):
    """Columns that need each of the three methods, and one without any value."""
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", *[F.expr(e).alias(c) for c, e in _SEGMENT_COLUMNS.items()])
    found = quantiles(rows, list(_SEGMENT_COLUMNS), _SEGMENT_PROBS, ["l_linenumber"], max_distinct=50, max_groups=4)
    named = [F.get("q", i).alias(f"p{round(p * 100)}") for i, p in enumerate(_SEGMENT_PROBS)]
    return rounded(found.select("l_linenumber", "column", *named), 6)


_LARGE = "9007199254740992 + o_orderkey % 3"


@register("mode_large_keys", f"SELECT 'x' AS \"column\", CAST(arg_min(x, (-n, x)) AS VARCHAR) AS mode, max(n) AS mode_count FROM "
          f"(SELECT {_LARGE} AS x, count(*) AS n FROM orders GROUP BY ALL)")
def mode_large_keys(spark, sf_dir):
    """Whole numbers beyond 2**53 stay apart."""
    rows = table(spark, sf_dir, "orders").select(F.expr(_LARGE.replace("9007199254740992", "9007199254740992L")).alias("x"))
    return profile.mode_by_column(rows)


@register("distinct_signed_zero", "SELECT 'x' AS \"column\", count(DISTINCT (l_linenumber - 1) // 2) AS unique_values FROM lineitem")
def distinct_signed_zero(spark, sf_dir):
    """0.0 and -0.0 are one value."""
    x = F.floor((F.col("l_linenumber") - 1) / 2).cast("double")
    sign = F.when((x == 0) & (F.col("l_linenumber") == 1), F.lit(-0.0)).otherwise(x)
    return profile.distinct_counts(table(spark, sf_dir, "lineitem").select(sign.alias("x")))


DOC_COLUMNS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]


@register("distinct_counts", with_views(union_all(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_values FROM doc" for c in DOC_COLUMNS), DOC))
def distinct_counts(spark, sf_dir):
    return profile.distinct_counts(doc(spark, sf_dir), DOC_COLUMNS)


@register("distinct_counts_sketch")
def distinct_counts_sketch(spark, sf_dir):
    return profile.distinct_counts(doc(spark, sf_dir), DOC_COLUMNS, approx=True)


MISSING = union_all(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
    f"{r(f'100.0 * (count(*) - count({c})) / count(*)')} AS missing_percentage FROM doc" for c in DOC_COLUMNS)


@register("missing_by_column", with_views(MISSING, DOC))
def missing_by_column(spark, sf_dir):
    return rounded(profile.missing_by_column(doc(spark, sf_dir), DOC_COLUMNS))


@register("missing_only", with_views(
    f"SELECT \"column\", missing_count, round(missing_percentage, 2) AS missing_percentage FROM ({MISSING}) "
    "WHERE missing_count > 0", DOC))
def missing_only(spark, sf_dir):
    return profile.missing_only(doc(spark, sf_dir), DOC_COLUMNS)


_CELLS = " + ".join(f"(count(*) - count({c}))" for c in DOC_COLUMNS)


@register("missing_summary", with_views(
    f"SELECT CAST({_CELLS} AS BIGINT) AS total_missing_values, "
    f"{r(f'100.0 * ({_CELLS}) / (count(*) * {len(DOC_COLUMNS)})')} AS percentage_of_total_values, "
    "concat_ws(',', " + ", ".join(f"CASE WHEN count({c}) < count(*) THEN '{c}' END" for c in DOC_COLUMNS)
    + ") AS columns_with_missing FROM doc", DOC))
def missing_summary(spark, sf_dir):
    found = rounded(profile.missing_summary(doc(spark, sf_dir), DOC_COLUMNS))
    return found.withColumn("columns_with_missing", F.array_join("columns_with_missing", ","))


@register("normalise_missing", union_all(
    f"SELECT '{c}' AS \"column\", CAST(sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS BIGINT) AS missing_count FROM lineitem"
    for c, test in (("discount", "l_discount = 0"), ("flag", "l_returnflag IN ('A', 'N')"), ("tax", "FALSE"))))
def normalise_missing_query(spark, sf_dir):
    df = feat(spark, sf_dir)
    nan = F.when(F.col("discount") == 0, F.lit(float("nan"))).otherwise(F.col("discount"))
    token = (F.when(F.col("l_returnflag") == "A", "NA").when(F.col("l_returnflag") == "N", " ")
             .otherwise(F.col("l_returnflag")))
    dirty = df.select(nan.alias("discount"), token.alias("flag"), "tax")
    return profile.missing_by_column(normalise_missing(dirty)).select("column", "missing_count")


@register("complete_rows", with_views(
    "SELECT lang, count(*) AS rows FROM doc WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY lang", DOC))
def complete_rows_query(spark, sf_dir):
    kept = complete_rows(doc(spark, sf_dir), ["quality", "toxic"])
    return kept.groupBy("lang").agg(F.count("*").alias("rows"))


# -- types ----------------------------------------------------------------------------

ORDER_TYPES = {
    "o_orderkey": ("bigint", "int64", True, False), "o_custkey": ("bigint", "int64", True, False),
    "o_orderstatus": ("string", "object", False, True), "o_totalprice": ("double", "float64", True, False),
    "o_orderpriority": ("string", "object", False, True),
}


@register("column_types", union_all(
    f"SELECT '{c}' AS \"column\", '{d}' AS dtype, '{p}' AS numpy_dtype, {n} AS is_numeric, {k} AS is_categorical, "
    f"count(DISTINCT {c}) AS unique_values, {r(f'count(DISTINCT {c}) * 1.0 / count(*)')} AS unique_ratio FROM orders"
    for c, (d, p, n, k) in ORDER_TYPES.items()))
def column_types(spark, sf_dir):
    return rounded(profile.column_types(table(spark, sf_dir, "orders"), list(ORDER_TYPES)))


@register("type_summary", """
SELECT dtype, count(*) AS columns, string_agg(name, ',' ORDER BY name) AS names FROM (
  SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
    WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS dtype
  FROM (DESCRIBE lineitem)) GROUP BY dtype""")
def type_summary(spark, sf_dir):
    found = profile.type_summary(table(spark, sf_dir, "lineitem"))
    return found.withColumn("names", F.array_join("names", ","))


@register("column_kinds", union_all(
    f"SELECT '{c}' AS \"column\", '{k}' AS kind, count({c}) AS count FROM orders"
    for c, k in (("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "categorical"),
                 ("o_totalprice", "numeric"), ("o_orderdate", "categorical"), ("o_orderpriority", "categorical"))))
def column_kinds(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    kinds = {c: "numeric" for c in numeric_cols(df)} | {c: "categorical" for c in categorical_cols(df)}
    counts = df.agg(*[F.count(c).alias(c) for c in kinds])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(c).alias("count")) for c, k in kinds.items()]
    return counts.select(F.inline(F.array(*rows)))


@register("labelled_format", "SELECT count(*) AS rows, TRUE AS labelled FROM events")
def labelled_format(spark, sf_dir):
    df = tx(spark, sf_dir).select(
        F.col("time").alias("Time"), F.col("amount").alias("Amount"), F.col("label").alias("Class"),
        F.col("user_id").alias("V1"))
    return df.agg(F.count("*").alias("rows")).withColumn("labelled", F.lit(is_labelled_format(df.columns)))


def _narrow_int(c: str, now: str) -> str:
    steps = (("tinyint", 8), ("smallint", 16), ("int", 32), ("bigint", 64))
    cases = " ".join(f"WHEN min({c}) >= {-2 ** (b - 1)} AND max({c}) <= {2 ** (b - 1) - 1} THEN '{n}'"
                     for n, b in steps[:3])
    return f"SELECT '{c}' AS \"column\", '{now}' AS dtype, CASE {cases} ELSE '{now}' END AS suggested FROM lineitem"


def _narrow_float(c: str) -> str:
    return (f"SELECT '{c}' AS \"column\", 'double' AS dtype, CASE WHEN max(abs({c} - CAST(CAST({c} AS FLOAT) AS DOUBLE))) "
            f"<= 1e-6 THEN 'float' ELSE 'double' END AS suggested FROM lineitem")


@register("suggest_narrow_types", union_all(
    [_narrow_int(c, "bigint") for c in ("l_orderkey", "l_partkey", "l_suppkey")] + [_narrow_int("l_linenumber", "int")]
    + [_narrow_float(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]))
def suggest_narrow_types(spark, sf_dir):
    return profile.suggest_narrow_types(table(spark, sf_dir, "lineitem"), tolerance=1e-6)


@register("narrow_types", "SELECT count(*) AS rows, CAST(sum(l_orderkey) AS BIGINT) AS keys, "
          "CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem")
def narrow_types(spark, sf_dir):
    df = profile.narrow_types(table(spark, sf_dir, "lineitem"))
    return df.agg(F.count("*").alias("rows"), F.sum("l_orderkey").alias("keys"), F.sum("l_linenumber").alias("lines"))


# -- histograms -------------------------------------------------------------------------


def histogram_sql(source: str, cols, bins: int, by: str = "", where: str = "", shared: bool = False,
                  fields=("left", "right", "center", "density")) -> str:
    key = f"{by}, " if by else ""
    same = f"AND e.{by} = c.{by}" if by else ""
    parts = []
    for col in cols:
        rows = f"(SELECT {key}CAST({col} AS DOUBLE) AS x FROM {source} WHERE {col} IS NOT NULL {where})"
        over = f"OVER (PARTITION BY {by})" if by and not shared else "OVER ()"
        own = f"OVER (PARTITION BY {by})" if by else "OVER ()"
        guess = f"least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1})"
        # the edges as the operator defines them: bin * step + low, the last edge exact
        left = f"(e.b * ((e.hi - e.lo) / {bins}) + e.lo)"
        right = f"(CASE WHEN e.b = {bins - 1} THEN e.hi ELSE (e.b + 1) * ((e.hi - e.lo) / {bins}) + e.lo END)"
        extra = {
            "left": f"{r(left, 6)} AS \"left\"",
            "right": f"{r(right, 6)} AS \"right\"",
            "center": f"{r(f'({left} + {right}) / 2', 6)} AS center",
            "density": f"{r('coalesce(c.n, 0) / (e.total * (e.hi - e.lo) / {0})'.format(bins), 8)} AS density",
        }
        picked = ", ".join(extra[f] for f in fields)
        parts.append(f"""
SELECT {'e.' + by + ', ' if by else ''}'{col}' AS "column", e.b AS bin, coalesce(c.n, 0) AS count, {picked}
FROM (SELECT DISTINCT {key}lo, hi, total, CAST(b AS INTEGER) AS b FROM
        (SELECT {key}CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi, total
         FROM (SELECT {key}min(x) {over} AS lo, max(x) {over} AS hi, count(*) {own} AS total FROM {rows})), range({bins}) t(b)) e
LEFT JOIN (SELECT {key}CAST(CASE WHEN x < g * ((hi - lo) / {bins}) + lo THEN g - 1
                    WHEN g < {bins - 1} AND x >= (g + 1) * ((hi - lo) / {bins}) + lo THEN g + 1 ELSE g END AS INTEGER) AS b,
                  count(*) AS n
           FROM (SELECT *, {guess} AS g FROM (SELECT {key}x, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo,
                   CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM
                   (SELECT {key}x, min(x) {over} AS lo, max(x) {over} AS hi FROM {rows})))
           GROUP BY ALL) c ON e.b = c.b {same}""")
    return union_all(parts)


def _hist(df, *fields):
    names = fields or ("left", "right", "center", "density")
    digits = {"density": 8}
    keys = [c for c in df.columns if c not in names and c not in ("left", "right", "center", "density")]
    return df.select(*keys, *[(F.round(f, digits.get(f, 6)) + F.lit(0.0)).alias(f) for f in names])


@register("histogram", with_views(histogram_sql("feat", FEATURES, 20), FEAT))
def histogram_query(spark, sf_dir):
    return _hist(histogram(feat(spark, sf_dir), FEATURES, 20))


@register("histogram_plain", with_views(histogram_sql("tx", ["amount"], 50), TX))
def histogram_plain(spark, sf_dir):
    return _hist(histogram(tx(spark, sf_dir), ["amount"], 50))


@register("histogram_grid", with_views(histogram_sql("emb", EMB_FEATURES, 30), EMB))
def histogram_grid_query(spark, sf_dir):
    return _hist(histogram_grid(emb(spark, sf_dir), EMB_FEATURES))


@register("grid_counts", with_views("""
SELECT label, CAST(least(floor((time - a) / (b - a) * 50), 49) AS INTEGER) AS bin_x,
       CAST(least(floor((amount - c) / (d - c) * 50), 49) AS INTEGER) AS bin_y, count(*) AS count
FROM tx, (SELECT min(time) AS a, max(time) AS b, min(amount) AS c, max(amount) AS d FROM tx) GROUP BY ALL""", TX))
def grid_counts_query(spark, sf_dir):
    return grid_counts(tx(spark, sf_dir), "time", "amount", 50, ["label"])


# -- segments -----------------------------------------------------------------------------


_SEG = ["quantity", "price"]
_SEG_SQL = union_all(
    f"SELECT l_linestatus, '{c}' AS \"column\", count({c}) AS count, {r(f'avg({c})', 7)} AS mean, {r(f'quantile_cont({c}, 0.5)', 7)} AS median, "
    f"CAST(sum(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS outlier_count, "
    f"{r(f'corr({c}, label)', 7)} AS label_r FROM (SELECT l_linestatus AS s, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 "
    f"FROM feat GROUP BY l_linestatus) JOIN feat ON s = l_linestatus GROUP BY l_linestatus" for c in _SEG)


@register("segment_profile", with_views(_SEG_SQL, FEAT))
def segment_profile_query(spark, sf_dir):
    found = segment_profile(feat(spark, sf_dir), ["l_linestatus"], _SEG, "label")
    return rounded(found.select("l_linestatus", "column", "count", "mean", "median", "outlier_count", "label_r"), 7)


@register("segment_profile_users", with_views(
    f"SELECT user_id, 'amount' AS \"column\", count(amount) AS count, {r('avg(amount)')} AS mean, {r('quantile_cont(amount, 0.5)')} AS median, "
    "CAST(sum(CASE WHEN amount < q1 - 1.5 * (q3 - q1) OR amount > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS outlier_count "
    "FROM (SELECT user_id AS s, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM tx GROUP BY user_id) "
    "JOIN tx ON s = user_id GROUP BY user_id", TX))
def segment_profile_users(spark, sf_dir):
    found = segment_profile(tx(spark, sf_dir), ["user_id"], ["amount"], method="ordered")
    return rounded(found.select("user_id", "column", "count", "mean", "median", "outlier_count"))

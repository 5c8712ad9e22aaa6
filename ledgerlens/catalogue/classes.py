"""Class comparison, outliers, two-sample tests and derived insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.catalogue.profiles import _hist, histogram_sql, summary_sql
from ledgerlens.catalogue.registry import (
    EMB, EMB_FEATURES, FEAT, FEATURES, TX, emb, feat, r, register, rounded, table, tx, union_all,
    with_views,
)
from ledgerlens.operators import charts, classes, insight, outliers, two_sample
from ledgerlens.plans.bundles import key_findings
from ledgerlens.roles import Roles

# fmt: off

# -- class balance and comparison ---------------------------------------------------


@register("class_balance", with_views(f"""
SELECT count(*) AS total, count(*) FILTER (label = 1) AS positive_count, count(*) FILTER (label = 0) AS negative_count,
  {r('100.0 * count(*) FILTER (label = 1) / count(*)')} AS positive_pct,
  {r('1.0 * count(*) FILTER (label = 1) / count(*)')} AS positive_ratio,
  {r('1.0 * count(*) FILTER (label = 0) / greatest(count(*) FILTER (label = 1), 1)')} AS imbalance,
  {r('1.0 * count(*) FILTER (label = 0) / nullif(count(*) FILTER (label = 1), 0)')} AS imbalance_ratio
FROM tx""", TX))
def class_balance(spark, sf_dir):
    return rounded(classes.class_balance(tx(spark, sf_dir), "label"))


@register("class_distribution", with_views(
    f"SELECT label, count(*) AS count, {r('1.0 * count(*) / (SELECT count(*) FROM tx)')} AS share FROM tx GROUP BY label", TX))
def class_distribution(spark, sf_dir):
    return rounded(classes.class_distribution(tx(spark, sf_dir), "label"))


@register("split_by_label", with_views(union_all(
    f"SELECT '{c}' AS \"column\", count({c}) FILTER (label = 0) AS negative_rows, {r(f'avg({c}) FILTER (label = 0)', 7)} AS negative_mean, "
    f"count({c}) FILTER (label = 1) AS positive_rows, {r(f'avg({c}) FILTER (label = 1)', 7)} AS positive_mean FROM feat" for c in FEATURES), FEAT))
def split_by_label(spark, sf_dir):
    return rounded(classes.split_by_label(feat(spark, sf_dir), "label", FEATURES), 7)


@register("amount_flags", f"""
SELECT count(*) FILTER (l_tax = 0) AS zero_count, {r('100.0 * count(*) FILTER (l_tax = 0) / count(*)')} AS zero_percentage,
  count(*) FILTER (l_tax > 0.02) AS over_0_02, count(*) FILTER (l_tax > 0.05) AS over_0_05 FROM lineitem""")
def amount_flags(spark, sf_dir):
    return rounded(classes.amount_flags(feat(spark, sf_dir), "tax", (0.02, 0.05)))


@register("amount_flags_orders", f"""
SELECT count(*) FILTER (o_totalprice = 0) AS zero_count, {r('100.0 * count(*) FILTER (o_totalprice = 0) / count(*)')} AS zero_percentage,
  count(*) FILTER (o_totalprice > 1000) AS over_1000, count(*) FILTER (o_totalprice > 5000) AS over_5000,
  count(*) FILTER (o_totalprice > 10000) AS over_10000 FROM orders""")
def amount_flags_orders(spark, sf_dir):
    return rounded(classes.amount_flags(table(spark, sf_dir, "orders"), "o_totalprice"))


@register("describe_by_class", with_views(summary_sql("tx", ["amount"], "label"), TX))
def describe_by_class(spark, sf_dir):
    return rounded(classes.describe_by_class(tx(spark, sf_dir), ["amount"], "label"))


@register("compare_by_class", with_views(union_all(
    f"SELECT label, '{c}' AS \"column\", {r(f'avg({c})', 6)} AS mean, {r(f'quantile_cont({c}, 0.5)', 6)} AS median, "
    f"{r(f'stddev_samp({c})', 6)} AS std, {r(f'min({c})', 6)} AS min, {r(f'max({c})', 6)} AS max FROM tx GROUP BY label"
    for c in ("amount", "time")), TX))
def compare_by_class(spark, sf_dir):
    return rounded(classes.compare_by_class(tx(spark, sf_dir), ["amount", "time"], "label"), 6)


@register("zero_amounts_by_class", with_views(
    f"SELECT label, count(*) FILTER (discount = 0) AS zero_count, {r('100.0 * count(*) FILTER (discount = 0) / count(*)')} AS zero_percentage "
    "FROM feat GROUP BY label", FEAT))
def zero_amounts_by_class(spark, sf_dir):
    return rounded(classes.zero_amounts_by_class(feat(spark, sf_dir), "discount", "label"))


@register("rate_by_day", with_views(
    f"SELECT CAST(floor(time / 86400) AS BIGINT) AS period, count(*) AS rows, count(*) FILTER (label = 1) AS positives, {r('avg(label)')} AS positive_rate "
    "FROM tx GROUP BY period", TX))
def rate_by_day(spark, sf_dir):
    return rounded(classes.rate_by(tx(spark, sf_dir), "label", F.floor(F.col("time") / 86400)))


CROSS = """cells AS (SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY ALL),
full_cells AS (SELECT *, sum(count) OVER (PARTITION BY o_orderstatus) * 1.0 * sum(count) OVER (PARTITION BY o_orderpriority)
  / sum(count) OVER () AS expected FROM cells)"""


@register("cross_table", with_views(f"SELECT o_orderstatus, o_orderpriority, count, {r('expected')} AS expected FROM full_cells", CROSS))
def cross_table(spark, sf_dir):
    return rounded(classes.cross_table(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"))


@register("chi_square", with_views(
    f"SELECT {r('sum(count * 1.0 * count / expected) - sum(count)')} AS chi_square, "
    "(count(DISTINCT o_orderstatus) - 1) * (count(DISTINCT o_orderpriority) - 1) AS degrees_of_freedom FROM full_cells", CROSS))
def chi_square(spark, sf_dir):
    return rounded(classes.chi_square(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"))


# -- outliers -------------------------------------------------------------------------

NUMBERS = ["quantity", "price", "discount", "tax", "label"]
TX_NUMBERS = ["amount", "user_id", "time"]


def _fence(source: str, c: str) -> str:
    return (f"(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
            f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source}))")


def _z(source: str, c: str) -> str:
    return f"(SELECT avg({c}) AS m, nullif(stddev_pop({c}), 0) AS s FROM {source})"


@register("outliers_iqr", with_views(union_all(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} < lo OR {c} > hi) AS outlier_count, "
    f"{r(f'100.0 * count(*) FILTER ({c} < lo OR {c} > hi) / count({c})')} AS outlier_percentage, "
    f"{r('any_value(lo)', 6)} AS lower_bound, {r('any_value(hi)', 6)} AS upper_bound FROM tx, {_fence('tx', c)}"
    for c in TX_NUMBERS), TX))
def outliers_iqr(spark, sf_dir):
    found = outliers.outliers_iqr(tx(spark, sf_dir), TX_NUMBERS)
    return rounded(found.withColumns({c: F.round(c, 6) for c in ("lower_bound", "upper_bound")}))


@register("outliers_zscore", with_views(union_all(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (abs({c} - m) / s > 3) AS outlier_count, "
    f"{r(f'100.0 * count(*) FILTER (abs({c} - m) / s > 3) / count({c})')} AS outlier_percentage, "
    f"{r(f'max(abs({c} - m) / s)')} AS max_zscore, {r(f'avg(abs({c} - m) / s)')} AS mean_zscore FROM feat, {_z('feat', c)}"
    for c in NUMBERS), FEAT))
def outliers_zscore(spark, sf_dir):
    return rounded(outliers.outliers_zscore(feat(spark, sf_dir), NUMBERS))


def _modified(source: str, c: str) -> str:
    test = f"abs(0.6745 * ({c} - med) / mad) > 3.5"
    return (f"SELECT '{c}' AS \"column\", count(*) FILTER ({test}) AS outlier_count, {r(f'100.0 * count(*) FILTER ({test}) / count({c})')} AS outlier_percentage, "
            f"{r('any_value(med)')} AS median, {r('any_value(mad)')} AS mad FROM {source}, "
            f"(SELECT quantile_cont({c}, 0.5) AS med, nullif(mad({c}), 0) AS mad FROM {source}) WHERE mad IS NOT NULL GROUP BY mad")


@register("outliers_modified_z", with_views(union_all(_modified("tx", c) for c in [*TX_NUMBERS, "label"]), TX))
def outliers_modified_z(spark, sf_dir):
    return rounded(outliers.outliers_modified_z(tx(spark, sf_dir), [*TX_NUMBERS, "label"]))


@register("outlier_label_rate", with_views(union_all(
    f"SELECT '{c}' AS \"column\", {r('avg(label)')} AS overall_rate, {r(f'coalesce(avg(label) FILTER ({c} < lo OR {c} > hi), 0)')} AS outlier_rate, "
    f"coalesce(avg(label) FILTER ({c} < lo OR {c} > hi), 0) > avg(label) AS more_likely FROM tx, {_fence('tx', c)}" for c in TX_NUMBERS), TX))
def outlier_label_rate(spark, sf_dir):
    return rounded(outliers.outlier_label_rate(tx(spark, sf_dir), "label", TX_NUMBERS))


_PER_COLUMN = union_all(
    f"SELECT {i} AS i, '{c}' AS col, count(*) FILTER ({c} < lo OR {c} > hi) AS iqr, count(*) FILTER (abs({c} - m) / s > 3) AS z "
    f"FROM tx, {_fence('tx', c)}, {_z('tx', c)}" for i, c in enumerate(TX_NUMBERS))


@register("outlier_summary", with_views(
    "SELECT CAST(sum(iqr) AS BIGINT) AS total_outliers_iqr, CAST(sum(z) AS BIGINT) AS total_outliers_zscore, count(*) AS columns_analyzed, "
    f"arg_max(col, (iqr, -i)) AS most_outliers_column FROM ({_PER_COLUMN})", TX))
def outlier_summary(spark, sf_dir):
    return outliers.outlier_summary(tx(spark, sf_dir), TX_NUMBERS)


@register("flag_outliers", with_views(
    "SELECT event_id, (amount < lo OR amount > hi) AS amount_iqr, coalesce(abs(amount - m) / s > 3, FALSE) AS amount_zscore, "
    "coalesce(abs(0.6745 * (amount - med) / md) > 3.5, FALSE) AS amount_modified_zscore "
    f"FROM tx, {_fence('tx', 'amount')}, {_z('tx', 'amount')}, (SELECT quantile_cont(amount, 0.5) AS med, nullif(mad(amount), 0) AS md FROM tx)", TX))
def flag_outliers(spark, sf_dir):
    flags = [f"amount_{m}" for m in outliers.METHODS]
    return outliers.flag_outliers(tx(spark, sf_dir), ["amount"]).select("event_id", *flags)


@register("outlier_samples", with_views(
    "SELECT 'amount' AS \"column\", 'iqr' AS method, string_agg(printf('%.2f', amount), ',' ORDER BY away DESC, amount DESC) AS vals FROM ("
    f"SELECT amount, abs(amount - (lo + hi) / 2) AS away FROM tx, {_fence('tx', 'amount')} WHERE amount < lo OR amount > hi "
    "ORDER BY away DESC, amount DESC LIMIT 10)", TX))
def outlier_samples(spark, sf_dir):
    found = outliers.outlier_samples(tx(spark, sf_dir), ["amount"], methods=["iqr"])
    texts = F.transform("values", lambda v: F.format_string("%.2f", v))
    return found.select("column", "method", F.array_join(texts, ",").alias("vals"))


@register("iqr_fence_filter", with_views(
    f"SELECT event_type, count(*) AS rows, {r('sum(amount)', 4)} AS amount FROM tx, {_fence('tx', 'amount')} "
    "WHERE amount BETWEEN lo AND hi GROUP BY event_type", TX))
def iqr_fence_filter(spark, sf_dir):
    kept = outliers.iqr_fence_filter(tx(spark, sf_dir), "amount")
    return rounded(kept.groupBy("event_type").agg(F.count("*").alias("rows"), F.sum("amount").alias("amount")), 4)


# -- two-sample tests --------------------------------------------------------------------

def _running(source: str, c: str) -> str:
    return (f"(SELECT '{c}' AS col, x, c1, c0, sum(c1) OVER w AS cum1, sum(c0) OVER w AS cum0, sum(c1) OVER () AS n1, sum(c0) OVER () AS n0 FROM "
            f"(SELECT {c} AS x, count(*) FILTER (label = 1) AS c1, count(*) FILTER (label = 0) AS c0 FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) "
            "WINDOW w AS (ORDER BY x))")


@register("ks_two_sample", with_views(union_all(
    f"SELECT col AS \"column\", CAST(any_value(n1) AS BIGINT) AS n1, CAST(any_value(n0) AS BIGINT) AS n0, {r('max(abs(cum1 / n1 - cum0 / n0))')} AS statistic "
    f"FROM {_running('tx', c)} GROUP BY col" for c in ("time", "amount")), TX))
def ks_two_sample(spark, sf_dir):
    return rounded(two_sample.ks_two_sample(tx(spark, sf_dir), ["time", "amount"], "label").drop("p_value", "significant"))


@register("mann_whitney_u", with_views(union_all(
    f"SELECT col AS \"column\", CAST(any_value(n1) AS BIGINT) AS n1, CAST(any_value(n0) AS BIGINT) AS n0, "
    f"CAST(sum(c1 * (cum1 + cum0 - (c1 + c0) + (c1 + c0 + 1) / 2.0)) - any_value(n1) * (any_value(n1) + 1) / 2.0 AS DOUBLE) AS statistic, "
    f"CAST(sum(CAST(c1 + c0 AS DOUBLE) ** 3 - (c1 + c0)) AS DOUBLE) AS tie_term FROM {_running(s, c)} GROUP BY col"
    for s, c in (("feat", "price"), ("feat", "quantity"))), FEAT))
def mann_whitney_u(spark, sf_dir):
    found = two_sample.mann_whitney_u(feat(spark, sf_dir), ["price", "quantity"], "label")
    return found.drop("p_value", "significant")


# tails as power series, enough terms for the statistics of these tables
# Lattice paths step by step: the share of orders that keep below D, by values of class 1.
_SEGMENTS = "segments AS (SELECT c_acctbal AS balance, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 0 END AS label FROM customer)"


@register("ks_exact_p", f"""WITH RECURSIVE {_SEGMENTS},
d AS (SELECT CAST(any_value(n1) AS BIGINT) AS n, CAST(any_value(n0) AS BIGINT) AS m, max(abs(cum1 / n1 - cum0 / n0)) AS d FROM {_running('segments', 'balance')}),
w AS (SELECT 0 AS s, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM d
  UNION ALL SELECT s + 1, list_transform(range(0, n + 1), lambda i: CASE WHEN s + 1 - i BETWEEN 0 AND m AND abs(i * m - (s + 1 - i) * n) < round(d * n * m)
    THEN p[i + 1] * (s + 1 - i) / (s + 1) + CASE WHEN i > 0 THEN p[i] * i / (s + 1) ELSE 0 END ELSE 0.0::DOUBLE END) FROM w, d WHERE s < n + m)
SELECT n AS n1, m AS n0, {r('d')} AS statistic, {r('1 - p[n + 1]', 8)} AS p_value FROM w, d WHERE s = n + m""")
def ks_exact_p(spark, sf_dir):
    """Balances of two segments: samples small enough for the exact p."""
    label = F.when(F.col("c_mktsegment") == "BUILDING", 1).when(F.col("c_mktsegment") == "MACHINERY", 0)
    rows = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("balance"), label.alias("label"))
    found = two_sample.ks_two_sample(rows, ["balance"], "label")
    return rounded(found.select("n1", "n0", "statistic", F.round("p_value", 8).alias("p_value")))


_KOLMOGOROV = "2 * list_sum([(-1) ** (k - 1) * exp(-2.0 * k * k * x * x) for k in range(1, 200)])"
_ERFC = "1 - 2 / sqrt(pi()) * list_sum([(-1) ** n * (z / sqrt(2)) ** (2 * n + 1) / (exp(lgamma(n + 1.0)) * (2 * n + 1)) for n in range(0, 80)])"
_KS_ROW = (f"SELECT 'ks' AS test, 'time' AS \"column\", d AS statistic, {_KOLMOGOROV} AS p FROM (SELECT d, sqrt(1.0 * n1 * n0 / (n1 + n0)) * d AS x FROM "
           f"(SELECT max(abs(cum1 / n1 - cum0 / n0)) AS d, any_value(n1) AS n1, any_value(n0) AS n0 FROM {_running('tx', 'time')}))")
_U_ROW = (f"SELECT 'u' AS test, 'amount' AS \"column\", u AS statistic, {_ERFC} AS p FROM (SELECT u, greatest(abs(u - n1 * n0 / 2.0) - 0.5, 0) / "
          "sqrt(n1 * n0 / 12.0 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1.0)))) AS z FROM (SELECT CAST(any_value(n1) AS DOUBLE) AS n1, CAST(any_value(n0) AS DOUBLE) AS n0, "
          "CAST(sum(c1 * (cum1 + cum0 - (c1 + c0) + (c1 + c0 + 1) / 2.0)) - any_value(n1) * (any_value(n1) + 1) / 2.0 AS DOUBLE) AS u, "
          f"sum(CAST(c1 + c0 AS DOUBLE) ** 3 - (c1 + c0)) AS ties FROM {_running('tx', 'amount')}))")


@register("two_sample_p_values", with_views(
    f"SELECT test, \"column\", {r('statistic')} AS statistic, {r('p', 7)} AS p_value, p < 0.05 AS significant FROM ({_KS_ROW} UNION ALL {_U_ROW})", TX))
def two_sample_p_values(spark, sf_dir):
    df = tx(spark, sf_dir)
    ks = two_sample.ks_two_sample(df, ["time"], "label", exact=False).withColumn("test", F.lit("ks"))
    u = two_sample.mann_whitney_u(df, ["amount"], "label", exact=False).withColumn("test", F.lit("u"))
    wanted = ["test", "column", "statistic", "p_value", "significant"]
    both = ks.select(*wanted).unionByName(u.select(*wanted))
    return rounded(both.withColumn("p_value", F.round("p_value", 7)))


def _t_row(source: str, c: str) -> str:
    n1, n0 = f"count({c}) FILTER (label = 1)", f"count({c}) FILTER (label = 0)"
    return (f"SELECT '{c}' AS \"column\", {n1} AS n1, {n0} AS n0, avg({c}) FILTER (label = 1) AS m1, avg({c}) FILTER (label = 0) AS m0, "
            f"var_samp({c}) FILTER (label = 1) AS v1, var_samp({c}) FILTER (label = 0) AS v0 FROM {source}")


_T = "(m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0))"


@register("t_test_by_class", with_views(
    f"SELECT \"column\", {r('m1')} AS positive_mean, {r('m0')} AS negative_mean, {r('sqrt(v1)')} AS positive_std, {r('sqrt(v0)')} AS negative_std, "
    f"{r('m1 - m0')} AS mean_difference, {r(_T)} AS t_statistic, CAST(n1 + n0 - 2 AS DOUBLE) AS degrees_of_freedom FROM t",
    EMB, "t AS (" + union_all(_t_row("emb", c) for c in EMB_FEATURES) + ")"))
def t_test_by_class(spark, sf_dir):
    found = two_sample.t_test_by_class(emb(spark, sf_dir), EMB_FEATURES, "label")
    return rounded(found.drop("position", "p_value", "significant"))


# 5 % point of Student t by its expansion about the normal point
_Z = 1.959963984540054
_CRITICAL = f"({_Z} + {(_Z ** 3 + _Z) / 4} / (n1 + n0 - 2) + {(5 * _Z ** 5 + 16 * _Z ** 3 + 3 * _Z) / 96} / ((n1 + n0 - 2) * (n1 + n0 - 2)))"


@register("significant_features", with_views(
    f"SELECT \"column\", {r('m1 - m0')} AS mean_difference FROM t WHERE abs({_T}) > {_CRITICAL} ORDER BY abs(m1 - m0) DESC, \"column\" LIMIT 5",
    EMB, "t AS (" + union_all(_t_row("emb", c) for c in EMB_FEATURES) + ")"))
def significant_features(spark, sf_dir):
    found = two_sample.significant_features(emb(spark, sf_dir), EMB_FEATURES, "label")
    return rounded(found.select("column", "mean_difference"))


@register("best_threshold", with_views(
    f"SELECT x AS threshold, {r('j')} AS j_statistic, {r('tpr')} AS tpr, {r('fpr')} AS fpr FROM (SELECT x, 1 - (cum1 - c1) / n1 AS tpr, 1 - (cum0 - c0) / n0 AS fpr, "
    f"(1 - (cum1 - c1) / n1) - (1 - (cum0 - c0) / n0) AS j FROM {_running('tx', 'amount')}) ORDER BY j DESC, x LIMIT 1", TX))
def best_threshold(spark, sf_dir):
    return rounded(two_sample.best_threshold(tx(spark, sf_dir), "amount", "label"))


# -- insights ------------------------------------------------------------------------------

@register("feature_importance", with_views(
    f"SELECT \"column\", {r('abs(rr)')} AS abs_r, {r(f'abs({_T})')} AS abs_t, CAST(row_number() OVER (ORDER BY abs(rr) DESC) AS INTEGER) AS rank FROM t JOIN c USING (\"column\")",
    EMB, "t AS (" + union_all(_t_row("emb", c) for c in EMB_FEATURES) + ")",
    "c AS (" + union_all(f"SELECT '{c}' AS \"column\", corr({c}, label) AS rr FROM emb" for c in EMB_FEATURES) + ")"))
def feature_importance(spark, sf_dir):
    return rounded(insight.feature_importance(emb(spark, sf_dir), EMB_FEATURES, "label"))


def _signed(c: str) -> str:
    return (f"(SELECT avg({c}) AS m_{c}, nullif(stddev_pop({c}), 0) AS s_{c}, "
            f"CASE WHEN avg({c}) FILTER (label = 1) - avg({c}) FILTER (label = 0) < 0 THEN -1.0 ELSE 1.0 END AS g_{c} FROM tx)")


@register("risk_score", with_views(
    f"SELECT event_id, {r('(coalesce((amount - m_amount) / s_amount, 0) * g_amount + coalesce((user_id - m_user_id) / s_user_id, 0) * g_user_id) / 2')} AS risk "
    f"FROM tx, {_signed('amount')}, {_signed('user_id')}", TX))
def risk_score(spark, sf_dir):
    return rounded(insight.risk_score(tx(spark, sf_dir), ["amount", "user_id"], "label").select("event_id", "risk"))


def _slot(c: str) -> str:
    return " + ".join(f"CAST({c} > q_{c}[{i}] AS INTEGER)" for i in (1, 2, 3))


@register("interaction", with_views(
    f"SELECT CAST({_slot('amount')} AS INTEGER) AS bin_a, CAST({_slot('user_id')} AS INTEGER) AS bin_b, count(*) AS rows, {r('avg(label)')} AS rate FROM tx, "
    "(SELECT quantile_cont(amount, [0.25, 0.5, 0.75]) AS q_amount, quantile_cont(user_id, [0.25, 0.5, 0.75]) AS q_user_id FROM tx) GROUP BY bin_a, bin_b", TX))
def interaction(spark, sf_dir):
    return rounded(insight.interaction(tx(spark, sf_dir), "amount", "user_id", "label"))


_HIGH = " + ".join(f"CAST(abs(corr({a}, {b})) > 0.5 AS INTEGER)" for a, b in (("amount", "user_id"), ("amount", "label"), ("user_id", "label")))
_FOUND = " + ".join(f"(SELECT count(*) FILTER ({c} < lo OR {c} > hi) FROM tx, {_fence('tx', c)})" for c in ("amount", "user_id", "label"))


_FOUND_TIME = f"(SELECT count(*) FILTER (time < lo OR time > hi) FROM tx, {_fence('tx', 'time')})"
_HIGH_TIME = " + ".join(f"CAST(abs(corr(time, {c})) > 0.5 AS INTEGER)" for c in ("amount", "user_id", "label"))


@register("key_findings", with_views(
    f"""SELECT * FROM (SELECT 2 AS rule, printf('Detected %d outliers across all features', n) AS finding FROM (SELECT {_FOUND} AS n) WHERE n > 0
UNION ALL SELECT 4, printf('Found %d high correlations between variables', n) FROM (SELECT {_HIGH} AS n FROM tx) WHERE n > 0
UNION ALL SELECT 5, printf('Dataset has %.2f%% fraud rate', 100.0 * avg(label)) FROM tx)""", TX))
def findings(spark, sf_dir):
    df = tx(spark, sf_dir).select("amount", "user_id", "label")
    return key_findings(df, Roles(amount="amount", label="label"))


@register("key_findings_with_time", with_views(
    f"""SELECT * FROM (SELECT 1 AS rule, 'Fraud transactions have significantly different timing patterns' AS finding FROM ({_KS_ROW}) WHERE p < 0.05
UNION ALL SELECT 2, printf('Detected %d outliers across all features', n) FROM (SELECT {_FOUND} + {_FOUND_TIME} AS n) WHERE n > 0
UNION ALL SELECT 4, printf('Found %d high correlations between variables', n) FROM (SELECT {_HIGH} + {_HIGH_TIME} AS n FROM tx) WHERE n > 0
UNION ALL SELECT 5, printf('Dataset has %.2f%% fraud rate', 100.0 * avg(label)) FROM tx)""", TX))
def findings_with_time(spark, sf_dir):
    return key_findings(tx(spark, sf_dir).drop("event_id"), Roles("time", "amount", "label"))


_LATE = TX.replace("/ 1e6 AS time", "/ 1e6 + CASE WHEN event_type = 'error' THEN 86400 ELSE 0 END AS time")


@register("key_findings_late_errors", with_views(
    f"""SELECT * FROM (SELECT 1 AS rule, 'Fraud transactions have significantly different timing patterns' AS finding FROM ({_KS_ROW}) WHERE p < 0.05
UNION ALL SELECT 5, printf('Dataset has %.2f%% fraud rate', 100.0 * avg(label)) FROM tx)""", _LATE))
def findings_late_errors(spark, sf_dir):
    """Errors moved by a day: the timing rule holds at the larger scales."""
    late = tx(spark, sf_dir).withColumn("time", F.col("time") + F.when(F.col("label") == 1, 86400).otherwise(0))
    return key_findings(late, Roles("time", "amount", "label"), cols=[])


# -- chart data ------------------------------------------------------------------------------

@register("histogram_by_class", with_views(histogram_sql("tx", ["amount"], 50, "label"), TX))
def histogram_by_class(spark, sf_dir):
    return _hist(charts.histogram_by_class(tx(spark, sf_dir), ["amount"], "label"))


@register("histogram_by_class_shared", with_views(histogram_sql("tx", ["amount"], 50, "label", shared=True), TX))
def histogram_by_class_shared(spark, sf_dir):
    return _hist(charts.histogram_by_class(tx(spark, sf_dir), ["amount"], "label", shared_bins=True))


@register("histogram_set", with_views(histogram_sql("feat", ["price", "quantity", "discount"], 50, "label"), FEAT))
def histogram_set(spark, sf_dir):
    roles = Roles(amount="price", label="label", features=("quantity", "discount"))
    return _hist(charts.histogram_set(feat(spark, sf_dir), roles))


@register("time_histogram_by_class", with_views(histogram_sql("tx", ["time"], 50, "label", fields=("left", "right", "center")), TX))
def time_histogram_by_class(spark, sf_dir):
    found = _hist(charts.histogram_by_class(tx(spark, sf_dir), ["time"], "label"), "left", "right", "center")
    return found


_BOX = f"""inside AS (SELECT label, amount FROM tx, {_fence('tx', 'amount')} WHERE amount BETWEEN lo AND hi),
box AS (SELECT label AS l, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS median, quantile_cont(amount, 0.75) AS q3 FROM inside GROUP BY label)"""
_HELD = "amount BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"


@register("boxplot_by_class", with_views(
    f"SELECT label, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3, {r(f'min(amount) FILTER ({_HELD})')} AS whisker_low, "
    f"{r(f'max(amount) FILTER ({_HELD})')} AS whisker_high, count(*) FILTER (NOT ({_HELD})) AS fliers, count(*) AS rows FROM inside JOIN box ON label = l "
    "GROUP BY label, q1, median, q3", TX, _BOX))
def boxplot_by_class(spark, sf_dir):
    return rounded(charts.boxplot_by_class(tx(spark, sf_dir), "amount", "label"))

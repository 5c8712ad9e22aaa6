"""Source and sink queries; scratch files go to the shared folder of the session."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.catalogue.logs import ERROR_STATISTICS, _log, _runs
from ledgerlens.catalogue.registry import DOC, FEAT, FEATURES, doc, feat, r, register, rounded, table, union_all, with_views
from ledgerlens.operators import error_log, profile
from ledgerlens.operators.runs import throughput
from ledgerlens.session import scratch_path
from ledgerlens.sources import files

# fmt: off

ORDER_FIELDS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"


def _orders_csv(spark, sf_dir) -> str:
    path = scratch_path(spark, "orders-csv")
    files.write_csv(table(spark, sf_dir, "orders").drop("o_orderdate"), path)
    return path


@register("read_csv", f"SELECT o_orderpriority, count(*) AS rows, {r('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY o_orderpriority")
def read_csv(spark, sf_dir):
    df = files.read_table(spark, _orders_csv(spark, sf_dir), ORDER_FIELDS)
    return rounded(df.groupBy("o_orderpriority").agg(F.count("*").alias("rows"), F.sum("o_totalprice").alias("total")), 2)


@register("csv_scan_profile", union_all(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {r(f'avg({c})', 6)} AS mean, {r(f'stddev_samp({c})', 6)} AS std FROM orders" for c in ("o_custkey", "o_totalprice")))
def csv_scan_profile(spark, sf_dir):
    """One exact profile over all splits of a CSV scan, schema inferred."""
    df = files.read_table(spark, _orders_csv(spark, sf_dir))
    return rounded(profile.moments(df, ["o_custkey", "o_totalprice"]).select("column", "count", "mean", "std"), 6)


@register("csv_quality", """SELECT count(*) AS rows, count(*) FILTER (c_custkey % 50 IN (1, 2, 3)) AS corrupt_rows,
  count(*) FILTER (c_custkey % 50 = 4) AS empty_rows, TRUE AS problem_found FROM customer""")
def csv_quality(spark, sf_dir):
    """Customers written as text with short, long, ill-typed and empty rows."""
    key = F.col("c_custkey")
    full = F.concat_ws(",", key, "c_name", "c_nationkey")
    line = (F.when(key % 50 == 1, F.concat_ws(",", key, "c_name")).when(key % 50 == 2, F.concat(full, F.lit(",9,9")))
            .when(key % 50 == 3, F.concat_ws(",", F.lit("x"), "c_name", "c_nationkey")).when(key % 50 == 4, F.lit(",,")).otherwise(full))
    path = scratch_path(spark, "customers")
    lines = table(spark, sf_dir, "customer").select(line.alias("value"))
    lines.write.option("lineSep", "\n").text(path)
    # text output has no header: read it as data with the same checks
    schema = spark.createDataFrame([], "c_custkey bigint, c_name string, c_nationkey int").schema
    found = files.csv_quality(spark, path, schema, header=False)
    return found.agg(
        F.sum("rows").alias("rows"), F.sum("corrupt_rows").alias("corrupt_rows"), F.sum("empty_rows").alias("empty_rows"),
        F.bool_or(F.col("problem").isNotNull()).alias("problem_found"))


_PRINT_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@register("table_fingerprint", f"""SELECT count(*) AS rows, CAST(sum(('0x' || substr(sha256(concat_ws(chr(31), {', '.join(_PRINT_COLUMNS)})), 1, 15))::BIGINT) AS VARCHAR) AS fingerprint
FROM orders""")
def table_fingerprint(spark, sf_dir):
    return files.table_fingerprint(table(spark, sf_dir, "orders"), _PRINT_COLUMNS)


@register("dataset_info", """SELECT count(*) AS total_rows, 11 AS total_columns,
  'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate' AS columns,
  """ + r("count(*) * 11 * 8 / 1048576.0") + " AS estimated_size_mb FROM lineitem")
def dataset_info(spark, sf_dir):
    return rounded(files.dataset_info(table(spark, sf_dir, "lineitem")).withColumn("columns", F.array_join("columns", ",")))


@register("input_files", "SELECT 'lineitem.parquet' AS file, count(*) AS rows FROM lineitem")
def input_files(spark, sf_dir):
    found = files.input_files(table(spark, sf_dir, "lineitem"))
    return found.select(F.regexp_extract("file_path", "[^/]+$", 0).alias("file"), "rows")


_DOC = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]
_MISSING = " + ".join(f"(count(*) - count({c}))" for c in _DOC)


@register("summary_long", with_views(union_all(f"SELECT '{k}' AS metric, {r(f'CAST({v} AS DOUBLE)')} AS value FROM doc" for k, v in (
    ("Total Rows", "count(*)"), ("Total Columns", "max(6)"), ("File Size (MB)", "count(*) * 48 / 1048576.0"), ("Total Missing Values", f"({_MISSING})"),
    ("Missing Percentage", f"100.0 * ({_MISSING}) / (count(*) * 6)"), ("Normal Transactions", "count(*) FILTER (toxic = 0)"),
    ("Fraud Transactions", "count(*) FILTER (toxic = 1)"))), DOC))
def summary_long(spark, sf_dir):
    return rounded(files.summary_long(doc(spark, sf_dir), "toxic", _DOC))


@register("write_json", with_views(union_all(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {r(f'avg({c})', 7)} AS mean FROM feat" for c in FEATURES), FEAT))
def write_json(spark, sf_dir):
    path = scratch_path(spark, "json")
    files.write_json(profile.moments(feat(spark, sf_dir), FEATURES), path)
    return rounded(spark.read.schema("column string, count bigint, mean double").json(path), 7)


@register("json_document", """SELECT '[' || string_agg('{"label":' || label || ',"rows":' || n || '}', ',' ORDER BY label) || ']' AS document FROM
  (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, count(*) AS n FROM lineitem GROUP BY 1)""")
def json_document(spark, sf_dir):
    return files.as_document(feat(spark, sf_dir).groupBy("label").agg(F.count("*").alias("rows")))


@register("write_metrics", f"""SELECT event_type AS operation_name, count(*) AS rows, {r('sum(value)', 4)} AS seconds, CAST(sum(user_id * 100) AS BIGINT) AS processed
FROM events GROUP BY event_type""")
def write_metrics(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    files.write_metrics(throughput(_runs(spark, sf_dir)), path)
    back = files.read_run_metrics(spark, path)
    return rounded(back.groupBy("operation_name").agg(
        F.count("*").alias("rows"), F.sum("duration_seconds").alias("seconds"), F.sum("rows_processed").alias("processed")), 4)


@register("error_log_file", ERROR_STATISTICS)
def error_log_file(spark, sf_dir):
    """Statistics of a log written as JSON lines and read back."""
    path = scratch_path(spark, "errors")
    files.write_json(error_log.enrich_errors(_log(spark, sf_dir)), path)
    log = files.read_error_log(spark, path)
    return error_log.error_statistics(log, log.agg(F.max("timestamp")).scalar())

"""CSV and Parquet input, structural checks, identity of an input, result output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.roles import normalise_missing

CORRUPT = "_corrupt_record"


# Fields of an error-log line and of an exported run-metric line.
ERROR_LOG_SCHEMA = (
    "error_id string, timestamp timestamp_ntz, category string, severity string, "
    "message string, user_message string, "
    "context struct<operation: string, component: string, request_id: string>, "
    "retry_possible boolean"
)
RUN_METRICS_SCHEMA = (
    "operation_name string, start_time timestamp_ntz, duration_seconds double, "
    "memory_delta_mb double, cache_hit boolean, rows_processed bigint, "
    "throughput_rows_per_sec double, metadata map<string, string>"
)


def transaction_schema(features: int = 28) -> T.StructType:
    """Time, V1 …, Amount, Class."""
    schema = T.StructType().add("Time", T.DoubleType())
    for i in range(1, features + 1):
        schema.add(f"V{i}", T.DoubleType())
    return schema.add("Amount", T.DoubleType()).add("Class", T.IntegerType())


def read_table(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None,
    sep: str = ",", encoding: str = "UTF-8",
) -> DataFrame:
    """CSV (header row) or Parquet by extension, missing values as NULL.

    Give a schema for large CSV input: inference reads the files once more.
    """
    first = path if isinstance(path, str) else path[0]
    if first.rstrip("/").lower().endswith(".parquet"):
        return normalise_missing(spark.read.parquet(*([path] if isinstance(path, str) else path)))
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return normalise_missing(reader.csv(path))


def read_error_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines error log."""
    return spark.read.schema(ERROR_LOG_SCHEMA).json(path)


def read_run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines run metrics."""
    return spark.read.schema(RUN_METRICS_SCHEMA).json(path)


def csv_quality(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
    max_file_mb: float | None = None, header: bool = True,
) -> DataFrame:
    """One row per file: rows, corrupt rows, and the structural checks with a verdict.

    A row is corrupt when it has a bad value or too many or too few fields.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = (
        spark.read.option("header", header).option("sep", sep)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .schema(with_corrupt).csv(path)
    )
    # naming every column keeps the parser from skipping fields of broken rows
    filled = F.array_compact(F.array(*[F.col(f"`{c}`").cast("string") for c in schema.names]))
    parsed = (
        rows.select(F.col("_metadata.file_path").alias("file_path"), CORRUPT, F.size(filled).alias("filled"))
        .groupBy("file_path")
        .agg(
            F.count("*").alias("rows"),
            F.count_if(F.col(CORRUPT).isNotNull()).alias("corrupt_rows"),
            F.count_if(F.col("filled") == 0).alias("empty_rows"),
        )
    )
    line = F.col("value")
    separated = line.contains(",") | line.contains(";") | line.contains("\t")
    text = (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("text_path"),
            F.col("_metadata.file_size").alias("size"), "value",
        )
        .groupBy("text_path")
        .agg(
            F.max("size").alias("size_bytes"),
            F.count_if(separated).alias("separated_lines"),
            F.count_if(~F.is_valid_utf8(line)).alias("undecodable_lines"),
        )
    )
    joined = text.join(parsed, F.col("file_path") == F.col("text_path"), "left")
    count = {c: F.coalesce(c, F.lit(0)) for c in ("rows", "corrupt_rows", "empty_rows")}
    problem = (
        F.when(F.col("size_bytes") > F.lit(max_file_mb) * 1024 * 1024, "too large")
        .when(~F.lower("text_path").endswith(".csv"), "not a csv file")
        .when(F.col("undecodable_lines") > 0, "not UTF-8")
        .when(F.col("separated_lines") == 0, "no separator")
        .when(count["rows"] == 0, "empty")
        .when(count["corrupt_rows"] > 0, "corrupt rows")
    )
    return joined.select(
        F.col("text_path").alias("file_path"), "size_bytes",
        *[e.alias(c) for c, e in count.items()], "separated_lines", "undecodable_lines",
        problem.alias("problem"), problem.isNull().alias("valid"),
    )


def table_fingerprint(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(rows, fingerprint) of a table of any size, independent of row order.

    The fingerprint adds the leading 60 bits of every row's SHA-256, so equal rows
    count as often as they occur.
    """
    cols = list(cols or df.columns)
    parts: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]
    digest = F.sha2(F.concat_ws("\x1f", *parts), 256)
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(number).cast("string").alias("fingerprint"))


def dataset_info(df: DataFrame) -> DataFrame:
    """Rows, columns, names and the rough size of eight bytes per cell."""
    width = len(df.columns)
    return df.agg(F.count("*").alias("total_rows")).select(
        "total_rows",
        F.lit(width).alias("total_columns"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        (F.col("total_rows") * F.lit(width * 8) / F.lit(1024.0 * 1024.0)).alias("estimated_size_mb"),
    )


def input_files(df: DataFrame) -> DataFrame:
    """(file_path, size_bytes, rows) of a frame read from files."""
    meta = F.col("_metadata")
    return df.groupBy(meta["file_path"].alias("file_path")).agg(
        F.max(meta["file_size"]).alias("size_bytes"), F.count("*").alias("rows")
    )


def summary_long(
    df: DataFrame, label: str | None = None, cols: Sequence[str] | None = None
) -> DataFrame:
    """The two-column Metric / Value export of one aggregate row."""
    from ledgerlens.roles import not_nan

    cols = list(cols or df.columns)
    missing = F.lit(0)
    for c in cols:
        missing = missing + F.count_if(not_nan(df, c).isNull())
    row = [F.count("*").alias("rows"), missing.alias("missing")]
    if label:
        row += [F.count_if(F.col(label) == v).alias(f"class_{v}") for v in (0, 1)]
    rows = F.col("rows").cast("double")
    entries = [
        ("Total Rows", rows),
        ("Total Columns", F.lit(float(len(cols)))),
        ("File Size (MB)", rows * len(cols) * 8 / (1024.0 * 1024.0)),
        ("Total Missing Values", F.col("missing").cast("double")),
        ("Missing Percentage", F.try_divide(F.col("missing") * 100.0, rows * len(cols))),
    ]
    if label:
        entries += [
            ("Normal Transactions", F.col("class_0").cast("double")),
            ("Fraud Transactions", F.col("class_1").cast("double")),
        ]
    pairs = [F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in entries]
    return df.agg(*row).select(F.inline(F.array(*pairs)))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, one file per partition."""
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def as_document(table: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """A small result table as one JSON document row; larger tables go to :func:`write_json`."""
    if table.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows do not belong in one document")
    row = F.struct(*table.columns)
    return table.agg(F.to_json(F.array_sort(F.collect_list(row))).alias("document"))


def write_metrics(runs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Export the run-metric fields as JSON lines."""
    wanted = (
        "operation_name", "start_time", "duration_seconds", "memory_delta_mb", "cache_hit",
        "rows_processed", "throughput_rows_per_sec", "metadata",
    )
    write_json(runs.select(*[c for c in wanted if c in runs.columns]), path, mode)

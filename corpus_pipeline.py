"""From raw documents to packed token sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.jaccard_join import jaccard_components
from ledgerlens.llm.line_runs import with_lines_removed
from ledgerlens.llm.packing import pack_documents
from ledgerlens.llm.personal_data import with_personal_data
from ledgerlens.llm.quality_rules import with_quality
from ledgerlens.session import materialise, scratch_path

#: No SQL twin: packing needs a tokenizer. Tests compare the stages with brute force.
ORACLE_SQL = None


def _with_text(docs: DataFrame, columns: list[str], text) -> DataFrame:
    """The columns of the documents, with another text and its length."""
    return docs.withColumns({"text": text, "n_chars": F.length(text).cast("long")}).select(columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop failing lines and rejected documents."""
    done = with_quality(docs, out="_quality", keep_text=False).filter("_quality.kept")
    return _with_text(done, docs.columns, F.col("_quality.clean_text"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of line runs, and documents of which no word is left by that."""
    done = with_lines_removed(docs, out="_lines")
    text = F.col("_lines.clean_text")
    left = (F.col("_lines.n_removed") == 0) | text.rlike(r"[^\x20\x09-\x0D]")
    return _with_text(done.filter(left), docs.columns, text)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates: of the least id, missing ones last.

    Rows go by id and text, so an id given to several texts is not kept for all of them;
    of rows equal in both the least by the other columns stays. A text without words is in
    no group and stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.xxhash64("text").alias("h"))
    keyed = docs.withColumn("_key", key)
    groups = jaccard_components(keyed, width=5, percent=80, id_col="_key")
    stay = groups.filter("n_shingles = 0 or doc_id = component_id").groupBy(F.col("doc_id").alias("_stays"))
    stay = materialise(stay.agg(((F.count("*") > 1) & (F.max("n_shingles") > 0)).alias("_many")))
    on = F.col("_key") == F.col("_stays")
    once = keyed.join(stay.filter("not _many"), on, "left_semi").select(docs.columns)
    many = keyed.join(stay.filter("_many"), on, "left_semi")
    least = many.groupBy("_key").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.unionByName(least.select("row.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data, disguised or not."""
    done = with_personal_data(docs, out="_personal", keep_text=False)
    return _with_text(done, docs.columns, F.col("_personal.masked_text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048, one row per piece of a document."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

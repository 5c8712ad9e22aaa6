"""Edges where sizes, missing values or types once changed a result."""

from pyspark.sql import functions as F

from ledgerlens.operators import error_log, messages, profile, sampling
from ledgerlens.operators.ordered import sketched
from ledgerlens.operators.quantiles import quantiles


def segments(spark):
    return spark.range(400).select(
        (F.col("id") % 4).alias("g"), (F.col("id") % 5).cast("double").alias("a"),
        F.when(F.col("id") % 4 < 2, F.col("id").cast("double")).alias("b"),
        F.col("id").cast("double").alias("c"), F.lit(None).cast("double").alias("d"),
    )


def test_quantiles_by_all_methods_at_once(spark):
    df = segments(spark)
    got = quantiles(df, ["a", "b", "c", "d"], (0.5,), ["g"], max_distinct=20, max_groups=3).collect()
    plain = quantiles(df, ["a", "b", "c", "d"], (0.5,), ["g"], method="builtin").collect()
    as_dict = lambda rows: {(r.g, r["column"]): r.q and r.q[0] for r in rows}
    assert as_dict(got) == as_dict(plain) and len(got) == 16
    assert as_dict(got)[(3, "b")] is None and as_dict(got)[(0, "d")] is None


def test_every_method_gives_a_row_for_an_empty_column(spark):
    for method in ("builtin", "select", "ordered", "approx"):
        got = quantiles(segments(spark), ["c", "d"], (0.5,), method=method).collect()
        assert {r["column"] for r in got} == {"c", "d"}
        assert {r["column"]: r.q and r.q[0] for r in got}["d"] is None


def test_sketches_are_merged_in_a_tree(spark):
    df = sketched(segments(spark).repartition(9), {"c": F.col("c")}, (0.0, 0.5, 1.0))
    row = df.head()
    assert (row.n_c, row.min_c, row.max_c) == (400, 0.0, 399.0)
    assert abs(row.q_c[1] - 200) < 8 and abs(row.d_c - 400) < 20
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("kll_merge_agg_double") >= 3 and "percentile_approx" not in plan


def test_samples_depend_on_the_seed_and_keep_missing_keys(spark):
    df = spark.range(20_000).withColumn("label", (F.col("id") % 2).cast("int"))
    pick = lambda seed: {r.id for r in sampling.simple_sample(df, 500, "id", seed).collect()}
    one, two = pick(1), pick(2)
    assert len(one) == len(two) == 500 and len(one & two) < 60
    half = spark.range(100).select(F.when(F.col("id") < 50, F.col("id")).alias("key"))
    for n in (80, 100):
        assert sampling.simple_sample(half, n, "key").count() == n


def test_transcripts_keep_turns_with_missing_parts(spark):
    rows = [(1, 0, "user", "a"), (1, 1, None, "b"), (1, 2, "user", None), (1, None, "user", "late")]
    talk = spark.createDataFrame(rows, "t int, turn int, role string, content string")
    talk = talk.withColumn("timestamp", F.lit(None).cast("string"))
    got = messages.transcripts(talk, "t", "turn", "markdown", part_turns=10).collect()
    assert len(got) == 1 and got[0].transcript.count("---") == 4
    assert got[0].transcript.index("late") > got[0].transcript.index("b")


def test_values_are_compared_as_what_they_are(spark):
    big = spark.createDataFrame([(2**53,)] * 2 + [(2**53 + 1,)] * 3, "x long")
    row = profile.mode_by_column(big).head()
    assert (row.mode, row.mode_count) == (str(2**53 + 1), 3)
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (1.0,), (float("nan"),)], "x double")
    assert profile.distinct_counts(zeros).head().unique_values == 2


def test_derived_exceptions_and_missing_messages(spark):
    types = {"ConnectionRefusedError": "network", "JSONDecodeError": "validation",
             "AnalyserAgentError": "workflow", "ReporterAgentError": "workflow", "KeyError": "system"}
    log = spark.createDataFrame([(t, None) for t in types], "error_type string, message string")
    got = error_log.retry_possible(error_log.classify_errors(log, error_type="error_type"))
    assert {r.error_type: r.category for r in got.collect()} == types
    assert all(r.retry_possible == (r.category in ("network", "system")) for r in got.collect())

"""Sources, sinks, transcripts and incremental processing on small files."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import messages, profile, runs
from ledgerlens.sources import files
from ledgerlens.streaming import incremental

FIELDS = "a bigint, b double, c string"


def schema(spark, ddl=FIELDS):
    return spark.createDataFrame([], ddl).schema


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return path


def test_csv_quality_names_each_problem(spark, tmp_path):
    write(tmp_path, "good.csv", "a,b,c\n1,2.5,x\n2,3.5,y\n")
    write(tmp_path, "broken.csv", "a,b,c\n1,2.5\n2,3.5,y,9\nx,1,z\n,,\n4,5,w\n")
    write(tmp_path, "empty.csv", "a,b,c\n")
    write(tmp_path, "plain.csv", "hello\nworld\n")
    write(tmp_path, "latin.csv", "a,b,c\n1,2,\xe9\n", "latin-1")
    write(tmp_path, "good.txt", "a,b,c\n1,2.5,x\n")
    found = {
        r.file_path.rsplit("/", 1)[1]: r
        for r in files.csv_quality(spark, str(tmp_path), schema(spark)).collect()
    }
    problems = {k: r.problem for k, r in found.items()}
    assert problems == {
        "good.csv": None, "broken.csv": "corrupt rows", "empty.csv": "empty",
        "plain.csv": "no separator", "latin.csv": "not UTF-8", "good.txt": "not a csv file",
    }
    broken = found["broken.csv"]
    assert (broken.rows, broken.corrupt_rows, broken.empty_rows) == (5, 3, 1)
    assert found["good.csv"].valid and not broken.valid
    limited = files.csv_quality(spark, str(tmp_path / "good.csv"), schema(spark), max_file_mb=1e-6)
    assert limited.head().problem == "too large"


def test_csv_reads_missing_tokens(spark, tmp_path):
    path = write(tmp_path, "t.csv", "a;b;c\n1;NA;x\n2;3.5;null\n")
    for kind in (schema(spark), None):
        rows = files.read_table(spark, str(path), kind, sep=";").orderBy("a").collect()
        assert [r.c for r in rows] == ["x", None]
    typed = files.read_table(spark, str(path), schema(spark), sep=";").orderBy("a").collect()
    assert [r.b for r in typed] == [None, 3.5]


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    first = files.table_fingerprint(df).head()
    assert first == files.table_fingerprint(df.repartition(3).orderBy(F.desc("a"))).head()
    assert first.fingerprint != files.table_fingerprint(df.distinct()).head().fingerprint
    assert first.fingerprint != files.table_fingerprint(df.fillna("")).head().fingerprint


def test_distinct_sketch_is_near_the_exact_count(spark):
    df = spark.range(20000).select((F.col("id") % 5000).alias("a"), F.lit("k").alias("b"))
    found = {r["column"]: r.unique_values for r in profile.distinct_counts(df, approx=True).collect()}
    assert found["b"] == 1 and abs(found["a"] - 5000) < 500


def test_json_outputs(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    document = json.loads(files.as_document(df).head().document)
    assert document == [{"k": "a", "n": 1}, {"k": "b", "n": 2}]


def test_run_metrics_round_trip(spark, tmp_path):
    made = spark.createDataFrame(
        [("load", 2.0, 100, 5.0, 7.5), ("load", 0.0, 100, 1.0, 1.0), ("save", 4.0, 0, 2.0, 1.0)],
        "operation_name string, duration_seconds double, rows_processed bigint, "
        "memory_before_mb double, memory_after_mb double",
    )
    files.write_metrics(runs.throughput(made), str(tmp_path / "m"))
    back = files.read_run_metrics(spark, str(tmp_path / "m"))
    rates = {(r.operation_name, r.duration_seconds): r for r in back.collect()}
    assert rates[("load", 2.0)].throughput_rows_per_sec == 50.0
    assert rates[("load", 2.0)].memory_delta_mb == 2.5
    assert rates[("load", 0.0)].throughput_rows_per_sec is None
    assert rates[("save", 4.0)].throughput_rows_per_sec is None


def test_transcript_parts_make_the_whole(spark):
    talk = spark.createDataFrame(
        [(1, t, "user" if t % 2 == 0 else "tool", f"m{t}", f"t{t}") for t in range(7)],
        "thread int, turn int, role string, content string, timestamp string",
    ).repartition(4)
    whole = messages.transcripts(talk, "thread", "turn").head().transcript
    parts = messages.transcripts(talk, "thread", "turn", part_turns=3).orderBy("part").collect()
    assert len(parts) == 3 and "".join(p.transcript for p in parts) == whole
    assert whole.startswith("# Chat History\n\n## 👤 User\n*t0*\n\nm0\n\n---\n\n## • Tool\n*t1*\n")
    text = messages.transcripts(talk, "thread", "turn", "text").head().transcript
    assert text.startswith("Chat History\n" + "=" * 50 + "\n\nUSER (t0):\nm0\n" + "-" * 30)
    listed = json.loads(messages.transcripts(talk, "thread", "turn", "json").head().transcript)
    assert [m["content"] for m in listed] == [f"m{t}" for t in range(7)]
    with pytest.raises(ValueError):
        messages.transcripts(talk, "thread", "turn", "html")


def test_incremental_profile_counts_arrivals_once(spark, tmp_path):
    source, state, offsets = (str(tmp_path / n) for n in ("in", "state", "offsets"))
    ddl = schema(spark, "x double")

    def arrive(values):
        spark.createDataFrame([(v,) for v in values], ddl).coalesce(1).write.mode("append").parquet(source)

    def update():
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(source)
        incremental.incremental_profile(stream, ["x"], state, offsets).awaitTermination()
        return incremental.read_profile(spark, state).head()

    arrive([1.0, 2.0, None])
    assert update().n == 2
    arrive([30.0, 4.0])
    for _ in range(2):  # the second run sees no new file
        row = update()
        whole = pd.Series([1.0, 2.0, 30.0, 4.0])
        assert (row.n, row.missing, row.min, row.max) == (4, 1, 1.0, 30.0)
        assert row.mean == whole.mean() and abs(row.skewness - whole.skew()) < 1e-9
    # a replayed batch replaces its own partial
    replay = spark.createDataFrame([(30.0,), (4.0,)], ddl)
    incremental.save_partial(replay, ["x"], state, 1)
    assert incremental.read_profile(spark, state).head().n == 4
    # after a fold, too, and later batches are added to it
    assert incremental.fold_partials(spark, state) == 1
    incremental.save_partial(replay, ["x"], state, 1)
    incremental.save_partial(replay, ["x"], state, 2)
    assert incremental.read_profile(spark, state).head().n == 6


def test_chunks_merge_at_any_partitioning(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))

    def count(chunk):
        return chunk.groupby("g", as_index=False).agg(n=("id", "size"), s=("id", "sum"))

    def merge(parts):
        return parts.groupby("g", as_index=False).agg(n=("n", "sum"), s=("s", "sum"))

    for parts in (1, 9):
        found = incremental.map_reduce_chunks(df.repartition(parts), count, merge, "g bigint, n bigint, s bigint", (4, 1))
        assert sorted(tuple(r) for r in found.collect()) == [(0, 334, 166833), (1, 333, 166167), (2, 333, 166500)]

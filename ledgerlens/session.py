"""Session helpers: defaults for local runs and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bits of the largest estimate of a checkpoint's bytes that is kept; real sizes have fewer.
ESTIMATE_BITS = 62


def local_session(
    cores: int | str = 8, name: str = "ledgerlens", conf: dict[str, str] | None = None
) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.config(map=conf or {})
        .master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.openCostInBytes", "524288")
        .config("spark.sql.files.maxPartitionBytes", "16777216")
        .config("spark.driver.memory", "16g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call sites kept
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read, taken from ``spark.checkpoint.dir``.

    Without that setting it is a folder below the SQL warehouse, which Hadoop resolves
    against the default file system, so it is as shared as the tables are.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`shared_dir`."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Checkpoint a table that several passes read, in the shared folder.

    The files outlive a lost executor, so no pass has to repeat the work before them.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return _with_bounded_estimate(df.checkpoint())


def _with_bounded_estimate(df: DataFrame) -> DataFrame:
    """A checkpoint whose estimated size is forgotten above ``2**ESTIMATE_BITS`` bytes.

    Spark multiplies the estimates of the two sides of a join, and a checkpoint keeps the
    product. In a loop of joins and checkpoints the number has twice the digits or more
    after each, until the driver's memory can't hold the copies of it. Without an estimate
    the planner takes ``spark.sql.defaultSizeInBytes``, which is as good as the product.
    """
    plan = df._jdf.logicalPlan()
    try:
        if plan.stats().sizeInBytes() < 1 << ESTIMATE_BITS:
            return df
    except ValueError:  # it has more digits than Python converts
        pass
    jvm, session = df.sparkSession._jvm, df._jdf.sparkSession()
    plan = plan.copy(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(),
        plan.stream(), session, jvm.scala.Option.empty(), jvm.scala.Option.apply(plan.constraints()),
    )
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), df.sparkSession)

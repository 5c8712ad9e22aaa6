"""What Python workers hold of the texts of a task, and what stays when the task is over."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.words import slices

Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def releasing(work: Work) -> Work:
    """``work``, after which the worker gives freed memory back to the system: it lives on
    beside the stages that follow, also those that run in the JVM alone."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()

    return done


def append_struct(
    df: DataFrame,
    text_col: str,
    out: str,
    outcome: T.StructType,
    make: Callable[[pa.Array], pa.StructArray],
    keep_text: bool = True,
) -> DataFrame:
    """Append the column ``out``, which ``make`` works out from the texts, to those of ``df``.

    A text goes to Python once, and what is made leaves it slice by slice; without
    ``keep_text`` the source text does not come back.
    """
    if out in df.columns:
        raise ValueError(f"the table has a column {out} already; pass another name")
    fields = df.schema.fields
    names = [name.lower() for name in df.columns]
    own = text_col in df.columns and text_col.isidentifier() and names.count(text_col.lower()) == 1
    if not own and not keep_text:
        raise ValueError(f"{text_col} is no single column of the table, so it can't be left out")
    at = df.columns.index(text_col) if own else len(fields)
    back = [k for k in range(len(fields)) if keep_text or k != at]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, _, _ in slices(batch.column(at)):
                rows = batch.slice(first, end - first)
                made = make(rows.column(at))
                columns = [*(rows.column(k) for k in back), made]
                yield pa.RecordBatch.from_arrays(columns, names=[*(fields[k].name for k in back), out])

    rows = df if own else df.withColumn("\0text", F.col(text_col))
    schema = T.StructType([*(fields[k] for k in back), T.StructField(out, outcome)])
    return rows.mapInArrow(releasing(work), schema)

"""Folds over the rows of a key in order, where each result depends on all rows before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType
from pyspark.sql.window import Window

from lingora.session import durable


def in_order(rows: DataFrame, keys: list[str], order: list[str], inputs: list[Column], name: str, kind: DataType, step: Callable) -> DataFrame:
    """rows with a column of what step(state, *inputs) -> (state, value) gives; the state of a key begins as None.

    Keys are dealt over tasks and their rows sorted, so a task holds one state and one batch however long a key's rows
    are. A single key is one task's stream, as the order of its rows demands.
    """
    columns = rows.columns
    n = len(columns)
    own = [c.alias(f"__in{i}") for i, c in enumerate(inputs)]
    dealt = rows.select(*columns, F.struct(*keys).alias("__key"), *own).repartition(*keys)
    ready = dealt.sortWithinPartitions("__key", *order)
    schema = rows.select(*columns, F.lit(None).cast(kind).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, None, False
        for batch in batches:
            out = []
            for k, *values in zip(*(batch.column(i).to_pylist() for i in range(n, batch.num_columns))):
                if not begun or k != key:
                    key, state, begun = k, None, True
                state, value = step(state, *values)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, arrow)], [*columns, name])

    arrow = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind.simpleString()]
    return ready.mapInArrow(run, schema)


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of value up to each row of its key, this one included; a key may be spread over all tasks.

    Rows are dealt by ranges of key and order; each task sums its stretch of a key, and the sums of the stretches before are added.
    """
    columns = rows.columns
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = rows.select(*columns, F.struct(*keys).alias("__whose"), value.cast("long").alias("__value")).repartitionByRange(n, *keys, *order).sortWithinPartitions("__whose", *order)
    schema = rows.select(*columns, F.lit(0).alias("__task"), F.lit(0).cast("long").alias("__sum")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, key, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            out = []
            for k, v in zip(batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist()):
                if k != key:
                    key, total = k, 0
                total += v or 0
                out.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array([task] * len(out), pa.int32()), pa.array(out, pa.int64())], [*columns, "__task", "__sum"])

    local = durable(ready.mapInArrow(run, schema))
    ends = local.groupBy(*keys, "__task").agg(F.max_by("__sum", F.struct(*order)).alias("__end"))
    before = F.sum("__end").over(Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ends.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__task").alias("__t"), F.coalesce(before, F.lit(0)).alias("__before"))
    same = F.col("__task") == F.col("__t")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return local.join(offsets, same).select(*columns, (F.col("__sum") + F.col("__before")).alias(name))

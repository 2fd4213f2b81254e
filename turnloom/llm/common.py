"""Helpers shared by the operators: kept tables, Arrow batch sizes and global running totals."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.session import shared_folder

# What the contracts call a word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column | str) -> Column:
    return F.translate(text, UPPER, LOWER)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(frame: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read on from it; lost executors cost only their tasks."""
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Rows of an Arrow batch from here on; a task holds one batch at a time, so it bounds whole texts and packed blocks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def bytes_of(values: list[bytes], lengths: np.ndarray | None = None) -> pa.Array:
    """A binary column of the given values."""
    return pa.array(values, pa.binary())


def _local_totals(group: list[str], value: str, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = column(batch, value).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(values)
            begins = np.zeros(len(values), bool)
            if group:
                keys = list(zip(*[column(batch, g).to_pylist() for g in group]))
                begins[0] = keys[0] != last
                begins[1:] = [a != b for a, b in zip(keys[1:], keys)]
                last = keys[-1]
            # Totals before each row, counted from the row that began its group here.
            before = sums - values
            starts = np.flatnonzero(begins)
            base = np.zeros(len(values), np.int64)
            if len(starts):
                base = np.where(np.arange(len(values)) >= starts[0],
                                before[starts][np.cumsum(begins) - 1], 0)
                carried = np.where(np.arange(len(values)) < starts[0], total, 0)
            else:
                carried = total
            here = before - base + carried
            total = int(here[-1] + values[-1])
            yield batch.append_column(into, pa.array(here, pa.int64()))
    return run


def running_total(frame: DataFrame, order: list[Column], value: str, into: str, group: list[str] = ()) -> DataFrame:
    """Adds to every row the total of ``value`` over the rows before it, in one global order.

    ``order`` must begin with the columns of ``group`` (totals restart there) and should end
    in a tie-breaker. The rows are dealt out by range and each range is summed by itself; the
    totals of the ranges, a row for each range and group, are then added. No group has to
    fit one task, whatever share of the rows it holds. NULL values count as 0.
    """
    spark, group = frame.sparkSession, list(group)
    names = [f"_o{i}" for i in range(len(order))]
    keyed = frame.withColumns({n: c for n, c in zip(names, order)} | {"_v": F.coalesce(F.col(value), F.lit(0)).cast("long")})
    laid = keyed.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)
    laid = laid.withColumn("_range", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema.fields) + f", `{into}` bigint"
    laid = keep(laid.mapInArrow(_local_totals(group, "_v", into), schema), "ranges")
    named = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    ranges = laid.groupBy(F.col("_range").alias("_at"), *named).agg(F.sum("_v").alias("_sum"))
    window = Window.partitionBy(*[f"_g{i}" for i in range(len(group))]).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(window), F.lit(0))).drop("_sum")
    same = F.col("_range") == F.col("_at")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    # Without groups there is one row for each range, which bounds the broadcast.
    out = laid.join(ranges if group else F.broadcast(ranges), same)
    return out.select(*frame.columns, (F.col(into) + F.col("_before")).alias(into))

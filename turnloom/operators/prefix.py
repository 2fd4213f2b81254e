"""Running totals that never put one whole group into one task.

A plain ``sum() OVER (PARTITION BY key ORDER BY n)`` sorts every row of a key in one
task. Here rows are first cut into fixed-width spans of the order column; only the span
totals (one row per span) are ordered per key, and rows are ordered within their span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import shuffled

SPAN = 4096


def running_total(
    frame: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    out: str,
    tie: list[str] | None = None,
    descending: bool = False,
    span: int = SPAN,
) -> DataFrame:
    """Inclusive running sum of ``value`` along the integer column ``order``.

    NULL keys form a group of their own; rows without an order come first (last if descending).
    """
    return running_totals(frame, keys, order, {out: value}, tie, descending, span)


def running_totals(
    frame: DataFrame,
    keys: list[str],
    order: str,
    values: dict[str, Column],
    tie: list[str] | None = None,
    descending: bool = False,
    span: int = SPAN,
) -> DataFrame:
    """``running_total`` of several values along one order, in one shuffle of the rows."""
    span_id = F.floor(F.col(order) / span).cast("long")
    if descending:
        span_id = -span_id
    # Structs are equal where their parts are, NULLs included, so the join and the window share one key and one shuffle.
    tagged = frame.withColumn("_span", span_id).withColumns({f"_v{i}": v for i, v in enumerate(values.values())})
    tagged = tagged.withColumn("_g", F.struct(*keys, "_span")).drop("_span")
    totals = tagged.groupBy("_g").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(values))])
    span_of = F.col("_g._span")
    first = span_of.asc_nulls_last() if descending else span_of.asc_nulls_first()
    ahead = Window.partitionBy(*[F.col("_g")[k] for k in keys]).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_g", *[
        F.coalesce(F.sum(f"_t{i}").over(ahead), F.lit(0)).alias(f"_a{i}") for i in range(len(values))])
    step = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy("_g").orderBy(step, *(tie or [])).rowsBetween(Window.unboundedPreceding, 0)
    rows = tagged.join(shuffled(totals), "_g")
    return rows.select(*frame.columns, *[
        (F.col(f"_a{i}") + F.sum(f"_v{i}").over(inside)).alias(out) for i, out in enumerate(values)])


def running_index(frame: DataFrame, keys: list[str], order: str, out: str,
                  tie: list[str] | None = None, span: int = SPAN) -> DataFrame:
    """Zero-based position along ``order`` within each key."""
    counted = running_total(frame, keys, order, F.lit(1).cast("long"), out, tie, span=span)
    return counted.withColumn(out, F.col(out) - 1)

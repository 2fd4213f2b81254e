"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import keep


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of each node (the larger ones, or the smaller ones and itself) on the least of all."""
    both = edges.select("a", "b") if small else edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    hung = both.join(least, "a")
    if small:
        moved = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(hung.select("a", F.col("m").alias("b")))
    else:
        moved = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node it is connected with.

    ``edges`` has columns a and b of one ordered type. Minima are taken in partial aggregates and joined back, so the
    neighbours of a node never meet in one row; each round is written to the shared folder.
    """
    down = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = keep(down(edges), "edges")
    before = None
    while True:
        now = keep(down(_star(_star(now, small=False), small=True)), "edges")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(tops)

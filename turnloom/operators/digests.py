"""Digests that depend on the order of rows, as a hash tree over places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.operators.prefix import running_index

FAN = 256
LEVELS = 5


def ordered_digest(frame: DataFrame, keys: list[str], order: str, leaf: Column, out: str,
                   fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(keys, n, out): the number of rows of each key and a SHA-256 over them in their order.

    Rows stand along ``order`` (NULL first), equal ones by their digests, so reruns agree. ``fan`` neighbours make one
    node of the next level, a lone node passes as it is, and the root is bound to the count. A row never holds more
    than ``fan`` digests, whatever the size of a key; a key has at most ``fan ** levels`` rows (2^40 as set), and more
    levels would not change a digest. NULL keys form one group; a NULL ``leaf`` counts as empty text; an empty table
    has no digests.
    """
    names = [f"k{i}" for i in range(len(keys))]
    leaves = frame.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(order).alias("at"),
                          F.sha2(F.coalesce(leaf, F.lit("")), 256).alias("node"))
    nodes = running_index(leaves, names, "at", "place", ["node"]).select(*names, "place", "node", F.lit(1).cast("long").alias("n"))
    for _ in range(levels):
        nodes = nodes.groupBy(*names, F.floor(F.col("place") / fan).alias("up")).agg(
            F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "node"))).alias("below"))
        nodes = nodes.select(*names, F.col("up").alias("place"), "n", F.when(F.size("below") == 1, F.col("below")[0]["node"]).otherwise(
            F.sha2(F.array_join("below.node", ""), 256)).alias("node"))
    return nodes.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "n",
                        F.sha2(F.concat_ws(":", F.col("n").cast("string"), "node"), 256).alias(out))

"""Digests bound to an order, against the same tree in plain Python."""

import hashlib

from pyspark.sql import functions as F

from turnloom.operators.digests import ordered_digest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(texts, fan):
    nodes = [sha(t or "") for t in texts]
    while len(nodes) > 1:
        groups = [nodes[i:i + fan] for i in range(0, len(nodes), fan)]
        nodes = [g[0] if len(g) == 1 else sha("".join(g)) for g in groups]
    return sha(f"{len(texts)}:{nodes[0]}")


def digests_of(spark, rows, **options):
    frame = spark.createDataFrame(rows, "k string, at long, t string")
    return {r.k: (r.n, r.d) for r in ordered_digest(frame, ["k"], "at", F.col("t"), "d", **options).collect()}


def test_tree_of_many_levels(spark):
    rows = [("long", 3 * i, f"text {i}") for i in range(300)] + [("one", 5, "alone"), ("none", 1, None), (None, 1, "a"), (None, 2, "b")]
    got = digests_of(spark, rows, fan=4, levels=6)
    assert got["long"] == (300, tree([f"text {i}" for i in range(300)], 4))
    assert got["one"] == (1, tree(["alone"], 4)) and got["none"] == (1, tree([None], 4))
    assert got[None] == (2, tree(["a", "b"], 4))
    assert got == digests_of(spark, rows, fan=4, levels=8)


def test_order_is_bound(spark):
    rows = [("k", i, f"t{i}") for i in range(10)]
    swapped = [("k", {3: 4, 4: 3}.get(i, i), f"t{i}") for i in range(10)]
    assert digests_of(spark, rows) == digests_of(spark, rows[::-1])
    assert digests_of(spark, rows) != digests_of(spark, swapped)
    assert digests_of(spark, rows) != digests_of(spark, rows[:9])


def test_equal_places_and_repeats(spark):
    rows = [("k", 1, "b"), ("k", 1, "a"), ("k", 1, "a"), ("k", None, "first")]
    ties = sorted(["a", "a", "b"], key=sha)
    assert digests_of(spark, rows)["k"] == (4, tree(["first", *ties], 256)) == digests_of(spark, rows[::-1])["k"]


def test_empty_table_and_clashing_names(spark):
    assert digests_of(spark, []) == {}
    frame = spark.createDataFrame([(1, 2, "x", "y")], "place long, node long, n string, below string")
    got = ordered_digest(frame, ["place"], "node", F.col("n"), "digest").first()
    assert (got.place, got.n, got.digest) == (1, 1, tree(["x"], 256))

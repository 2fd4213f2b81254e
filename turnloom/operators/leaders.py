"""Corpus-wide leader dedupe: a row goes if an earlier row that stays resembles it.

Rows are walked in order; one whose token list equals that of a kept row, or whose token set is similar enough to it, is
merged into the first such row. Nothing here walks: equal sets are one node from the start, an exact set-similarity join finds the
other neighbours, and rounds over all nodes settle who stays.

The join cuts the tokens into parts by their hashes, so many that sets that differ little have ``SHARED`` parts in common (at most one part
differs for each token that only one of them has, and one empty part of a set may be left out). A bucket holds the sets with one content of one part, and never becomes all its pairs: nodes that
come first in all their buckets are compared with the buckets' other members, which settles groups of copies at once; of what is left, small buckets
are joined by node and large ones compared in blocks. Token sets are written once; only those of nodes that are to be compared are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.session import shuffled, written

THRESHOLD = 0.88
SHARED = 2         # parts that similar sets have in common
BAND = 1.3         # sizes that share one number of parts, largest to smallest
PLACES = 1 << 20   # places of the table of nodes to be compared, whatever the corpus
HEAVY = 400        # members from which a bucket is compared in blocks of as many
EARLY_ROUNDS = 2


def _token_nodes(rows: DataFrame, key: str, order: str, tokens: str) -> DataFrame:
    """(key, order, list: digest of the token list, tokens: hashes of the set, set: its digest, row: a number) of every row."""
    words = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    rows = rows.select(F.col(key).alias("key"), F.col(order).cast("long").alias("order"), words.alias("words"))
    hashes = F.array_sort(F.array_distinct(F.transform("words", lambda t: F.xxhash64(t))))
    digest = lambda values: F.unhex(F.md5(F.concat_ws("\x00", values)))
    named = rows.select("key", "order", digest(F.col("words")).alias("list"), hashes.alias("tokens"))
    return named.select("*", digest(F.col("tokens").cast("array<string>")).alias("set"), F.monotonically_increasing_id().alias("row"))


def _bands(sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """First sizes of the bands up to the largest size, and the number of parts of each.

    Of two similar sets the smaller has at least ``threshold`` times the size of the larger, so they differ in at most (1 - threshold) /
    threshold times its size.
    """
    starts = [1]
    while starts[-1] <= sizes.max(initial=1):
        starts.append(max(starts[-1] + 1, int(starts[-1] * BAND)))
    largest = np.array(starts[1:]) - 1
    return np.array(starts[:-1]), np.floor((1 - threshold) / threshold * largest + 1e-9).astype(np.int64) + SHARED + 1


def _signatures(flat: np.ndarray, ends: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the parts of each set (its tokens are flat[ends[i]:ends[i + 1]]) and how many each set has.

    A set is cut as its own band is, and as every band below is that holds sets similar to it. An empty part says next to nothing, so it
    is left out where it is the only one of a cut.
    """
    sizes = np.diff(ends)
    starts, parts = _bands(sizes, threshold)
    own = np.searchsorted(starts, sizes, "right") - 1
    lowest = np.searchsorted(starts, np.maximum(np.ceil(threshold * sizes - 1e-9), 1), "right") - 1
    times = own - lowest + 1
    which = np.repeat(np.arange(len(sizes)), times)
    band = np.repeat(lowest, times) + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    width, n = parts[band], sizes[which]
    first = np.cumsum(width) - width
    at = np.repeat(ends[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    values = flat.view(np.uint64)[at]
    place = np.repeat(first, n) + ((values >> np.uint64(33)) % np.repeat(width, n).astype(np.uint64)).astype(np.int64)
    sums = np.zeros(width.sum(), np.uint64)
    np.add.at(sums, place, values)
    part = np.arange(len(sums)) - np.repeat(first, width)
    empty = np.bincount(place, minlength=len(sums)) == 0
    stays = ~(empty & np.repeat(np.add.reduceat(empty, first) == 1, width)) if len(first) else empty
    mixed = sums + (np.repeat(band, width) * 1_000_003 + part + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    mixed = (mixed ^ (mixed >> np.uint64(31))).view(np.int64)
    return mixed[stays], np.bincount(np.repeat(which, width)[stays], minlength=len(sizes))


def _members(sets: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(token, node, n): signatures of the parts of each set that can have a similar one of another content, as far as two sets have them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            lists = batch.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            found, counts = _signatures(lists.values.to_numpy(), ends, threshold)
            parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int32()), parts], ["row", "n", "parts"])

    # Below this size one token more or less is too much.
    large = sets.select("row", "tokens").where(F.size("tokens") >= int(threshold / (1 - threshold)))
    signed = large.mapInArrow(run, "row bigint, n int, parts array<bigint>").join(shuffled(nodes.select("row", "node")), "row")
    signed = written(signed.select("node", "n", "parts"), "signatures")
    rows = signed.select("node", "n", F.explode("parts").alias("token"))
    several = written(rows.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "several")
    return written(rows.join(several, "token", "left_semi").select("token", "node", "n"), "members")


def _sets_of(wanted: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, tokens) of these nodes; of all the others hardly any set is shuffled."""
    rows = written(nodes.select("node", "row").join(wanted, "node", "left_semi"), "wanted")
    place = F.pmod(F.xxhash64("row"), F.lit(PLACES)).cast("int")
    near = sets.select("row", "tokens", place.alias("place")).join(F.broadcast(rows.select(place.alias("place")).distinct()), "place", "left_semi")
    return near.join(shuffled(rows), "row").select("node", "tokens")


def _similar(pairs: DataFrame, sets: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets have this Jaccard similarity."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = written(_sets_of(wanted, sets, nodes), "compared")
    left, right = found.select(F.col("node").alias("a"), F.col("tokens").alias("_l")), found.select(F.col("node").alias("b"), F.col("tokens").alias("_r"))
    both = F.size(F.array_intersect("_l", "_r"))
    compared = pairs.join(left, "a").join(right, "b").withColumn("_both", both)
    return compared.where(F.col("_both") / (F.size("_l") + F.size("_r") - F.col("_both")) >= threshold).select("a", "b")


def _sizes_fit(one: str, two: str, threshold: float) -> Column:
    return (F.col(one) >= threshold * F.col(two) - 1e-9) & (F.col(two) >= threshold * F.col(one) - 1e-9)


def _early_leaders(members: DataFrame, open_nodes: DataFrame) -> DataFrame:
    """Open nodes that come first among the open ones in all their buckets: nothing can drop them any more."""
    here = members.join(open_nodes, "node", "left_semi")
    first = here.groupBy("token").agg(F.min("node").alias("first"))
    return here.join(first, "token").groupBy("node").agg(F.bool_and(F.col("first") == F.col("node")).alias("leads")).where("leads").select("node")


def _led(members: DataFrame, leaders: DataFrame, threshold: float) -> DataFrame:
    """(a, b): leaders with later nodes that share enough parts; a bucket has at most one of these leaders."""
    lead = members.join(leaders, "node", "left_semi").select("token", F.col("node").alias("a"), F.col("n").alias("_na"))
    met = members.join(lead, "token").where(F.col("a") < F.col("node")).where(_sizes_fit("n", "_na", threshold))
    return met.groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("c")).where(F.col("c") >= SHARED).select("a", "b")


def _in_blocks(members: DataFrame, sets: DataFrame, nodes: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Similar pairs (a, b) of the open rows and later rows of large buckets, compared in blocks of ``HEAVY`` rows."""
    def shared_with(tokens: np.ndarray, values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        first = np.searchsorted(values, tokens, "left")
        counts = np.searchsorted(values, tokens, "right") - first
        at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return np.bincount(owner[at], minlength=n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, ([], [])

        def done() -> pa.RecordBatch:
            same, one, two = current[1] == current[2], held[0], held[0] if current[1] == current[2] else held[1]
            found = []
            if one and two:
                lists = [np.array(r[2], np.int64) for r in two]
                values, owner = np.concatenate(lists), np.repeat(np.arange(len(two)), [len(x) for x in lists])
                order = np.argsort(values, kind="stable")
                values, owner, lengths = values[order], owner[order], np.array([len(x) for x in lists])
                for i, (node, is_open, tokens) in enumerate(one):
                    both = shared_with(np.array(tokens, np.int64), values, owner, len(two))
                    for k in np.flatnonzero(both / (len(tokens) + lengths - both) >= threshold):
                        other = two[k]
                        if same and k <= i:
                            continue
                        a, b = ((node, is_open), other[:2]) if node < other[0] else (other[:2], (node, is_open))
                        if a[1]:
                            found.append((a[0], b[0]))
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["a", "b"])

        for batch in batches:
            for token, i, j, side, node, is_open, tokens in zip(*[c.to_pylist() for c in batch.columns]):
                if (token, i, j) != current:
                    if current is not None:
                        yield done()
                    current, held = (token, i, j), ([], [])
                held[side].append((node, is_open, tokens))
        if current is not None:
            yield done()

    rows = members.join(sizes, "token").withColumn("_chunks", F.ceil(F.col("_size") / HEAVY).cast("int"))
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64("node"), F.col("_chunks").cast("long")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda c: F.struct(
        F.least(c, F.col("_chunk")).alias("i"), F.greatest(c, F.col("_chunk")).alias("j"), F.when(c >= F.col("_chunk"), 0).otherwise(1).alias("side")))
    rows = rows.withColumn("_m", F.explode(meets)).select("token", "_m.i", "_m.j", "_m.side", "node", "open")
    held = written(_sets_of(rows.select("node").distinct(), sets, nodes), "held")
    rows = rows.join(held, "node").select("token", "i", "j", "side", "node", "open", "tokens")
    rows = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "side", "node")
    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _edges(members: DataFrame, sets: DataFrame, nodes: DataFrame, state: DataFrame, threshold: float) -> DataFrame:
    """Similar pairs (a, b): a is open, b is later and open, or led by a later node than a."""
    marked = members.join(state, "node", "left").withColumn("open", F.col("leader").isNull() & ~F.coalesce("kept", F.lit(False)))
    marked = marked.where("NOT coalesce(kept, false)")
    sizes = marked.groupBy("token").agg(F.count("*").alias("_size"), F.bool_or("open").alias("_asked")).where("_size > 1 AND _asked").drop("_asked")
    sizes = written(sizes, "sizes")
    marked = written(marked.join(sizes.select("token"), "token", "left_semi"), "buckets")
    heavy = sizes.where(F.col("_size") > HEAVY)
    light = marked.join(sizes.where(F.col("_size") <= HEAVY), "token")
    one = light.where("open").select("token", F.col("node").alias("a"), F.col("n").alias("_na"))
    met = light.join(one, "token").where((F.col("a") < F.col("node")) & _sizes_fit("n", "_na", threshold))
    met = met.where(F.col("open") | (F.col("a") < F.col("leader")))
    pairs = met.groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("c"))
    # Shared parts may be split between small and large buckets: those of large ones are not counted, so they count as shared.
    large = written(marked.join(heavy, "token").groupBy("node").agg(F.count("*").alias("h")), "in-large")
    for side in ("a", "b"):
        pairs = pairs.join(large.select(F.col("node").alias(side), F.col("h").alias(f"_{side}")), side, "left")
    pairs = pairs.where(F.col("c") + F.least(F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))) >= SHARED).select("a", "b")
    found = _similar(written(pairs, "pairs"), sets, nodes, threshold)
    return found.unionByName(_in_blocks(marked, sets, nodes, heavy, threshold)).distinct()


def leader_dedupe(rows: DataFrame, key: str, order: str, tokens: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key, kept, leader, exact) of every row, as if rows were walked by ``order`` and each merged into the first kept row that it resembles.

    ``tokens``: an array of strings (NULL: none). ``leader`` is the key of that row (NULL for kept rows), ``exact`` whether the token lists are equal.
    Rows of equal or no ``order`` are walked by digests of their token sets and lists; rows equal in all of that by key. Rows without tokens
    resemble each other only. Tokens are compared as 64-bit hashes. An empty table gives no rows; other columns are not read.
    """
    if not 0.5 < threshold < 1:
        raise ValueError("threshold must lie between 0.5 and 1")
    named = written(_token_nodes(rows, key, order, tokens), "token-sets")
    sets = named.select("row", "tokens")
    first = F.struct("order", "list", "key")
    nodes = named.groupBy("set").agg(F.min(first).alias("first"), F.min("row").alias("row"))
    # A node is the number of its place in the order of the walk.
    nodes = written(nodes.orderBy("first.order", "set").withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = _members(sets, nodes, threshold)
    # Nodes that share no part with others are kept and have no state.
    state = members.select("node").distinct().select("node", F.lit(False).alias("kept"), F.lit(None).cast("long").alias("leader"))
    for _ in range(EARLY_ROUNDS):
        state = written(state, "state")
        leaders = written(_early_leaders(members, state.where("NOT kept AND leader IS NULL").select("node")), "leaders")
        found = _similar(written(_led(members, leaders, threshold), "pairs"), sets, nodes, threshold)
        state = _settle(state, leaders, found)
    state = written(state, "state")
    edges = written(_edges(members, sets, nodes, state, threshold), "edges")
    while True:
        undecided = state.where("NOT kept AND leader IS NULL").select("node")
        if undecided.isEmpty():
            break
        waiting = edges.join(undecided.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node"))
        leaders = written(undecided.join(waiting, "node", "left_anti"), "leaders")
        found = edges.join(leaders.withColumnRenamed("node", "a"), "a", "left_semi")
        state = written(_settle(state, leaders, found), "state")
    settled = nodes.select("node", "set", "first").join(state, "node", "left")
    heads = nodes.select(F.col("node").alias("_head"), F.col("first.key").alias("_head_key"), F.col("first.list").alias("_head_list"))
    led = settled.join(heads, F.col("leader") == F.col("_head"), "left")
    out = named.select("key", "order", "list", "set").join(led, "set")
    own = F.struct("order", "list", "key").eqNullSafe(F.col("first"))
    leader_list = F.coalesce("_head_list", F.col("first.list"))
    kept = F.col("_head").isNull() & own
    return out.select(
        F.col("key").alias(key), kept.alias("kept"), F.when(~kept, F.when(F.col("_head").isNull(), F.col("first.key")).otherwise(F.col("_head_key"))).alias("leader"),
        F.when(~kept, F.col("list") == leader_list).alias("exact"))


def _settle(state: DataFrame, leaders: DataFrame, found: DataFrame) -> DataFrame:
    """New leaders are kept; the others are led by the first leader found so far."""
    best = found.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("_best"))
    rows = state.join(leaders.withColumn("_new", F.lit(True)), "node", "left").join(best, "node", "left")
    return rows.select("node", (F.col("kept") | F.col("_new").isNotNull()).alias("kept"), F.least("leader", "_best").alias("leader"))

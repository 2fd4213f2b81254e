"""Near-duplicate vectors by a forest of random-projection trees whose halves overlap.

Every tree splits the vectors at the middle of a random projection, again and again; those within ``SPILL`` of the middle
go to both sides. Vectors that meet in a leaf of any tree are compared. A pair that meets in several leaves counts in the first of
them only, which both vectors tell from the leaves they are in; so a leaf passes on a number for each vector and one link for each
join, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.llm.common import column, keep, small_batches
from turnloom.llm.components import components
from turnloom.llm.vectors import matrix, usable

SIMILAR = 0.9
TREES = 8
LEAF = 2_048      # vectors of a leaf
SPILL = 0.05      # share of a node's vectors on each side of the middle that go to both halves
SAMPLE = 4_096    # vectors of a node from which its splits are taken
LEVELS = 7        # levels of splits taken from one sample
STRIP = 512       # vectors of a leaf compared with the others at a time


def direction(tree: int, path: int, width: int) -> np.ndarray:
    """The direction in which a node is split, from its name alone."""
    return np.random.Generator(np.random.Philox(key=np.array([path, tree], np.uint64))).standard_normal(width)


def scaled(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors in double precision, each times a power of two that keeps squares finite, and their norms."""
    values = matrix(lists, width, np.float64)
    values = np.ldexp(values, -np.frexp(np.abs(values).max(1))[1][:, None])
    return values, np.sqrt((values * values).sum(1))


def take_splits(units: np.ndarray, tree: int, path: int, levels: int, spill: float) -> np.ndarray:
    """(2^levels, 2): for each node below ``path`` in heap order the projections between which vectors go to both sides; NaN: no split."""
    cuts = np.full((1 << levels, 2), np.nan)
    rows = {1: np.arange(len(units))}
    for node in range(1, 1 << levels):
        here = rows.pop(node, None)
        if here is None or len(here) < 8:
            continue
        depth = node.bit_length() - 1
        far = units[here] @ direction(tree, (path << depth) | (node - (1 << depth)), units.shape[1])
        low, high = np.quantile(far, [0.5 - spill, 0.5 + spill])
        left, right = here[far <= high], here[far >= low]
        if max(len(left), len(right)) > 0.8 * len(here):
            continue  # too many lie on one plane for this to be a split
        cuts[node] = low, high
        rows[2 * node], rows[2 * node + 1] = left, right
    return cuts


def descend(units: np.ndarray, tree: int, path: int, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, int, bool]]:
    """(rows, path, whether a further split would be of use) of the nodes where the rows end."""
    waiting = [(1, np.arange(len(units)))]
    while waiting:
        node, here = waiting.pop()
        depth = node.bit_length() - 1
        name = (path << depth) | (node - (1 << depth))
        if not len(here):
            continue
        if node >= len(cuts):
            yield here, name, True
        elif np.isnan(cuts[node, 0]):
            yield here, name, False
        else:
            far = units[here] @ direction(tree, name, units.shape[1])
            waiting.append((2 * node, here[far <= cuts[node, 1]]))
            waiting.append((2 * node + 1, here[far >= cuts[node, 0]]))


def _leaves(reps: DataFrame, width: int, trees: int, leaf: int, spill: float, sample: int) -> DataFrame:
    """(rep, leaf) for every leaf that a vector is in; rounds of splits go on until no leaf that can be split is too large."""
    nodes = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.lit(1).cast("long").alias("path")))
    todo = reps.select("rep", F.explode(nodes).alias("_node")).select("rep", "_node.*")
    done = None
    ratio = math.log(1 / (0.5 + spill))

    def split(key: tuple, rows: pa.Table) -> pa.Table:
        tree, path, levels = (k.as_py() for k in key)
        rows = rows.sort_by("rep").combine_chunks()
        values, norms = scaled(rows["embedding"].chunk(0), width)
        cuts = take_splits(values / norms[:, None], tree, path, levels, spill)
        return pa.table({"tree": pa.array([tree], pa.int32()), "path": [path], "cuts": pa.array([cuts.tobytes()], pa.binary())})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            trees_of, paths = column(batch, "tree").to_numpy(), column(batch, "path").to_numpy()
            values, norms = scaled(column(batch, "embedding"), width)
            units, reps_of, cuts_of = values / norms[:, None], column(batch, "rep").to_numpy(), column(batch, "cuts")
            order = np.lexsort((paths, trees_of))
            new = np.flatnonzero(np.append(True, (np.diff(trees_of[order]) != 0) | (np.diff(paths[order]) != 0)))
            for rows in np.split(order, new[1:]):
                tree, path = int(trees_of[rows[0]]), int(paths[rows[0]])
                cuts = np.frombuffer(cuts_of[int(rows[0])].as_py(), np.float64).reshape(-1, 2)
                for here, name, further in descend(units[rows], tree, path, cuts):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reps_of[rows[here]], pa.int64()), pa.array(np.full(len(here), tree), pa.int32()),
                         pa.array(np.full(len(here), name), pa.int64()), pa.array(np.full(len(here), further))], ["rep", "tree", "path", "further"])

    while True:
        sizes = keep(todo.groupBy("tree", "path").agg(F.count("*").alias("n")), "sizes")
        large = sizes.where(F.col("n") > leaf).withColumn("levels", F.least(F.lit(LEVELS), F.ceil(F.log(F.col("n") / leaf) / ratio)).cast("int"))
        fits = todo.join(sizes.where(F.col("n") <= leaf), ["tree", "path"], "left_semi").select("rep", "tree", "path")
        done = fits if done is None else done.unionByName(fits)
        if large.isEmpty():
            break
        rest = todo.join(large, ["tree", "path"])
        lot = Window.partitionBy("tree", "path").orderBy(F.xxhash64("rep", "tree"), "rep")
        picked = rest.withColumn("_lot", F.row_number().over(lot)).where(F.col("_lot") <= sample).select("rep", "tree", "path", "levels")
        splits = picked.join(reps.select("rep", "embedding"), "rep").groupBy("tree", "path", "levels").applyInArrow(split, "tree int, path bigint, cuts binary")
        moved = rest.select("rep", "tree", "path").join(keep(splits, "splits"), ["tree", "path"]).join(reps.select("rep", "embedding"), "rep")
        moved = keep(moved.select("rep", "tree", "path", "cuts", "embedding").mapInArrow(place, "rep bigint, tree int, path bigint, further boolean"), "placed")
        done = done.unionByName(moved.where("NOT further").select("rep", "tree", "path"))
        todo = moved.where("further").select("rep", "tree", "path")
    return done.select("rep", F.shiftleft(F.col("tree").cast("long"), 56).bitwiseOR(F.col("path")).alias("leaf"))


def _spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link for each join of the components of a symmetric matrix."""
    one, two, left = [], [], linked.any(1)
    while left.any():
        front = np.flatnonzero(left)[:1]
        left[front] = False
        while len(front):
            near = linked[front][:, left]
            found = np.flatnonzero(left)[near.any(0)]
            one.append(front[near[:, near.any(0)].argmax(0)])
            two.append(found)
            left[found] = False
            front = found
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(one or empty), np.concatenate(two or empty)


def new_links(values: np.ndarray, norms: np.ndarray, earlier: list[np.ndarray], side: np.ndarray, within: bool, similar: float) -> np.ndarray:
    """Which rows are linked and share no earlier leaf; of different sides only, unless ``within``."""
    n = len(values)
    linked = np.zeros((n, n), bool)
    for at in range(0, n, STRIP):
        to = min(n, at + STRIP)
        linked[at:to] = (values[at:to] @ values.T) / (norms[at:to, None] * norms) >= similar
    linked |= linked.T  # one rounding for both directions
    if not within:
        linked &= side[:, None] != side
    np.fill_diagonal(linked, False)
    some = np.flatnonzero(linked.any(1))
    names, counts = np.unique(np.concatenate([earlier[i] for i in some] or [np.zeros(0, np.int64)]), return_counts=True)
    names = names[counts > 1]
    if len(names):
        held = np.zeros((len(some), len(names) + 1), np.float32)
        for i, row in enumerate(some):
            place = np.searchsorted(names, earlier[row])
            place[names[np.minimum(place, len(names) - 1)] != earlier[row]] = len(names)
            held[i, place] = 1
        held = held[:, :-1]
        for at in range(0, len(some), STRIP):
            met = held[at:at + STRIP] @ held.T > 0
            linked[np.ix_(some[at:at + STRIP], some)] &= ~met
    return linked


def _compare(width: int, similar: float):
    """Rows (leaf, i, j, side, rep, copies, embedding, earlier), sorted -> (a, b, NULL): a link, (a, NULL, n): n more rows linked with a."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            if rows.num_rows < 2:
                return
            values, norms = scaled(column(rows, "embedding"), width)
            lists = column(rows, "earlier")
            ends, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            earlier = [flat[a:b] for a, b in zip(ends, ends[1:])]
            linked = new_links(values, norms, earlier, column(rows, "side").to_numpy(), current[1] == current[2], similar)
            reps, copies = column(rows, "rep").to_numpy(), column(rows, "copies").to_numpy().astype(np.float64)
            counts = (linked @ copies).astype(np.int64)  # sums stay whole in double precision
            some = np.flatnonzero(counts)
            one, two = _spanning(linked)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([reps[one], reps[some]]), pa.int64()),
                 pa.concat_arrays([pa.array(reps[two], pa.int64()), pa.nulls(len(some), pa.int64())]),
                 pa.concat_arrays([pa.nulls(len(one), pa.int64()), pa.array(counts[some], pa.int64())])], ["a", "b", "n"])

        for batch in batches:
            keys = list(zip(*[column(batch, c).to_pylist() for c in ("leaf", "i", "j")]))
            at = 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if keys[at] != current:
                    if held:
                        yield from done()
                    current, held = keys[at], []
                held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield from done()

    return run


def near_duplicates(vectors: DataFrame, similar: float = SIMILAR, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector: how many others have cosine ``similar`` or more with it, and the least vec_id it is connected with.

    Equal vectors are one from the start and count as often as they are. Vectors that are NULL, zero or hold NULL or
    non-finite components have no links; shorter vectors are filled up with zeros. Rows that repeat a vec_id count
    once; a row without one is returned as it is, without links and component. Other columns are not read. An empty table gives no rows.

    No link is below ``similar``; at the threshold a pair of evenly spread vectors is parted in 6 of 100 splits, so of 8 trees of 6 levels all miss
    it once in 10,000 times, closer pairs far less. Splits come from samples of at most ``sample`` vectors of a node; all vectors are placed.
    Leaves that no projection splits (multiples of one vector) are compared in blocks.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "embedding")
    rows = keep(usable(vectors, zeros=False), "vectors")
    reps = keep(rows.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "distinct")
    width = reps.agg(F.max(F.size("embedding"))).first()[0] or 1
    small_batches(spark, max(64, min(10_000, 16_000_000 // (8 * width))))
    places = keep(_leaves(reps, width, trees, leaf, spill, sample), "leaves")
    sizes = places.groupBy("leaf").agg(F.count("*").alias("_n")).where("_n > 1")
    chunks = F.when(F.col("_n") <= 2 * leaf, 1).otherwise(F.ceil(F.col("_n") / leaf)).cast("int")
    per_rep = places.groupBy("rep").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    dealt = reps.join(per_rep, "rep").withColumn("leaf", F.explode("leaves")).join(sizes.withColumn("chunks", chunks), "leaf")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks").cast("long")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(
        F.least(c, F.col("chunk")).alias("i"), F.greatest(c, F.col("chunk")).alias("j"), F.when(c >= F.col("chunk"), 0).otherwise(1).alias("side")))
    dealt = dealt.withColumn("_m", F.explode(meets)).select(
        "leaf", "_m.i", "_m.j", "_m.side", "rep", "copies", "embedding", F.filter("leaves", lambda x: x < F.col("leaf")).alias("earlier"))
    dealt = dealt.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "side", "rep")
    found = keep(dealt.mapInArrow(_compare(width, similar), "a bigint, b bigint, n bigint"), "links")
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = keep(components(found.where("b IS NOT NULL").select("a", "b")), "roots")
    classes = reps.join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select(
        "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = rows.join(classes, "embedding").select("vec_id", "n_links", "component_id")
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    every = ids.where("vec_id IS NOT NULL").distinct().join(linked, "vec_id", "left").unionByName(
        ids.where("vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    component = F.coalesce("component_id", "vec_id")
    return every.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
                        (F.col("vec_id") == component).alias("kept"))

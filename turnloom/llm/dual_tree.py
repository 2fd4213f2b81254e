"""Ranked lexical search by two trees: one over the items, one over the documents, with the greatest value of each coordinate in every node.

The coordinates are the items' terms: of an item their weights, of a document their impacts. The maxima of two nodes give a bound on the score of any
item of the one and any document of the other; a pair of nodes whose bound lies below the weakest k-th score of the items is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import column, keep, running_total, small_batches
from turnloom.llm.vectors import TopK

TOP = 50
TERMS_AT_ONCE = 200_000  # terms of the items that are searched for at a time (and those of one more item)
FEW_ITEMS = 4            # items of a leaf; nodes have as many children
DOCS, LEAVES = 64, 32    # documents of a leaf, leaves of a node
RESULT = "item_id bigint, rank int, doc_id bigint, score bigint"
SEEDS = 2                # nodes of the best bounds from which an item takes its first k-th score
# Letters and digits of ASCII in lower case and all bytes beyond ASCII belong to a term, every other byte separates.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 else 0x20 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


def item_terms(items: DataFrame, at_once: int) -> DataFrame:
    """(item_id, term, batch): the distinct terms of each item; batches hold some ``at_once`` terms of whole items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(column(batch, "item_id").to_pylist(), column(batch, "text").to_pylist()):
                terms = sorted(set(terms_of(text)))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(terms), pa.int64()), pa.array(terms, pa.binary())], ["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    found = keep(rows.mapInArrow(run, "item_id bigint, term binary").distinct(), "item-terms")
    counts = found.groupBy("item_id").agg(F.count("*").alias("n"))
    before = running_total(counts, [F.xxhash64("item_id"), F.col("item_id")], "n", "before")
    batches = before.select(F.col("item_id").alias("_item"), F.floor(F.col("before") / at_once).alias("batch"))
    return keep(found.join(batches, F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item"), "item-batches")


class Items(NamedTuple):
    """Items in the order of their tree: terms and weights of item i are places ``ends[i]`` to ``ends[i + 1]``."""

    ids: list[int | None]
    ends: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    nodes: list[tuple]  # (first item, last item + 1, children, terms, greatest weights), the root first

    def of(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.ends[item], self.ends[item + 1])
        return self.terms[part], self.weights[part]


def build_items(ids: list[int | None], terms: list[np.ndarray], weights: np.ndarray) -> Items:
    """The tree over the items: halves by their terms' weights along a random direction, two at a time, down to ``FEW_ITEMS``."""
    lot = np.random.Generator(np.random.Philox(11)).standard_normal((len(weights), 8))
    places = np.array([(weights[t, None] * lot[t]).sum(0) / max(1.0, float(weights[t].sum())) for t in terms]).reshape(-1, 8)
    order: list[int] = []
    nodes: list[tuple] = []

    def parts(some: np.ndarray, depth: int) -> list[np.ndarray]:
        half = np.argsort(places[some, depth % 8], kind="stable")
        return [some[half[:len(some) // 2]], some[half[len(some) // 2:]]]

    def grow(some: np.ndarray, depth: int) -> int:
        number, first = len(nodes), len(order)
        nodes.append(())
        children = []
        if len(some) <= FEW_ITEMS:
            order.extend(some.tolist())
        else:
            children = [grow(quarter, depth + 2) for half in parts(some, depth) for quarter in parts(half, depth + 1) if len(quarter)]
        held = np.unique(np.concatenate([terms[i] for i in some])).astype(np.int32)
        nodes[number] = (first, len(order), children, held, weights[held].astype(np.float64))
        return number

    if ids:
        grow(np.arange(len(ids)), 0)
    ends = np.cumsum([0] + [len(terms[i]) for i in order])
    flat = np.concatenate([terms[i] for i in order] or [np.zeros(0, np.int32)]).astype(np.int32)
    return Items([ids[i] for i in order], ends, flat, weights[flat].astype(np.float64), nodes)


def surviving(items: Items, least: np.ndarray, greatest: np.ndarray) -> Iterator[int]:
    """The items that documents with the given greatest impacts could still serve, their k-th scores being ``least``."""
    waiting = [0] if items.nodes else []
    while waiting:
        first, last, children, terms, weights = items.nodes[waiting.pop()]
        if float(weights @ greatest[terms]) < least[first:last].min():
            continue
        if children:
            waiting.extend(children)
            continue
        for item in range(first, last):
            terms, weights = items.of(item)
            if float(weights @ greatest[terms]) >= least[item]:
                yield item


def _encode(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf): the number of terms of each whole text, and the occurrences of those in the vocabulary."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for batch in batches:
            sizes, found, counts = [], [], []
            for text in column(batch, "text").to_pylist():
                terms = terms_of(text)
                ids, tf = np.unique(np.array([i for i in map(known, terms) if i is not None], np.int32), return_counts=True)
                sizes.append(len(terms))
                found.append(ids.tobytes())
                counts.append(tf.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "n", "terms", "tf"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms binary, tf binary")


def _document_frequencies(encoded: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary; a task passes on one row for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(column(batch, "terms").to_pylist()), np.int32), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["term", "df"])

    found = encoded.select("terms").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["term"].to_numpy()] = found["df"].to_numpy()
    return out


def _impacts(encoded: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, one, two, terms, impact) of documents that hold a term: one and two are the terms that add most to any score."""
    shared = encoded.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            rows, one, two, impacts = [], [], [], []
            lists = column(batch, "terms").to_pylist()
            for i, (n, terms, tf) in enumerate(zip(column(batch, "n").to_pylist(), lists, column(batch, "tf").to_pylist())):
                if not terms:
                    continue
                terms, tf = np.frombuffer(terms, np.int32), np.frombuffer(tf, np.int64)
                m = 100 - 50 + 50 * n * n_docs // n_terms
                impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m)
                adds = weight[terms] * impact
                first = int(adds.argmax())
                adds[first] = -1
                rows.append(i)
                one.append(int(terms[first]))
                two.append(int(terms[adds.argmax()]))
                impacts.append(impact.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").take(pa.array(rows, pa.int64())), pa.array(one, pa.int32()), pa.array(two, pa.int32()),
                 pa.array([lists[i] for i in rows], pa.binary()), pa.array(impacts, pa.binary())], ["doc_id", "one", "two", "terms", "impact"])

    return encoded.where("doc_id IS NOT NULL").mapInArrow(run, "doc_id bigint, one int, two int, terms binary, impact binary")


def _maxima(terms: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(terms, kind="stable")
    terms, impact = terms[order], impact[order]
    starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
    return terms[starts], np.maximum.reduceat(impact, starts)


NODE = ("node bigint, ids binary, rows binary, terms binary, impact binary, leaf_ends binary, leaf_terms binary, leaf_most binary, "
        "node_terms binary, node_most binary")


def _grow(rows: DataFrame, docs: int, leaves: int) -> DataFrame:
    """The tree over the documents, a row for each node of ``leaves`` leaves of ``docs`` documents: like documents are neighbours by the terms that add most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = [part.split()[0] for part in NODE.split(", ")]
        number, held = TaskContext.get().partitionId() << 32, []

        def node() -> pa.RecordBatch:
            sizes = [len(t) for _, t, _ in held]
            terms, impact = np.concatenate([t for _, t, _ in held]), np.concatenate([x for _, _, x in held])
            ends = np.cumsum([0, *sizes])
            parts = [_maxima(terms[ends[a]:ends[b]], impact[ends[a]:ends[b]])
                     for a, b in ((a, min(len(held), a + docs)) for a in range(0, len(held), docs))]
            leaf_terms, leaf_most = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            every, most = _maxima(leaf_terms, leaf_most)
            values = [np.array([d for d, _, _ in held], np.int64), np.repeat(np.arange(len(held), dtype=np.int32), sizes), terms, impact,
                      np.cumsum([0, *(len(x) for x, _ in parts)]).astype(np.int64), leaf_terms, leaf_most, every, most]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([v.tobytes()], pa.binary()) for v in values]], names)

        for batch in batches:
            for doc_id, terms, impact in zip(*[column(batch, c).to_pylist() for c in ("doc_id", "terms", "impact")]):
                held.append((doc_id, np.frombuffer(terms, np.int32), np.frombuffer(impact, np.int32)))
                if len(held) == docs * leaves:
                    yield node()
                    number, held = number + 1, []
        if held:
            yield node()

    lot = rows.withColumn("_lot", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    laid = lot.repartitionByRange("one", "two", "_lot").sortWithinPartitions("one", "two", "_lot")
    return laid.mapInArrow(run, NODE)


def _dense(terms: bytes, most: bytes, size: int) -> np.ndarray:
    out = np.zeros(size)
    out[np.frombuffer(terms, np.int32)] = np.frombuffer(most, np.int32)
    return out


class Node:
    """A node of documents as a task searches it."""

    def __init__(self, row: dict, size: int, docs: int):
        self.ids, self.docs = np.frombuffer(row["ids"], np.int64), docs
        self.rows, self.terms, self.impact = [np.frombuffer(row[c], np.int32) for c in ("rows", "terms", "impact")]
        ends, terms, most = np.frombuffer(row["leaf_ends"], np.int64), np.frombuffer(row["leaf_terms"], np.int32), np.frombuffer(row["leaf_most"], np.int32)
        self.leaves = np.zeros((len(ends) - 1, size), np.float32)  # impacts are below 2^24
        self.leaves[np.repeat(np.arange(len(ends) - 1), np.diff(ends)), terms] = most
        order = np.argsort(self.terms, kind="stable")
        self.rows, self.impact = self.rows[order], self.impact[order].astype(np.float64)
        self.starts = np.searchsorted(self.terms[order], np.arange(size + 1))

    def scores(self, terms: np.ndarray, weights: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of ``least`` or more, by adding up postings in leaves whose bound allows it; sums are below 2^53, so exact."""
        open_leaves = self.leaves[:, terms].astype(np.float64) @ weights >= least
        if not open_leaves.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, counts = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        weight, rows = np.repeat(weights, counts), self.rows[at]
        if not open_leaves.all():
            inside = open_leaves[rows // self.docs]
            at, weight, rows = at[inside], weight[inside], rows[inside]
        total = np.bincount(rows, weights=weight * self.impact[at], minlength=len(self.ids))
        good = np.flatnonzero(total >= least)
        return self.ids[good], total[good].astype(np.int64)


def _search(items: Broadcast, least: Broadcast, size: int, docs: int, top: int):
    """(item, doc_id, score) of the best documents of a task's nodes for each item; ``asked``: only these items, if the column is there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, bar = items.value, least.value.copy()
        best = TopK(len(found.ids), top, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                wanted = surviving(found, bar, _dense(row["node_terms"], row["node_most"], size))
                wanted = row["asked"] if "asked" in row else list(wanted)
                node = Node(row, size, docs) if wanted else None
                for item in wanted:
                    ids, scores = node.scores(*found.of(item), bar[item])
                    best.add(item, scores, ids)
                    worst = best.worst(item)
                    if worst is not None:
                        bar[item] = max(bar[item], worst)
        counts = [len(x) for x in best.ids]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(counts)), counts), pa.int32()), pa.array(np.concatenate([*best.ids, np.zeros(0, np.int64)]), pa.int64()),
             pa.array(np.concatenate([*best.scores, np.zeros(0, np.int64)]), pa.int64())], ["item", "doc_id", "score"])

    return run


def _best_nodes(items: Broadcast, size: int):
    """(item, node, bound): of a task's nodes the ``SEEDS`` with the greatest bounds for each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = items.value
        best = TopK(len(found.ids), SEEDS, np.float64)
        for batch in batches:
            for node, terms, most in zip(*[column(batch, c).to_pylist() for c in ("node", "node_terms", "node_most")]):
                bound = np.add.reduceat(np.append(found.weights * _dense(terms, most, size)[found.terms], 0), found.ends[:-1])
                for item in np.flatnonzero(bound > 0):
                    best.add(int(item), bound[item:item + 1], np.array([node]))
        counts = [len(x) for x in best.ids]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(counts)), counts), pa.int32()), pa.array(np.concatenate([*best.ids, np.zeros(0, np.int64)]), pa.int64()),
             pa.array(np.concatenate([*best.scores, np.zeros(0)]), pa.float64())], ["item", "node", "bound"])

    return run


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= top)


def _search_batch(documents: DataFrame, terms: list[tuple[int | None, bytes]], top: int, docs: int, leaves: int) -> DataFrame:
    """The ranking of one batch of items, given as (item_id, term)."""
    spark, context = documents.sparkSession, documents.sparkSession.sparkContext
    vocabulary = {term: i for i, term in enumerate(sorted({t for _, t in terms}))}
    size = len(vocabulary)
    small_batches(spark)
    encoded = keep(_encode(documents, vocabulary), "encoded")
    n_docs, n_terms = encoded.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _document_frequencies(encoded, size)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    tree = keep(_grow(_impacts(encoded, weights, n_docs, max(1, n_terms)), docs, leaves), "tree")
    of_item: dict[int | None, list[int]] = {}
    for item, term in terms:
        if df[vocabulary[term]]:
            of_item.setdefault(item, []).append(vocabulary[term])
    ids = sorted(of_item, key=lambda i: (i is None, i or 0))
    if not ids:
        return spark.createDataFrame([], RESULT)
    built = build_items(ids, [np.array(sorted(of_item[i]), np.int32) for i in ids], weights)
    items = context.broadcast(built)
    small_batches(spark, 8)
    # First k-th scores from the nodes that promise most; then all nodes against them.
    promising = tree.select("node", "node_terms", "node_most").mapInArrow(_best_nodes(items, size), "item int, node bigint, bound double")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "node"))
    seeds = promising.withColumn("_place", place).where(F.col("_place") <= SEEDS).groupBy("node").agg(F.sort_array(F.collect_list("item")).alias("asked"))
    none = context.broadcast(np.ones(len(ids)))  # a score is above 0
    first = tree.join(keep(seeds, "seeds"), "node").mapInArrow(_search(items, none, size, docs, top), "item int, doc_id bigint, score bigint")
    known = _ranked(first, top).where(F.col("rank") == top).select("item", "score").toArrow()  # at most one row for each item
    least = np.ones(len(ids))
    least[known["item"].to_numpy()] = known["score"].to_numpy()
    found = tree.mapInArrow(_search(items, context.broadcast(least), size, docs, top), "item int, doc_id bigint, score bigint")
    found = keep(_ranked(found, top), "ranking")
    named = spark.createDataFrame([(i, item) for i, item in enumerate(built.ids)], "item int, item_id bigint")
    return found.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(documents: DataFrame, items: DataFrame, top: int = TOP, docs: int = DOCS, leaves: int = LEAVES, at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, equal scores by doc_id.

    Every whole text is read; statistics cover all documents. Exact: a node is left out only if its bound is below a score that ``top``
    documents of the item reach. NULL and empty texts have no terms. Rows that share an item_id (NULL is one) are one item with the terms of
    all; rows that repeat a doc_id are documents of their own, and may both be ranked; a document without an id counts in the
    statistics but is not ranked. Other columns are not read. Without items, documents or common terms there are no rows.

    Items are searched in batches of some ``at_once`` terms, which bounds what is sent to the tasks and held by the driver
    (terms, weights, and one score for each item); each batch reads the documents once.
    """
    spark = documents.sparkSession
    documents, items = documents.select("doc_id", "text"), items.select("item_id", "text")
    small_batches(spark)
    asked = item_terms(items, at_once)
    out = None
    for (batch,) in sorted(asked.select("batch").distinct().collect()):
        rows = asked.where(F.col("batch") == batch).select("item_id", "term").toArrow()
        found = _search_batch(documents, list(zip(rows["item_id"].to_pylist(), rows["term"].to_pylist())), top, docs, leaves)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], RESULT)

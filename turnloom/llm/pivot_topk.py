"""Exact top-k by inner product with a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import column, keep, small_batches
from turnloom.llm.vectors import matrix, packed, unpack, usable

K, PIVOTS, SAMPLE = 20, 32, 2048
INDEX_ROWS, QUERY_ROWS = 1024, 1024
#: Tasks that share the index between them, and queries that a task takes through its share of it.
SHARES, TASK_QUERIES = 8, 4096
SLACK = 1e-6
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def scaled(vectors: DataFrame, factor: int = 64) -> DataFrame:
    """Components as floor(factor * x), x as double."""
    return vectors.withColumn("embedding", F.transform("embedding", lambda x: F.floor(x.cast("double") * factor).cast("long")))


def choose_pivots(sample: np.ndarray, number: int) -> np.ndarray:
    """Farthest-first from the mean."""
    near = ((sample - sample.mean(0)) ** 2).sum(1)
    picked = [int(near.argmin())]
    near = ((sample - sample[picked[0]]) ** 2).sum(1)
    while len(picked) < min(number, len(sample)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


class Space:
    """Vectors with one more component that lifts all to one length, where the largest inner product is the least distance.

    A vector x becomes (x, sqrt(top - x.x)); a query q becomes (q, 0): |q' - x'|^2 = q.q + top - 2 q.x.
    """

    def __init__(self, width: int, top: float, kind: str):
        self.width, self.top, self.kind = width, top, kind
        self.pivots = np.zeros((0, width + 1))

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.top - (x * x).sum(1)))
        return np.hstack([x, rest[:, None]])

    def far(self, lifted: np.ndarray) -> np.ndarray:
        """Distances to all pivots."""
        square = (lifted ** 2).sum(1)[:, None] + (self.pivots ** 2).sum(1) - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(0, square))

    def far_of_queries(self, q: np.ndarray) -> np.ndarray:
        return self.far(np.hstack([q, np.zeros((len(q), 1))]))

    def radius(self, squares: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distances at which candidates have these scores, for queries with these squares."""
        return np.sqrt(np.maximum(0, squares + self.top - 2 * scores.astype(float)))


def narrowest(low: int, high: int) -> str:
    """The least type of integers that holds the components."""
    return next(kind for kind in ("int8", "int16", "int32", "int64") if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; in floats or doubles where those are exact."""
    most = lambda a: max(1, int(a.max(initial=0)), -int(a.min(initial=0)))
    biggest = most(q) * most(x) * q.shape[1]
    kind = np.float32 if biggest < 1 << 24 else np.float64 if biggest < 1 << 53 else np.int64
    return q.astype(kind) @ x.astype(kind).T


def few_places(truths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a table with few truths, which are looked for eight at a time."""
    flat = truths.reshape(-1)
    if flat.size % 8:
        return np.divmod(np.flatnonzero(flat), truths.shape[1])
    words = np.flatnonzero(flat.view(np.uint64))
    word, place = np.nonzero(flat.reshape(-1, 8)[words])
    return np.divmod(words[word] * 8 + place, truths.shape[1])


class Best:
    """The best k (score, id) of each query of a block; ties go to the smaller id, and a query is no candidate of its own.

    What is worse than ``worst`` (and ``worst_ids`` among equals) of its query cannot be among them. Candidates wait until
    they are as many as the best and are merged together.
    """

    def __init__(self, query_ids: np.ndarray, k: int, worst: np.ndarray | None = None, worst_ids: np.ndarray | None = None):
        n = len(query_ids)
        self.query_ids, self.k, self.waiting = query_ids, k, 0
        self.worst = np.full(n, LEAST) if worst is None else worst.copy()
        self.worst_ids = np.full(n, MOST) if worst_ids is None else worst_ids.copy()
        self.held = [(np.zeros(0, np.int64),) * 3]  # places of queries, scores, ids

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> bool:
        """Takes a row of scores for each of ``queries``, a column for each id; true if ``worst`` is new."""
        floor = self.worst[queries].astype(scores.dtype)[:, None]
        over = scores >= floor
        if self.k + 1 < len(ids) and np.count_nonzero(over) > 2 * (self.k + 1) * len(queries):
            # One more than k, as the query itself may be among them.
            floor = np.maximum(floor, np.partition(scores, -self.k - 1, axis=1)[:, -self.k - 1, None])
            over = scores >= floor
        at, place = few_places(over)
        rows, found, values = queries[at], ids[place], scores[at, place].astype(np.int64)
        fine = (values > self.worst[rows]) | ((values == self.worst[rows]) & (found <= self.worst_ids[rows]))
        fine &= found != self.query_ids[rows]
        if not fine.any():
            return False
        self.held.append((rows[fine], values[fine], found[fine]))
        self.waiting += int(fine.sum())
        if self.waiting < self.k * len(self.query_ids):
            return False
        self.settle()
        return True

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, scores, ids and ranks from 0, in order."""
        rows, scores, ids = [np.concatenate(x) for x in zip(*self.held)]
        order = np.lexsort((ids, ~scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        ranks = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = ranks < self.k
        rows, scores, ids, ranks = rows[top], scores[top], ids[top], ranks[top]
        last = ranks == self.k - 1
        self.worst[rows[last]], self.worst_ids[rows[last]] = scores[last], ids[last]
        self.held, self.waiting = [(rows, scores, ids)], 0
        return rows, scores, ids, ranks


class Search:
    """A block of queries on its way through annuli."""

    def __init__(self, space: Space, k: int, ids: bytes, data: bytes, worst: bytes | None = None, worst_ids: bytes | None = None):
        self.space = space
        found, self.q = unpack(ids, data, space.kind, space.width)
        real = self.q.astype(float)
        self.squares, self.far = (real * real).sum(1), space.far_of_queries(real)
        given = [None if w is None else np.frombuffer(w, np.int64) for w in (worst, worst_ids)]
        self.best = Best(found, k, *given)
        self.aim()

    def aim(self) -> None:
        worst = self.best.worst
        reach = self.space.radius(self.squares, worst) * (1 + SLACK) + SLACK
        self.reach = np.where(worst == LEAST, np.inf, reach)

    def look(self, pivot: int, lo: float, hi: float, ids: np.ndarray, data: np.ndarray) -> None:
        far = self.far[:, pivot]
        active = np.flatnonzero(np.maximum(lo - far, far - hi) <= self.reach)
        if len(active) and self.best.offer(active, products(self.q[active], data), ids):
            self.aim()


def _keyed(rows: DataFrame, space: Space) -> DataFrame:
    """Adds the nearest pivot and the distance to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = space.far(space.lift(matrix(column(batch, "embedding"), space.width, np.float64)))
            pivot = far.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "vec_id"), column(batch, "embedding"), pa.array(pivot.astype(np.int32)), pa.array(far[np.arange(len(far)), pivot])],
                ["vec_id", "embedding", "pivot", "distance"])
    return rows.mapInArrow(run, "vec_id bigint, embedding array<bigint>, pivot int, distance double")


def _query_spans(blocks: DataFrame, space: Space) -> DataFrame:
    """For each query block and pivot the least and greatest distance from a query to the pivot, and whether it is the block's own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, own, ids, data in zip(*[column(batch, c).to_pylist() for c in ("block", "pivot", "ids", "data")]):
                far = space.far_of_queries(unpack(ids, data, space.kind, space.width)[1].astype(float))
                n = far.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.arange(n) == own), pa.array(far.min(0)), pa.array(far.max(0))],
                    ["query_block", "pivot", "own", "q_lo", "q_hi"])
    return blocks.mapInArrow(run, "query_block bigint, pivot int, own boolean, q_lo double, q_hi double")


SOUGHT = ("query_block bigint, q_ids binary, q_data binary, q_worst binary, q_worst_ids binary, reach double, "
          "q_lo array<double>, q_hi array<double>")


def _seeded(space: Space, k: int):
    """Stream query blocks, each followed by its seeds: the blocks with the k-th scores found, their reach and their spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, search = None, None

        def done() -> pa.RecordBatch:
            best = search.best
            best.settle()
            search.aim()
            values = [row["query_block"], row["ids"], row["data"], best.worst.tobytes(), best.worst_ids.tobytes(), float(search.reach.max()),
                      search.far.min(0).tolist(), search.far.max(0).tolist()]
            kinds = [pa.int64()] + [pa.binary()] * 4 + [pa.float64()] + [pa.list_(pa.float64())] * 2
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds)], [c.split()[0] for c in SOUGHT.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                if r["bound"] < 0:
                    if search is not None:
                        yield done()
                    row, search = r, Search(space, k, r["ids"], r["data"])
                else:
                    search.look(r["pivot"], r["lo"], r["hi"], *unpack(r["ids"], r["data"], space.kind, space.width))
        if search is not None:
            yield done()
    return run


FOUND = "query_block bigint, query_ids binary, scores binary, ids binary"


def _searched(space: Space, k: int):
    """Stream annuli, each beside the query blocks of the task that reach it: the best of what the task was shown."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches: dict[int, Search] = {}
        at, ids, data = None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] != at:
                    at, (ids, data) = r["block"], unpack(r["ids"], r["data"], space.kind, space.width)
                search = searches.get(r["query_block"])
                if search is None:
                    search = searches[r["query_block"]] = Search(space, k, r["q_ids"], r["q_data"], r["q_worst"], r["q_worst_ids"])
                search.look(r["pivot"], r["lo"], r["hi"], ids, data)
        for block, search in searches.items():
            rows, scores, found, _ = search.best.settle()
            if len(rows):
                values = [search.best.query_ids[rows].tobytes(), scores.tobytes(), found.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([v], pa.binary()) for v in values]],
                                                 [c.split()[0] for c in FOUND.split(", ")])
    return run


def _merged(k: int):
    """Stream what tasks found, one query block after the other: ranked rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> pa.RecordBatch:
            asked, scores, ids = [np.concatenate(x) for x in zip(*held)]
            query_ids, places = np.unique(asked, return_inverse=True)
            best = Best(query_ids, k)
            best.held = [(places, scores, ids)]
            rows, scores, ids, ranks = best.settle()
            return pa.RecordBatch.from_arrays([pa.array(query_ids[rows]), pa.array((ranks + 1).astype(np.int32)), pa.array(ids), pa.array(scores)],
                                              ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["query_block"] != at:
                    if held:
                        yield done()
                    at, held = r["query_block"], []
                held.append([np.frombuffer(r[c], np.int64) for c in ("query_ids", "scores", "ids")])
        if held:
            yield done()
    return run


def _with_payload(pairs: DataFrame, queries: DataFrame, index: DataFrame) -> DataFrame:
    """Each query block's own row, then its annuli by bound, in one partition."""
    annuli = pairs.join(index.select("block", "ids", "data"), "block").select("query_block", "bound", "block", "pivot", "lo", "hi", "ids", "data")
    own = queries.select(F.col("block").alias("query_block"), F.lit(-1.0).alias("bound"), F.lit(-1).cast("long").alias("block"),
                         "pivot", "lo", "hi", "ids", "data")
    return own.unionAll(annuli).repartition("query_block").sortWithinPartitions("query_block", "bound", "block")


def top_k(vectors: DataFrame, queries: Column, k: int = K, factor: int = 64, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products for each row of ``vectors`` that ``queries`` picks.

    Candidates are all rows but the query's own; ties go to the smaller vec_id; fewer candidates than k give fewer rows. Rows
    without id, vector or with NULL or non-finite components take no part; repeats of a vec_id count once; shorter
    vectors are filled up with zeros; an empty table gives an empty result. Scores are longs (products beyond them wrap).

    The index keys every vector by its nearest pivot and its distance, sorts by that key and cuts it
    into annuli of at most INDEX_ROWS vectors. A block of near queries first searches its two nearest annuli;
    the k-th score found gives a reach, and an annulus is searched only if the triangle inequality
    lets it lie within. No vector is shuffled for a query: a task reads a share of the index from where it is kept, past
    the query blocks of the task, and only the best k of each query and share are merged in a shuffle. The shares are
    SHARES at most and the queries of a task bounded, so tasks grow in number with the queries, and disk with the input.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    clean = keep(scaled(usable(vectors, zeros=True), factor), "vectors")
    width, top, low, high = clean.agg(F.max(F.size("embedding")), F.max(F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), F.min(F.array_min("embedding")), F.max(F.array_max("embedding"))).first()
    if not width:
        if width is None:
            return spark.createDataFrame([], RESULT)
        width, low, high = 1, 0, 0
    space = Space(width, float(top), narrowest(min(low, 0), max(high, 0)))
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    space.pivots = choose_pivots(space.lift(matrix(sample, width, np.float64)), pivots)
    keyed = keep(_keyed(clean, space), "keyed")
    order = ["pivot", "distance", "vec_id"]
    lay = lambda frame: frame.repartitionByRange(*order).sortWithinPartitions(*order)
    index = keep(packed(lay(keyed), ["pivot"], width, space.kind, INDEX_ROWS, "distance"), "index")
    asked = keep(packed(lay(keyed.where(queries)), ["pivot"], width, space.kind, QUERY_ROWS, "distance"), "queries")
    number = asked.agg(F.sum("n")).first()[0]
    if not number:
        return spark.createDataFrame([], RESULT)
    bound = F.greatest(F.lit(0.0), F.col("lo") - F.col("q_hi"), F.col("q_lo") - F.col("hi"))
    pairs = _query_spans(asked, space).join(index.select("pivot", "block", "lo", "hi"), "pivot").withColumn("bound", bound)
    small_batches(spark, 16)  # of a packed block each
    nearest = Window.partitionBy("query_block").orderBy("bound", ~F.col("own"), "block")
    seeds = pairs.withColumn("place", F.row_number().over(nearest)).where("place <= 2")
    sought = keep(_with_payload(seeds, asked, index).mapInArrow(_seeded(space, k), SOUGHT), "sought")
    within = F.expr("greatest(0D, lo - q_hi[pivot], q_lo[pivot] - hi) <= reach")
    shares = index.select("block", "pivot", "lo", "hi", "ids", "data").coalesce(SHARES)
    # Pairs of a share and some query blocks, made where the task runs; a broadcast would grow with the input.
    met = shares.hint("shuffle_replicate_nl").join(sought.repartition(-(-number // TASK_QUERIES)), within)
    found = keep(met.mapInArrow(_searched(space, k), FOUND), "found")
    return found.repartition("query_block").sortWithinPartitions("query_block").mapInArrow(_merged(k), RESULT)

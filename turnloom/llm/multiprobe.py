"""Approximate nearest neighbours by inner product: p-stable hashing with multiple probes and exact reranking."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import column, keep, small_batches
from turnloom.llm.vectors import TopK, matrix, packed, ranked_rows, unpack, usable

K, TABLES, HASHES, WIDTH, PROBES = 20, 5, 3, 1.0, 27
BANDS, STEP = 32, 2  # norm bands at most, and bands for each halving of the norm
GOAL = 0.9           # chance to meet a row that beats the k-th one found
BLOCK_ROWS, QUERY_ROWS = 512, 256
RESULT = "query_id bigint, rank int, vec_id bigint, score double"
MARGIN = 1e-9


class Hashes:
    """floor((a.v + b) / w) with normal a: HASHES of them make the bucket of a table.

    ``tops`` are the largest squared norms of the bands, greatest first. Each band has tables of its own.
    """

    def __init__(self, width: int, tops: list[float], tables: int, hashes: int, slot: float, seed: int = 20):
        draw = np.random.default_rng(seed)
        self.width, self.tables, self.slot = width, tables, slot
        self.tops = np.maximum(sorted(tops, reverse=True), 1e-300) * (1 + MARGIN)
        self.a = draw.normal(size=(tables, width + 1, hashes))
        self.b = draw.uniform(0, slot, (tables, 1, hashes))
        self.shifts = np.arange(hashes) * (60 // hashes)
        self.edge = 1 << (60 // hashes - 1)

    def places(self, lifted: np.ndarray) -> np.ndarray:
        """(table, row, hash): where each row lies, in slots."""
        return (lifted @ self.a + self.b) / self.slot

    def bucket(self, slots: np.ndarray) -> np.ndarray:
        held = np.clip(slots, -self.edge, self.edge - 1).astype(np.int64) + self.edge
        return (held << self.shifts).sum(-1)

    def slots(self, buckets: np.ndarray) -> np.ndarray:
        return (buckets[:, None] >> self.shifts & 2 * self.edge - 1) - self.edge

    def rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band of each row, and largest inner product as least distance: (x, sqrt(top - x.x)) / sqrt(top)."""
        squares = (x * x).sum(1)
        bands = np.maximum(np.searchsorted(-self.tops, -squares, side="right") - 1, 0)
        tops = self.tops[bands]
        rest = np.sqrt(np.maximum(0, tops - squares))
        return bands, np.hstack([x, rest[:, None]]) / np.sqrt(tops)[:, None]

    def queries(self, q: np.ndarray) -> np.ndarray:
        q = q / np.abs(q).max(1)[:, None]
        return np.hstack([q / np.sqrt((q * q).sum(1))[:, None], np.zeros((len(q), 1))])


class Cells(NamedTuple):
    """The buckets of a table of a band that hold rows."""
    buckets: np.ndarray
    slots: np.ndarray
    counts: np.ndarray


def perturbations(parts: np.ndarray, number: int) -> list[tuple[tuple[int, int], ...]]:
    """Shifts of slots in order of estimated success: least sum of squared distances to the borders crossed.

    ``parts`` is the place within its slot for each hash. The first is the query's own bucket.
    """
    moves = sorted([(p * p, i, -1) for i, p in enumerate(parts)] + [((1 - p) ** 2, i, 1) for i, p in enumerate(parts)])
    out, heap = [()], [(moves[0][0], (0,))]
    while heap and len(out) < number:
        cost, chosen = heapq.heappop(heap)
        if len({moves[i][1] for i in chosen}) == len(chosen):
            out.append(tuple(moves[i][1:] for i in chosen))
        last, following = chosen[-1], chosen[-1] + 1
        if following < len(moves):
            heapq.heappush(heap, (cost - moves[last][0] + moves[following][0], (*chosen[:-1], following)))
            heapq.heappush(heap, (cost + moves[following][0], (*chosen, following)))
    return out


def first_cells(places: np.ndarray, cells: Cells, probes: int, need: int) -> np.ndarray:
    """(query, cell): the ``probes`` neighbours, and on in order of estimated success until ``need`` rows or all are met."""
    below = cells.slots[None] - places[:, None]
    cost = (np.maximum(np.maximum(below, -below - 1), 0) ** 2).sum(-1)
    near = (np.abs(cells.slots[None] - np.floor(places)[:, None]) <= 1).all(-1)
    if probes < 3 ** places.shape[1]:
        for i, parts in enumerate(places - np.floor(places)):
            last = perturbations(parts, probes)[-1]
            near[i] &= cost[i] <= sum((parts[h] if step < 0 else 1 - parts[h]) ** 2 for h, step in last) + MARGIN
    order = np.argsort(cost, axis=1, kind="stable")
    counts = cells.counts[order]
    on = np.empty_like(near)
    np.put_along_axis(on, order, np.cumsum(counts, 1) - counts < need, 1)
    return near | on


def chances(places: np.ndarray, cells: Cells, far: np.ndarray) -> np.ndarray:
    """(query, cell): chance that a row lies there if it is ``far`` slots from the query."""
    low = cells.slots.min()
    borders = (np.arange(low, cells.slots.max() + 2) - places[:, :, None]) / np.maximum(far, 1e-9)[:, None, None]
    below = (1 + np.vectorize(math.erf, otypes=[float])(borders / math.sqrt(2))) / 2
    within, out = np.diff(below, axis=2), 1.0
    for h in range(places.shape[1]):
        out = out * within[:, h, cells.slots[:, h] - low]
    return out


def further_cells(met: list[np.ndarray], chance: list[np.ndarray]) -> list[np.ndarray]:
    """What queries visit beyond the cells ``met`` of each table, likeliest first, until a row is missed by all
    tables with a chance of at most 1 - GOAL."""
    miss = []
    for seen, p in zip(met, chance):
        every = p.sum(1)
        miss.append(np.where(every > 0, np.where(seen, 0, p).sum(1) / np.where(every > 0, every, 1), 0))
    short = np.prod(miss, axis=0) > 1 - GOAL
    allowed = (1 - GOAL) ** (1 / len(met))
    out = []
    for seen, p in zip(met, chance):
        left = np.where(seen, 0, p)
        order = np.argsort(-left, axis=1, kind="stable")
        ranked = np.take_along_axis(left, order, 1)
        after = np.cumsum(ranked[:, ::-1], 1)[:, ::-1]  # what is missed if the search ends before this cell
        on = np.empty_like(seen)
        np.put_along_axis(on, order, after > allowed * p.sum(1)[:, None], 1)
        out.append(on & ~seen & short[:, None])
    return out


def _batches(batch: pa.RecordBatch, table: int, take: np.ndarray, buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(take), 4096):
        some = pa.array(take[at:at + 4096])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), table, np.int32)), pa.array(buckets[at:at + 4096]),
             column(batch, "vec_id").take(some), column(batch, "embedding").take(some)],
            ["hash_table", "bucket", "vec_id", "embedding"])


def _schema(rows: DataFrame) -> str:
    return f"hash_table int, bucket bigint, vec_id bigint, embedding {rows.schema['embedding'].dataType.simpleString()}"


def _bucketed(rows: DataFrame, hashes: Hashes) -> DataFrame:
    """A row per table of its band: (hash_table, bucket, vec_id, embedding)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bands, lifted = hashes.rows(matrix(column(batch, "embedding"), hashes.width, np.float64))
            slots = np.floor(hashes.places(lifted))
            for band in np.unique(bands).tolist():
                take = np.flatnonzero(bands == band)
                for t in range(hashes.tables):
                    yield from _batches(batch, band * hashes.tables + t, take, hashes.bucket(slots[t][take]))
    return rows.mapInArrow(run, _schema(rows))


def _directory(index: DataFrame, hashes: Hashes) -> dict[int, Cells]:
    """Lifted rows have length 1, so a table has some thousand buckets at most, however many rows."""
    found: dict[int, list] = {}
    for table, bucket, n in index.groupBy("hash_table", "bucket").agg(F.sum("n")).orderBy("hash_table", "bucket").collect():
        found.setdefault(table, []).append((bucket, n))
    out = {}
    for table, rows in found.items():
        buckets, counts = np.array(rows, np.int64).T
        out[table] = Cells(buckets, hashes.slots(buckets), counts)
    return out


def _probing(rows: DataFrame, hashes: Hashes, shared, probes: int, k: int, on: bool) -> DataFrame:
    """A row per bucket that a query visits at first, or, ``on``, for what may beat its k-th score ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                q = matrix(column(batch, "embedding"), hashes.width, np.float64)
                places = hashes.places(hashes.queries(q))
                for band, top in enumerate(hashes.tops):
                    names = [t for t in range(hashes.tables) if band * hashes.tables + t in directory]
                    if not names:
                        continue
                    cells = [directory[band * hashes.tables + t] for t in names]
                    visits = [first_cells(places[t], c, probes, k + 1) for t, c in zip(names, cells)]
                    if on:
                        share = column(batch, "least").to_numpy() / np.maximum(np.sqrt((q * q).sum(1) * top), 1e-300)
                        far = np.sqrt(2 - 2 * np.clip(share, -1, 1)) / hashes.slot
                        visits = further_cells(visits, [chances(places[t], c, far) for t, c in zip(names, cells)])
                        visits = [v & (share <= 1 + MARGIN)[:, None] for v in visits]
                    for t, c, visit in zip(names, cells, visits):
                        take, cell = np.nonzero(visit)
                        yield from _batches(batch, band * hashes.tables + t, take, c.buckets[cell])
    return rows.mapInArrow(run, _schema(rows))


def scores_of(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component on, so that equal vectors score alike everywhere."""
    return np.cumsum(rows * query, axis=1)[:, -1]


def _rerank(width: int, k: int, kind: str):
    """The k best of each query of a block among the candidates of a block, exactly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asked, q = unpack(row["q_ids"], row["q_data"], kind, width)
                ids, x = unpack(row["ids"], row["data"], kind, width)
                rough = q @ x.T
                best = TopK(len(asked), k, np.float64)
                for i in range(len(asked)):
                    mine = rough[i]
                    if len(ids) > k + 1:
                        least = np.partition(mine, len(ids) - k - 1)[len(ids) - k - 1]
                        near = np.flatnonzero(mine >= least - MARGIN * (1 + abs(least)))
                    else:
                        near = np.arange(len(ids))
                    near = near[ids[near] != asked[i]]
                    best.add(i, scores_of(q[i], x[near]), ids[near])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked), pa.array([i.tobytes() for i in best.ids], pa.binary()), pa.array([s.tobytes() for s in best.scores], pa.binary())],
                    ["query_id", "found", "scores"])
    return run


FOUND = "query_id bigint, found binary, scores binary"


def _merge(k: int, ranked: bool):
    """Merge the lists of a query from all tables and blocks, into one list (FOUND) or ``ranked`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, scores = None, [], []

        def done() -> pa.RecordBatch:
            every, first = np.unique(np.concatenate(ids), return_index=True)
            best = TopK(1, k, np.float64)
            best.add(0, np.concatenate(scores)[first], every)
            if ranked:
                return ranked_rows(np.array([current]), best, pa.float64())
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int64()), pa.array([best.ids[0].tobytes()], pa.binary()), pa.array([best.scores[0].tobytes()], pa.binary()),
                 pa.array([best.worst(0)], pa.float64())], ["query_id", "found", "scores", "least"])

        for batch in batches:
            for query, found, score in zip(*[column(batch, c).to_pylist() for c in ("query_id", "found", "scores")]):
                if query != current:
                    if ids:
                        yield done()
                    current, ids, scores = query, [], []
                ids.append(np.frombuffer(found, np.int64))
                scores.append(np.frombuffer(score, np.float64))
                if len(ids) == 64:
                    every, first = np.unique(np.concatenate(ids), return_index=True)
                    best = TopK(1, k, np.float64)
                    best.add(0, np.concatenate(scores)[first], every)
                    ids, scores = [best.ids[0]], [best.scores[0]]
        if ids:
            yield done()
    return run


def nearest(vectors: DataFrame, queries: Column, k: int = K, tables: int = TABLES, hashes: int = HASHES, slot: float = WIDTH,
            probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each row that ``queries`` picks.

    Candidates are all rows but the query's own; ties go to the smaller vec_id. Rows without id or vector, zero
    vectors and those with NULL or non-finite components take no part; repeats of a vec_id count once; an empty table gives an empty
    result. A query has k result rows, or all candidates if there are fewer.

    Rows are split into bands by norm, each lifted by its own largest norm. Every row is indexed under its bucket in each
    table of its band; a query visits ``probes`` buckets of a table, its own and those it most likely missed by, and goes on
    in order of success until it met k others of the band or all. Where rows that beat its k-th score would then be met with
    a chance below GOAL, it visits more buckets of those bands. Rows and queries of a bucket travel in blocks, so a
    bucket with a third of all rows is many blocks, and only the k best of a block leave it.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    clean = keep(usable(vectors, zeros=False), "vectors")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    width, top = clean.agg(F.max(F.size("embedding")), F.max(square)).first()
    if width is None:
        return spark.createDataFrame([], RESULT)
    halvings = F.coalesce(F.log2(F.lit(float(top)) / F.col("square")) / 2, F.lit(float(BANDS)))
    band = F.least(F.floor(halvings * STEP), F.lit(BANDS - 1))
    tops = [r.top for r in clean.select(square.alias("square")).groupBy(band.alias("band")).agg(F.max("square").alias("top")).collect()]
    kind = "float32" if clean.schema["embedding"].dataType.simpleString() == "array<float>" else "float64"
    family = Hashes(width, tops, tables, hashes, slot)
    order = ["hash_table", "bucket", "vec_id"]
    lay = lambda frame: frame.repartitionByRange(*order).sortWithinPartitions(*order)
    index = keep(packed(lay(_bucketed(clean, family)), order[:2], width, kind, BLOCK_ROWS), "index")
    shared = spark.sparkContext.broadcast(_directory(index, family))

    def met(asking: DataFrame, on: bool) -> DataFrame:
        probed = keep(packed(lay(_probing(asking, family, shared, probes, k, on)), order[:2], width, kind, QUERY_ROWS), "probes")
        asked = probed.select("hash_table", "bucket", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
        pairs = asked.join(index.select("hash_table", "bucket", "ids", "data"), ["hash_table", "bucket"])
        small_batches(spark, 32)  # of two packed blocks each
        found = keep(pairs.select("q_ids", "q_data", "ids", "data").mapInArrow(_rerank(width, k, kind), FOUND), "found")
        small_batches(spark)
        return found

    def merged(found: DataFrame, ranked: bool) -> DataFrame:
        dealt = found.repartition("query_id").sortWithinPartitions("query_id")
        return dealt.mapInArrow(_merge(k, ranked), RESULT if ranked else f"{FOUND}, least double")

    asking = clean.where(queries)
    first = keep(merged(met(asking, False), False), "first")
    # A query with fewer than k rows has met them all.
    least = first.where("least IS NOT NULL").select(F.col("query_id").alias("vec_id"), "least")
    more = met(asking.join(least, "vec_id"), True)
    return merged(first.drop("least").unionByName(more), True)

"""Vectors as rows and as packed blocks, shared by the exact and the approximate search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import column


def usable(vectors: DataFrame, zeros: bool) -> DataFrame:
    """(vec_id, embedding, its float or double components as they are) of rows whose id and components are there and finite.

    Rows that repeat a vec_id count once (with the smaller vector, should they differ). Zero and empty vectors
    stay only if ``zeros``. Vectors of fewer components than others are filled up with zeros later.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    given = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), given.alias("embedding"))
    fine = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("vec_id IS NOT NULL").where(F.coalesce(fine, F.lit(False)))
    if not zeros:
        rows = rows.where(F.exists("embedding", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(lists: pa.Array, width: int, kind) -> np.ndarray:
    """The rows of a list column, filled up with zeros to one width."""
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width).astype(kind)
    out = np.zeros((len(lengths), width), kind)
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        out[i, :b - a] = flat[a:b]
    return out


def packed(sorted_rows: DataFrame, keys: list[str], width: int, kind: str, rows: int, measure: str | None = None) -> DataFrame:
    """Blocks of at most ``rows`` neighbours with equal keys: (*keys, block, n, lo, hi, ids, data).

    ``sorted_rows`` is dealt out and sorted by keys and ``measure``, whose least and greatest value a block keeps.
    A key with many rows is many blocks, wherever its range was cut.
    """
    types = {f.name: f.dataType.simpleString() for f in sorted_rows.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", block bigint, n int, lo double, hi double, ids binary, data binary"
    names = [*keys, "block", "n", "lo", "hi", "ids", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # key, ids, measures, vectors

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            key = held[0][0]
            ids = np.concatenate([h[1] for h in held])
            far = np.concatenate([h[2] for h in held])
            data = np.concatenate([h[3] for h in held])
            held, number = [], number + 1
            row = dict(zip(keys, key)) | {"block": number - 1, "n": len(ids), "lo": float(far.min()), "hi": float(far.max()),
                                          "ids": ids.astype(np.int64).tobytes(), "data": data.astype(kind).tobytes()}
            return pa.RecordBatch.from_arrays([pa.array([row[n]]).cast(TYPES.get(n, pa.int64())) if n in TYPES else pa.array([row[n]]) for n in names], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key_rows = list(zip(*[column(batch, k).to_pylist() for k in keys]))
            ids = column(batch, "vec_id").to_numpy()
            far = column(batch, measure).to_numpy() if measure else np.zeros(len(ids))
            data = matrix(column(batch, "embedding"), width, kind)
            at = 0
            while at < len(ids):
                if held and (held[0][0] != key_rows[at] or sum(len(h[1]) for h in held) >= rows):
                    yield flush()
                room = rows - sum(len(h[1]) for h in held)
                to = at + 1
                while to < len(ids) and to - at < room and key_rows[to] == key_rows[at]:
                    to += 1
                held.append((key_rows[at], ids[at:to], far[at:to], data[at:to]))
                at = to
        if held:
            yield flush()

    return sorted_rows.mapInArrow(run, schema)


TYPES = {"n": pa.int32(), "block": pa.int64(), "lo": pa.float64(), "hi": pa.float64(), "ids": pa.binary(), "data": pa.binary(), "pivot": pa.int32(), "hash_table": pa.int32(), "bucket": pa.int64()}


def unpack(ids: bytes, data: bytes, kind: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, np.int64)
    values = np.frombuffer(data, kind).reshape(len(found), width)
    return found, values.astype(np.float64) if values.dtype.kind == "f" else values


class TopK:
    """The best k (score, id) of each of some queries; ties go to the smaller id."""

    def __init__(self, n: int, k: int, score_kind):
        self.k = k
        self.scores = [np.zeros(0, score_kind) for _ in range(n)]
        self.ids = [np.zeros(0, np.int64) for _ in range(n)]

    def worst(self, query: int):
        """The k-th score so far, None if there are fewer."""
        return self.scores[query][-1] if len(self.scores[query]) == self.k else None

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        worst = self.worst(query)
        if worst is not None:
            better = scores >= worst
            scores, ids = scores[better], ids[better]
        if not len(ids):
            return
        scores, ids = np.concatenate([self.scores[query], scores]), np.concatenate([self.ids[query], ids])
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]


def ranked_rows(query_ids: np.ndarray, best: TopK, kind: pa.DataType) -> pa.RecordBatch:
    counts = [len(i) for i in best.ids]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(query_ids, counts), pa.int64()), pa.array(np.concatenate([np.arange(1, n + 1) for n in counts] or [[]]), pa.int32()),
         pa.array(np.concatenate([*best.ids, np.zeros(0, np.int64)]), pa.int64()), pa.array(np.concatenate([*best.scores, best.scores[0][:0]]), kind)],
        ["query_id", "rank", "vec_id", "score"])


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

"""Beginnings of phrases looked up in word lists, without a row for every run of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = 1 << 20  # places of the table of beginnings, however many there are
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _runs(hashes: np.ndarray, ends: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, first words, places) of all runs of n words within each list (hashes[ends[i]:ends[i + 1]]), n up to ``longest``."""
    values, total = hashes.view(np.uint64), np.zeros(len(hashes), np.uint64)
    left = np.repeat(ends[1:], np.diff(ends)) - np.arange(ends[0], ends[-1])
    at = np.arange(ends[0], ends[-1])
    for n in range(1, longest + 1):
        stays = left >= n
        at, left = at[stays], left[stays]
        total[at] = (total[at] ^ values[at + n - 1]) * _FACTOR
        yield n, at, ((total[at] >> np.uint64(24)) % np.uint64(PLACES)).astype(np.int64)


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(batch.schema.get_field_index(name))
    return lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)


def openings_met(texts: DataFrame, key: str, words: str, openings: DataFrame, longest: int) -> DataFrame:
    """(key, opening) of the given openings (a column of strings, up to ``longest`` words) that are in the word lists, and of a few others.

    Runs of words are told apart by a table of fixed size of the places of their hashes; only runs that
    fall on the place of an opening become strings.
    """
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ends = _lists(batch, "hashes")
            found = [p[np.isin(at, ends[:-1]) & np.isin(at + n, ends[1:])] for n, at, p in _runs(hashes, ends, longest)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], ["place"])

    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w)).alias("hashes")
    taken = openings.select(hashed(F.split("opening", " "))).mapInArrow(places, "place bigint").distinct().toArrow()["place"].to_numpy()
    table = np.zeros(PLACES, bool)
    table[taken] = True
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            hashes, ends = _lists(batch, "hashes")
            met = [(at[known[p]], n) for n, at, p in _runs(hashes, ends, longest)]
            at = np.concatenate([a for a, _ in met])
            size = np.repeat([n for _, n in met], [len(a) for a, _ in met])
            order = np.argsort(at, kind="stable")
            at, size = at[order], size[order]
            rows = np.searchsorted(ends, at, "right") - 1
            cuts = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)), pa.int32())
            firsts = pa.ListArray.from_arrays(cuts, pa.array(at - ends[rows] + 1, pa.int32()))
            sizes = pa.ListArray.from_arrays(cuts, pa.array(size, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), firsts, sizes], ["key", "words", "firsts", "sizes"])

    kind = dict(texts.dtypes)[key]
    listed = texts.select(F.col(key).alias("key"), F.col(words).alias("words"), hashed(F.col(words)))
    met = listed.where("words IS NOT NULL").mapInArrow(run, f"key {kind}, words array<string>, firsts array<int>, sizes array<int>")
    runs = F.array_distinct(F.zip_with("firsts", "sizes", lambda first, n: F.array_join(F.slice("words", first, n), " ")))
    return met.where("size(firsts) > 0").select(F.col("key").alias(key), F.explode(runs).alias("opening"))

"""Severity of toxic language by cumulative-link ordinal regression over hashed words."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import column, small_batches, unused

FEATURES = 1 << 20   # hashed words and beginnings of words
BEGINNINGS = (4, 5, 6, 7)
SAMPLE = 8_000       # most labelled texts that a model is fitted on
GRADES = 4           # 0: none, 1..3 by the number of telling words
RIDGES = (0.1, 1.0, 10.0)
COST = 4.0           # toxic texts that one lost text of another kind weighs, share against share, when the cut is chosen
GAP_RIDGE = 1e-3
LETTERS = re.compile(r"[^\W\d_]+")
CACHED = 250_000
RARE = 3             # texts of the sample that must hold a feature


class OrdinalModel(NamedTuple):
    """P(grade > k) = 1 / (1 + exp(threshold[k] - weights . x)); one weight vector, ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5  # expected severity from which a document is rejected

    def expected(self, margins: np.ndarray) -> np.ndarray:
        """Expected grade: the sum over k of P(grade > k)."""
        return (1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margins[:, None], -50, 50)))).sum(1)

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margins[:, None], -50, 50)))
        edges = np.hstack([np.ones((len(margins), 1)), above, np.zeros((len(margins), 1))])
        return edges[:, :-1] - edges[:, 1:]


def places_of(word: str) -> bytes:
    """The features of a word: itself, and its first letters, which the forms of one stem share."""
    parts = [word, *[f"{word[:n]}-" for n in BEGINNINGS if len(word) > n]]
    return array("i", [crc32(p.encode()) % FEATURES for p in parts]).tobytes()


class Hasher:
    """The distinct features of a text, with a bounded dictionary of words met before."""

    def __init__(self):
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = list(set(LETTERS.findall((text or "").lower())))
        places = list(map(self.known.get, words))
        if None in places:
            if len(self.known) > CACHED:
                self.known = {}
            for i, (word, place) in enumerate(zip(words, places)):
                if place is None:
                    places[i] = self.known[word] = places_of(word)
        return np.unique(np.frombuffer(b"".join(places), np.int32))


def labelled_sample(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled texts, by a hash of the id: (doc_id, toxic, features).

    The hash picks both labels in their own shares, so the model's base rate is the corpus's. Ids with both labels count as toxic.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = marks.orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers; of rows that repeat an id one text, so that there are no more texts than ids.
    texts = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Hasher()
        for batch in batches:
            found = [features(t) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "toxic").cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))],
                                             ["doc_id", "toxic", "features"])

    return texts.mapInArrow(run, "doc_id bigint, toxic int, features array<int>")


def telling_features(flat: np.ndarray, rows: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Features whose share of toxic texts is four times that of the others and lies six standard errors above it."""
    every = np.bincount(flat, minlength=FEATURES)
    one = np.bincount(flat[toxic[rows] == 1], minlength=FEATURES)
    n1, n0 = max(1, int((toxic == 1).sum())), max(1, int((toxic == 0).sum()))
    p1, p0, p = one / n1, (every - one) / n0, every / (n1 + n0)
    error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    return (p1 >= 4 * p0) & (p1 - p0 >= 6 * error)


def grades_of(flat: np.ndarray, rows: np.ndarray, toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Ordered grades from the two-valued labels.

    Not toxic: 0. Toxic texts rise from 1 with the number of distinct features that mark toxic texts: up to the
    first third of those that have any, the second, the rest.
    """
    telling = telling_features(flat, rows, toxic)
    count = np.bincount(rows, weights=telling[flat], minlength=len(toxic))
    grade = np.where(toxic == 1, 1, 0)
    held = count[(toxic == 1) & (count > 0)]
    if len(held):
        for cut in np.quantile(held, np.arange(1, grades - 1) / (grades - 1)):
            grade += (toxic == 1) & (count > cut)
    return grade


def _loss(values: np.ndarray, flat: np.ndarray, rows: np.ndarray, grade: np.ndarray, n_weights: int, ridge: float) -> tuple[float, np.ndarray]:
    """Negative log-likelihood with a ridge, and its slope; ``values``: weights, first threshold, logarithms of the gaps."""
    n, at = len(grade), np.arange(len(grade))
    weights, first, gaps = values[:n_weights], values[n_weights], np.exp(values[n_weights + 1:])
    thresholds = first + np.append(0, np.cumsum(gaps))
    margins = np.bincount(rows, weights=weights[flat], minlength=n)
    above = 1 / (1 + np.exp(np.clip(thresholds[None, :] - margins[:, None], -500, 500)))
    edges = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
    slope = np.hstack([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))])
    chance = np.maximum(edges[at, grade] - edges[at, grade + 1], 1e-300)
    pull = (slope[at, grade] - slope[at, grade + 1]) / chance
    of_weights = ridge * weights - np.bincount(flat, weights=pull[rows], minlength=n_weights)
    push = np.zeros(thresholds.size + 2)
    np.add.at(push, grade, slope[at, grade] / chance)
    np.add.at(push, grade + 1, -slope[at, grade + 1] / chance)
    tail = np.cumsum(push[1:-1][::-1])[::-1]
    # Gaps as well as weights are held back a little, so that a grade that is empty does not push a threshold away for ever.
    free = values[n_weights + 1:]
    loss = -np.log(chance).sum() + 0.5 * ridge * (weights @ weights) + 0.5 * GAP_RIDGE * (free @ free)
    return float(loss), np.concatenate([of_weights, [tail[0]], tail[1:] * gaps + GAP_RIDGE * free])


def minimise(function, values: np.ndarray, steps: int = 300, kept: int = 10, small: float = 1e-5) -> np.ndarray:
    """Limited-memory BFGS with a halving line search, until the slope is ``small`` beside that of the start."""
    loss, slope = function(values)
    goal, pairs = small * max(1.0, float(np.abs(slope).max())), []
    for _ in range(steps):
        if np.abs(slope).max() <= goal:
            break
        move, scales = slope.copy(), []
        for s, y, r in reversed(pairs):
            scales.append(r * (s @ move))
            move -= scales[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            move *= (s @ y) / (y @ y)
        else:
            move /= max(1.0, float(np.abs(slope).sum()))
        for (s, y, r), scale in zip(pairs, reversed(scales)):
            move += s * (scale - r * (y @ move))
        falls, length = float(slope @ move), 1.0
        while True:
            there = values - length * move
            lower, at = function(there)
            if lower <= loss - 1e-4 * length * falls or length < 1e-10:
                break
            length /= 2
        if length < 1e-10:
            break
        s, y = there - values, at - slope
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y, 1 / (s @ y))][-kept:]
        values, loss, slope = there, lower, at
    return values


def fit(flat: np.ndarray, rows: np.ndarray, grade: np.ndarray, n_grades: int = GRADES, ridge: float = 1.0) -> OrdinalModel:
    """Maximum likelihood with a ridge over the features that tell toxic texts from others; all other weights are 0."""
    n = len(grade)
    telling = telling_features(flat, rows, (grade > 0).astype(int)) & (np.bincount(flat, minlength=FEATURES) >= RARE)
    used = np.flatnonzero(telling)
    rows, compact = rows[telling[flat]], (np.cumsum(telling) - 1)[flat[telling[flat]]]
    share = np.array([(grade > k).mean() for k in range(n_grades - 1)])
    share = np.clip(share, 0.5 / max(n, 1), 1 - 0.5 / max(n, 1))
    start = np.log((1 - share) / share)
    begin = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    values = minimise(lambda v: _loss(v, compact, rows, grade, len(used), ridge), begin)
    full = np.zeros(FEATURES)
    full[used] = values[:len(used)]
    return OrdinalModel(full, values[len(used)] + np.append(0, np.cumsum(np.exp(values[len(used) + 1:]))))


def choose_cut(severity: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(gain, cut): the cut between neighbouring severities with the greatest share of toxic texts caught less ``COST`` times that of others lost.

    Of equally good cuts the middle one of the widest run; without texts of both kinds, the middle of the scale's first grade.
    """
    if toxic.all() or not toxic.any():
        return 0.0, 0.5
    marks, place = np.unique(severity, return_inverse=True)
    one, none = np.bincount(place, weights=toxic == 1), np.bincount(place, weights=toxic == 0)
    # Cut i lies between marks i - 1 and i.
    gain = np.append(one[::-1].cumsum()[::-1], 0)[1:] / one.sum() - COST * np.append(none[::-1].cumsum()[::-1], 0)[1:] / none.sum()
    best = np.flatnonzero(gain[:-1] >= gain[:-1].max() - 1e-12) if len(marks) > 1 else np.zeros(0, int)
    if not len(best):
        return 0.0, 0.5
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    run = max(runs, key=lambda r: marks[r[-1] + 1] - marks[r[0]])
    return float(gain[run[0]]), float((marks[run[0]] + marks[run[-1] + 1]) / 2)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on the bounded sample: the ridge and the cut are those that do best on a quarter of it which the fit does not see.

    Without labelled texts every document has expected severity 0.
    """
    found = labelled_sample(documents, labels, sample).toArrow().sort_by("doc_id").combine_chunks()
    if not found.num_rows:
        return OrdinalModel(np.zeros(FEATURES), np.full(GRADES - 1, 50.0))
    lists = found["features"].combine_chunks() if isinstance(found["features"], pa.ChunkedArray) else found["features"]
    flat = lists.flatten().to_numpy()
    rows = np.repeat(np.arange(found.num_rows, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    toxic = found["toxic"].to_numpy()
    held = np.array([crc32(b"held %d" % i) % 4 == 0 for i in found["doc_id"].to_pylist()])
    seen, number = held[rows], np.cumsum(~held) - 1
    some_flat, some_rows, some_toxic = flat[~seen], number[rows[~seen]], toxic[~held]
    trials = []
    if held.any() and not held.all():
        grade = grades_of(some_flat, some_rows, some_toxic)
        for ridge in RIDGES:
            model = fit(some_flat, some_rows, grade, ridge=ridge)
            margins = np.bincount(rows, weights=model.weights[flat], minlength=len(toxic))[held]
            trials.append((*choose_cut(model.expected(margins), toxic[held]), ridge))
    _, cut, ridge = max(trials, key=lambda t: t[0], default=(0.0, 0.5, 1.0))
    return fit(flat, rows, grades_of(flat, rows, toxic), ridge=ridge)._replace(cut=cut)


def score(documents: DataFrame, model: OrdinalModel, cut: float | None = None, passing: list[str] | None = None) -> DataFrame:
    """Adds severity (expected grade), grade (most likely) and rejected to every row; ``passing``: the columns to pass on (all).

    Whole texts are read. NULL and empty texts have no features, so the base rate speaks for them. Columns of the
    three names are replaced; all others, and repeated rows, stay as they are. An empty table gives no rows. The model is 8 MB
    whatever the input's size. ``cut``: the severity from which a document is rejected, in place of the model's own.
    """
    cut = model.cut if cut is None else cut
    text = unused("text", documents)
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    added = ("severity", "grade", "rejected")
    kept = [c for c in (passing or documents.columns) if c not in added]
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept)
    schema += ", severity double, grade int, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value
        fitted = OrdinalModel(weights, thresholds)
        features = Hasher()
        for batch in batches:
            margins = np.array([weights[features(t)].sum(dtype=np.float64) for t in column(batch, text).to_pylist()])
            severity = fitted.expected(margins)
            grade = fitted.probabilities(margins).argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*[column(batch, c) for c in kept], pa.array(severity), pa.array(grade), pa.array(severity >= cut)], [*kept, *added])

    return documents.select(*kept, F.col("text").alias(text)).mapInArrow(run, schema)


def severity_of(documents: DataFrame, labels: DataFrame, cut: float | None = None, passing: list[str] | None = None) -> DataFrame:
    return score(documents, train(documents, labels), cut, passing)

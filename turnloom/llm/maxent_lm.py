"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import column, keep, small_batches

END = b""            # no word is empty
LISTED = 200_000     # most frequent words that every task knows
MODELLED = 512       # of them, words with weights of their own within their class
FREQUENT, ENDINGS = 16, 16
CLASSES = FREQUENT + 2 * ENDINGS  # by frequency; by ending: listed words, other words
ROWS, PAIRS, WORD_ROWS = 4096, 8192, 1024
BLOCK = 256          # weight rows that travel together
FLUSH = 150_000      # words that a task counts before it passes them on
BATCH = 16_384       # tokens of a gradient step
ROUNDS, RATE = 2, 0.15
SPLIT = 7


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7 (NULL: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % SPLIT


def tokens_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, then the end."""
    return [*(text or "").encode().lower().split(), END]


def count_words(documents: DataFrame) -> DataFrame:
    """(token, n) over all texts; tasks pass on partial counts, so their dictionaries stay small."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in column(batch, "text"):
                seen.update(tokens_of(text.as_py()))
                if len(seen) > FLUSH:
                    yield flush()
        if seen:
            yield flush()

    return documents.select("text").mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def ending_class(token: bytes) -> int:
    return crc32(token[-3:]) % ENDINGS


class Vocabulary(NamedTuple):
    words: list[bytes]        # listed words, most frequent first
    counts: np.ndarray
    classes: np.ndarray       # class of each
    starts: np.ndarray        # of each frequent class, its first word; and the end
    within: np.ndarray        # log10 of a listed word's share of its class, for those without weights
    tail_weight: np.ndarray   # of each ending, the sum of (count + 1) of words that are not listed, and 1 for unknown ones
    total: int
    distinct: int

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.distinct + 1))

    def class_weight(self) -> np.ndarray:
        listed = np.bincount(self.classes, weights=self.counts + 1, minlength=CLASSES)
        listed[FREQUENT + ENDINGS:] = self.tail_weight
        return np.maximum(listed, 1e-9)


def vocabulary(counts: DataFrame, listed: int = LISTED) -> Vocabulary:
    """What every task knows: at most ``listed`` words, and sums over all others.

    The least count of a listed word is found from a histogram of fixed size, so no rank is computed over all words.
    """
    level = F.floor(F.log2("n") * 64)
    bins = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("level")).collect()
    total, distinct = sum(b.n for b in bins), sum(b.words for b in bins)
    least, held = math.inf, 0
    for b in bins:
        if held + b.words > listed:
            break
        held, least = held + b.words, b.level
    top = counts.where(level >= F.lit(float(least))).toArrow() if held else pa.table({"token": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    ranked = sorted(zip(top["token"].to_pylist(), top["n"].to_pylist()), key=lambda x: (-x[1], x[0]))
    words, n = [w for w, _ in ranked], np.array([c for _, c in ranked], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(ENDINGS, np.int64)
        for batch in batches:
            ends = np.fromiter((ending_class(t) for t in column(batch, "token").to_pylist()), np.int64, batch.num_rows)
            np.add.at(sums, ends, column(batch, "n").to_numpy() + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ENDINGS)), pa.array(sums)], ["ending", "weight"])

    rest = counts.where(level < F.lit(float(least))) if held else counts
    sums = rest.mapInArrow(run, "ending bigint, weight bigint").groupBy("ending").agg(F.sum("weight").alias("weight")).collect()
    tail = np.ones(ENDINGS)
    for row in sums:
        tail[row.ending] += row.weight
    classes = np.array([FREQUENT + ending_class(w) for w in words], np.int64)
    modelled = min(MODELLED, len(words))
    mass = np.cumsum(n[:modelled]) - n[:modelled] / 2
    classes[:modelled] = np.minimum(mass * FREQUENT / max(1, n[:modelled].sum()), FREQUENT - 1).astype(np.int64)
    starts = np.searchsorted(classes[:modelled], np.arange(FREQUENT + 1))
    weight = np.bincount(classes, weights=n + 1, minlength=CLASSES)
    return Vocabulary(words, n, classes, starts, np.log10((n + 1) / weight[classes]), tail, int(total), int(distinct))


def number(documents: DataFrame, known: Vocabulary, rounds: int) -> DataFrame:
    """(row, doc_id, held_out, slice, ids, unlisted) of every text: ids are ranks of listed words, else -1 - ending.

    Written once, so that learning and scoring read numbers in place of texts.
    """
    shared = documents.sparkSession.sparkContext.broadcast(known.words)
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, rank = TaskContext.get().partitionId() << 36, {w: i for i, w in enumerate(shared.value)}
        for batch in batches:
            cut = [tokens_of(t) for t in column(batch, "text").to_pylist()]
            ends = np.cumsum([0, *map(len, cut)])
            flat = [t for tokens in cut for t in tokens]
            ids = np.fromiter(map(rank.get, flat, repeat(-1)), np.int32, len(flat))
            other = np.flatnonzero(ids < 0)
            unlisted = [flat[i] for i in other.tolist()]
            endings = np.fromiter(map(ending_class, unlisted), np.int32, len(unlisted))
            ids[other] = -1 - endings
            parts = pa.StructArray.from_arrays([pa.array(unlisted, pa.binary()), pa.array(endings)], ["token", "ending"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(cut))), *[column(batch, c) for c in ("doc_id", "held_out", "slice")],
                 pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                 pa.ListArray.from_arrays(pa.array(np.searchsorted(other, ends).astype(np.int32)), parts)],
                ["row", "doc_id", "held_out", "slice", "ids", "unlisted"])
            row += len(cut)

    rows = documents.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), F.floor(crc / SPLIT % rounds).cast("int").alias("slice"), "text")
    return keep(rows.mapInArrow(
        run, "row bigint, doc_id bigint, held_out boolean, slice int, ids array<int>, unlisted array<struct<token: binary, ending: int>>"), "numbered")


class Weights:
    """One row of CLASSES for each context feature (previous word, word before it, hashed pair), and for each
    of the two words rows of MODELLED weights that choose within the frequent classes."""

    def __init__(self):
        self.by_class = np.zeros((2 * ROWS + PAIRS, CLASSES), np.float32)
        self.by_word = np.zeros((2 * WORD_ROWS, MODELLED), np.float32)

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        n = len(self.by_class) // BLOCK
        for i in range(n):
            yield i, self.by_class[i * BLOCK:(i + 1) * BLOCK]
        for i in range(len(self.by_word) // BLOCK):
            yield n + i, self.by_word[i * BLOCK:(i + 1) * BLOCK]


class Model:
    def __init__(self, known: Vocabulary, weights: Weights):
        self.known, self.weights = known, weights
        self.class_bias = np.log(known.class_weight() / known.class_weight().sum()).astype(np.float32)
        self.word_bias = np.log(known.counts[:MODELLED] + 1.0).astype(np.float32)
        self.base = known.base(known.counts)
        # The columns of each frequent class by themselves, side by side in memory.
        self.tables = [np.ascontiguousarray(weights.by_word[:, a:b]) for a, b in zip(known.starts, known.starts[1:])]

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranks (-1: not listed), classes and lengths of some numbered texts, end to end."""
        lists = column(batch, "ids")
        ends = lists.offsets.to_numpy().astype(np.int64)
        ids = lists.values.to_numpy()[ends[0]:ends[-1]].astype(np.int64)
        other = ids < 0
        classes = self.known.classes[ids] if len(self.known.classes) else np.zeros(len(ids), np.int64)
        classes[other] = FREQUENT + ENDINGS - 1 - ids[other]
        ids[other] = -1
        return ids, classes, np.diff(ends)

    def contexts(self, ranks: np.ndarray, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the class weights (three) and of the word weights (two) that the words before each token switch on."""
        starts = np.cumsum(lengths) - lengths
        out = []
        for rows in (ROWS, WORD_ROWS):
            own = rows - CLASSES - 1
            name = np.where((ranks >= 0) & (ranks < own), ranks, own + classes)
            one, two = np.empty_like(name), np.empty_like(name)
            one[1:], two[2:] = name[:-1], name[:-2]
            one[starts] = two[starts] = rows - 1
            after = starts[lengths > 1] + 1
            two[after] = rows - 1
            out.append((one, two))
        (one, two), (word_one, word_two) = out
        pair = ((one * ROWS + two) * np.int64(0x9E3779B97F4A7C1) >> np.int64(20)) % PAIRS
        return np.stack([one, ROWS + two, 2 * ROWS + pair]), np.stack([word_one, WORD_ROWS + word_two])

    @staticmethod
    def softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp(logits), in place of them where that is safe, and its sum by row."""
        if logits.size and logits.max() > 60:
            logits -= logits.max(1, keepdims=True)
        chances = np.exp(logits)
        return chances, chances.sum(1)

    def class_logits(self, rows: np.ndarray) -> np.ndarray:
        logits = np.take(self.weights.by_class, rows[0], axis=0)
        logits += np.take(self.weights.by_class, rows[1], axis=0)
        logits += np.take(self.weights.by_class, rows[2], axis=0)
        logits += self.class_bias
        return logits

    def word_logits(self, rows: np.ndarray, k: int) -> np.ndarray:
        """Of the words of a frequent class."""
        logits = np.take(self.tables[k], rows[0], axis=0)
        logits += np.take(self.tables[k], rows[1], axis=0)
        logits += self.word_bias[self.known.starts[k]:self.known.starts[k + 1]]
        return logits

    def frequent(self, classes: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        """(tokens, class, its first word) of each frequent class of two words or more."""
        order = np.argsort(classes.astype(np.uint8), kind="stable")
        ends = np.searchsorted(classes[order], np.arange(FREQUENT + 1))
        for k in range(FREQUENT):
            first, last = int(self.known.starts[k]), int(self.known.starts[k + 1])
            if last - first > 1 and ends[k + 1] > ends[k]:
                yield order[ends[k]:ends[k + 1]], k, first

    def score(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, listed tokens, base and model log10 probability without the unlisted tokens' share of their class."""
        ranks, classes, lengths = self.read(batch)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        logs = np.zeros(len(ranks))
        rows, word_rows = self.contexts(ranks, classes, lengths)
        for at in range(0, len(ranks), BATCH):
            part = slice(at, at + BATCH)
            target, logits = classes[part], self.class_logits(rows[:, part])
            _, total = self.softmax(logits)
            logs[part] = (logits[np.arange(len(target)), target] - np.log(total)) / math.log(10)
            for some, k, first in self.frequent(target):
                logits = self.word_logits(np.take(word_rows[:, part], some, axis=1), k)
                _, total = self.softmax(logits)
                logs[at + some] += (logits[np.arange(len(some)), ranks[part][some] - first] - np.log(total)) / math.log(10)
        listed = ranks >= 0
        plain = listed & (classes >= FREQUENT)
        logs[plain] += self.known.within[ranks[plain]]
        total = lambda values: np.bincount(owner, weights=values, minlength=len(lengths))
        base = np.where(listed, self.base[ranks] if len(self.base) else 0.0, 0.0)
        return lengths, total(listed).astype(np.int64), total(base), total(logs)

    def learn(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, bytes]]:
        """Gradient steps over the texts; gives (block, width, uses of each row, change) of the blocks of rows that changed."""
        begun = [b.copy() for _, b in self.weights.blocks()]
        uses = [np.zeros(len(self.weights.by_class), np.int64), np.zeros(len(self.weights.by_word), np.int64)]
        squares = [np.full_like(t, 1e-3) for t in (self.weights.by_class, *self.tables)]

        places = np.zeros(max(len(self.weights.by_class), len(self.weights.by_word)), np.int64)

        def step(which: int, table: np.ndarray, square: np.ndarray, rows: np.ndarray, slope: np.ndarray) -> None:
            """One step for rows of one feature each; every feature of a token has the token's slope."""
            n, width = np.bincount(rows.ravel(), minlength=len(table)), slope.shape[1]
            named = np.flatnonzero(n)
            places[named] = np.arange(len(named)) * width
            sums = np.zeros(len(named) * width, np.float32)
            across = np.arange(width)
            for feature in rows:
                np.add.at(sums, (places[feature][:, None] + across).ravel(), slope.ravel())
            sums = sums.reshape(-1, width) / np.float32(BATCH / 64)
            uses[which][named] += n[named]
            new = np.take(square, named, axis=0)
            new += sums * sums
            square[named] = new
            sums *= np.float32(RATE)
            sums /= np.sqrt(new)
            table[named] -= sums

        for batch in batches:
            if not batch.num_rows:
                continue
            ranks, classes, lengths = self.read(batch)
            rows, word_rows = self.contexts(ranks, classes, lengths)
            for at in range(0, len(ranks), BATCH):
                part = slice(at, at + BATCH)
                target, here = classes[part], rows[:, part]
                slope, total = self.softmax(self.class_logits(here))
                slope /= total[:, None]
                slope[np.arange(len(slope)), target] -= 1
                step(0, self.weights.by_class, squares[0], here, slope)
                for some, k, first in self.frequent(target):
                    used = np.take(word_rows[:, part], some, axis=1)
                    slope, total = self.softmax(self.word_logits(used, k))
                    slope /= total[:, None]
                    slope[np.arange(len(some)), ranks[part][some] - first] -= 1
                    step(1, self.tables[k], squares[k + 1], used, slope)
        for k, table in enumerate(self.tables):
            self.weights.by_word[:, self.known.starts[k]:self.known.starts[k + 1]] = table
        used = np.concatenate(uses)
        for (block, now), before in zip(self.weights.blocks(), begun):
            n = used[block * BLOCK:(block + 1) * BLOCK]
            if n.any():
                yield block, now.shape[1], n.tobytes(), (now - before).astype(np.float16).tobytes()


def _sum_changes(changes: DataFrame) -> DataFrame:
    """The mean change of each row, weighed by its uses: blocks are streamed, never gathered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = total = uses = None

        def done() -> pa.RecordBatch:
            mean = (total / np.maximum(uses, 1)[:, None]).astype(np.float32)
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([mean.tobytes()], pa.binary())], ["block", "mean"])

        for batch in batches:
            for block, width, n, change in zip(*[column(batch, c).to_pylist() for c in ("block", "width", "uses", "change")]):
                if block != current:
                    if total is not None:
                        yield done()
                    current, total, uses = block, np.zeros((BLOCK, width)), np.zeros(BLOCK)
                n = np.frombuffer(n, np.int64)
                total += np.frombuffer(change, np.float16).reshape(BLOCK, width).astype(np.float64) * n[:, None]
                uses += n
        if total is not None:
            yield done()

    return changes.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block bigint, mean binary")


def train(numbered: DataFrame, known: Vocabulary, rounds: int = ROUNDS) -> Weights:
    """Each round every task takes gradient steps over its share of a slice of the texts, from the same weights, and
    the changes of all tasks are averaged row by row; the slices together are all texts. The weights are 7 MB whatever the input."""
    spark, weights = numbered.sparkSession, Weights()
    learned = numbered.where("NOT held_out")
    for number in range(rounds):
        shared = spark.sparkContext.broadcast((known, weights))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Weights()
            own.by_class[:], own.by_word[:] = shared.value[1].by_class, shared.value[1].by_word
            model = Model(shared.value[0], own)
            found = model.learn(batches)
            for row in found:
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                                                 ["block", "width", "uses", "change"])

        changes = learned.where(F.col("slice") == number).select("ids").mapInArrow(run, "block bigint, width int, uses binary, change binary")
        mean = {r.block: r["mean"] for r in _sum_changes(changes).collect()}
        for block, rows in weights.blocks():
            if block in mean:
                rows += np.frombuffer(mean[block], np.float32).reshape(rows.shape)
    return weights


def score(numbered: DataFrame, counts: DataFrame, known: Vocabulary, weights: Weights) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    shared = numbered.sparkSession.sparkContext.broadcast((known, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [*[column(batch, c) for c in ("row", "doc_id", "held_out")], *map(pa.array, model.score(batch))],
                    ["row", "doc_id", "held_out", "n_tokens", "listed", "base", "logs"])

    rows = numbered.select("row", "doc_id", "held_out", "ids").mapInArrow(
        run, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, listed bigint, base double, logs double")
    rest = numbered.select("row", F.explode("unlisted").alias("u")).select("row", "u.token", "u.ending")
    least = int(known.counts.min()) if len(known.counts) else None
    rare = counts if least is None else counts.where(F.col("n") < least)
    met = rest.join(rare, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in known.tail_weight]), F.col("ending") + 1)
    added = met.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("found"), F.sum(F.log10(F.col("n") + 1)).alias("logged"),
        F.count("*").alias("words"), F.sum(F.log10(weight)).alias("weights"))
    joined = rows.join(added, "row", "left").na.fill(0, ["found", "logged", "words", "weights"])
    smooth = math.log10(known.total + known.distinct + 1)
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("listed") + F.col("found")).alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logged") - F.col("words") * smooth).alias("base_score"),
        (F.col("logs") + F.col("logged") - F.col("weights")).alias("score"))


def score_texts(documents: DataFrame) -> DataFrame:
    """Learn from the rows whose id's crc32 modulo 7 is not 2, and score every row.

    NULL and empty texts are the end alone; a NULL id hashes as the empty text; rows that repeat an id are texts of their own. With no
    text to learn from, the model knows unknown words only. An empty table gives an empty result.

    A token's probability is that of its class after the two words before it, times its own within the class: by weights after the same
    words for the MODELLED most frequent, by (count + 1) for the others, and 1 for all unknown words of an ending. The probabilities
    of all words and the unknown ones of each ending add up to 1. Words beyond the LISTED ones meet their counts in a join.
    """
    small_batches(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learned = texts.where(fold(F.col("doc_id")) != 2)
    counts = keep(count_words(learned), "counts")
    known = vocabulary(counts)
    numbered = number(texts, known, ROUNDS)
    return score(numbered, counts, known, train(numbered, known))

"""Near-duplicates by DartMinHash signatures, banded joining and an exact check."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import column, keep, small_batches
from turnloom.llm.components import components
from turnloom.llm.url_filter import LANES, _block_and_bits, bloom_blocks

SHINGLE, SIMILAR = 5, 0.8
BANDS, BAND_ROWS = 36, 6
COORDINATES = BANDS * BAND_ROWS
CHUNK = 1_000  # rows of a bucket that are compared with as many at a time
CACHED = 400_000
GOLD = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Words of a text in lower case, and the hashes of its shingles of five words (all its words, if fewer)."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def words(self, text: str | None) -> list[str]:
        return (text or "").lower().split()

    def shingles(self, words: list[str]) -> np.ndarray:
        hashes = list(map(self.known.get, words))
        if None in hashes:
            if len(self.known) > CACHED:
                self.known = {}
            for i, (word, found) in enumerate(zip(words, hashes)):
                if found is None:
                    hashes[i] = self.known[word] = xxhash.xxh3_64_intdigest(word)
        h = np.array(hashes, np.uint64)
        width = min(SHINGLE, len(h))
        if not width:
            return h
        n, total = len(h) - width + 1, np.full(1, width, np.uint64)
        for i in range(width):
            total = total + h[i:i + n] * FACTORS[i]
        return mix(total)


def columns_of(shingles: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A name for each unit of weight: the first, second ... occurrence of a shingle in its text; with the texts.

    The weight of a shingle is its number of occurrences, so two texts share as many names as the lesser weights add up to,
    and the weighted Jaccard similarity of texts is the plain one of their names.
    """
    order = np.lexsort((shingles, texts))
    shingles, texts = shingles[order], texts[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (texts[1:] != texts[:-1])
    starts = np.flatnonzero(new)
    copy = np.arange(len(shingles)) - np.repeat(starts, np.diff(np.append(starts, len(shingles))))
    return mix(shingles + copy.astype(np.uint64) * GOLD), texts


def signatures(names: np.ndarray, texts: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """(n, k) names of the earliest dart of each coordinate.

    Darts fall on each unit of weight at the times of a Poisson process of its name, each on a hashed
    coordinate. A text of weight w throws those before time (k ln k + 2k) / w, some k ln k + 2k in all whatever its
    size, and twice the time if a coordinate stayed empty, until none is.
    """
    out = np.zeros((n, k), np.uint32)
    weight = np.bincount(texts, minlength=n)
    horizon = (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        part = todo[texts]
        name, text, time = names[part], texts[part], np.zeros(part.sum())
        first = np.full(n * k, np.inf)
        throws, number = [], 0
        while len(name):
            number += 1
            dart = mix(name + np.uint64(number * int(GOLD) & (1 << 64) - 1))
            time = time - np.log1p(-((dart >> np.uint64(11)).astype(np.float64) * 2.0 ** -53))
            before = time < horizon[text]
            name, text, time, dart = name[before], text[before], time[before], dart[before]
            lands = mix(dart ^ GOLD)
            place = text * k + ((lands >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(first, place, time)
            throws.append((place, time, lands.astype(np.uint32)))
        for place, time, lands in throws:
            wins = time == first[place]
            out.reshape(-1)[place[wins]] = lands[wins]
        empty = np.isinf(first.reshape(n, k)).any(1) & todo
        horizon[empty] *= 2
        todo = empty
    return out


def sign(documents: DataFrame) -> DataFrame:
    """(doc_id, raw: hash of the text as it is, node: digest of its words, NULL if it has none, signature) of every row."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            nodes, found, sizes = [], [], []
            for text in column(batch, "text").to_pylist():
                words = shingler.words(text)
                nodes.append(hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest() if words else None)
                found.append(shingler.shingles(words))
                sizes.append(len(found[-1]))
            if not nodes:
                continue
            texts = np.repeat(np.arange(len(nodes)), sizes)
            signed = signatures(*columns_of(np.concatenate(found), texts), len(nodes))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "raw"), pa.array(nodes, pa.binary()),
                 pa.array([None if node is None else row.tobytes() for node, row in zip(nodes, signed)], pa.binary())],
                ["doc_id", "raw", "node", "signature"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("raw"), "text")
    return rows.mapInArrow(run, "doc_id bigint, raw bigint, node binary, signature binary")


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, names, short) of (node, text): the sorted names of all units of weight, and their upper halves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sets, short = [], []
            for text in column(batch, "text").to_pylist():
                found = shingler.shingles(shingler.words(text))
                names = np.sort(columns_of(found, np.zeros(len(found), np.int64))[0])
                sets.append(names.tobytes())
                short.append((names >> np.uint64(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array(sets, pa.binary()), pa.array(short, pa.binary())], ["node", "names", "short"])
    return texts.mapInArrow(run, "node binary, names binary, short binary")


def _exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts have weighted Jaccard similarity SIMILAR or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(column(batch, "left").to_pylist(), column(batch, "right").to_pylist()):
                left, right = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                if min(len(left), len(right)) < SIMILAR * max(len(left), len(right)):
                    good.append(False)
                    continue
                at = np.searchsorted(right, left)
                both = int((right[np.minimum(at, len(right) - 1)] == left).sum())
                good.append(both >= SIMILAR * (len(left) + len(right) - both) - 1e-9)
            keep_rows = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "a").filter(keep_rows), column(batch, "b").filter(keep_rows)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("names").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("names").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a binary, b binary")


class _Postings:
    """Which rows hold a name, to count what a text shares with all of them at once."""

    def __init__(self, sets: list[np.ndarray]):
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint32)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(values, kind="stable")
        self.values, self.owner, self.n = values[order], owner[order], len(sets)

    def shared(self, names: np.ndarray) -> np.ndarray:
        first = np.searchsorted(self.values, names, "left")
        counts = np.searchsorted(self.values, names, "right") - first
        at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return np.bincount(self.owner[at], minlength=self.n)


def _links_between(one: list[tuple], two: list[tuple], same: bool) -> list[tuple[bytes, bytes]]:
    """Links (node, node) that join rows (node, root, short names) of different roots: for each join one, not all there are."""
    sets = [np.frombuffer(r[2], np.uint32) for r in two]
    sizes = np.array([len(x) for x in sets])
    roots = {root: i for i, root in enumerate({r[1] for r in one} | {r[1] for r in two})}
    parent = list(range(len(roots)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    of_two = np.array([roots[r[1]] for r in two])
    most = int(np.bincount(of_two).argmax())
    few = np.flatnonzero(of_two != most)
    full, rest = _Postings(sets), _Postings([sets[i] for i in few])
    links = []
    for node, root, short in one:
        root, names = roots[root], np.frombuffer(short, np.uint32)
        if root == most and (same or not len(few)):
            continue  # its pairs with other roots are met from their side
        rows, postings = (few, rest) if root == most else (np.arange(len(two)), full)
        both = postings.shared(names)
        like = both / (len(names) + sizes[rows] - both)
        near = np.flatnonzero((like >= SIMILAR - 1e-9) & (of_two[rows] != root))
        for i in near[np.argsort(-like[near], kind="stable")]:
            a, b = find(root), find(int(of_two[rows[i]]))
            if a != b:
                parent[a] = b
                other = two[rows[i]][0]
                links.append((min(node, other), max(node, other)))
    return links


def _links_in_buckets(members: DataFrame) -> DataFrame:
    """Links between different components that share a bucket, some of each join.

    ``members``: (key, i, j, side, node, root, short), sorted: side 0 rows against side 1 rows, or
    among themselves where i = j. Halves of names may agree by chance, so a link wants an exact check; none is missed.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, ([], [])

        def done() -> pa.RecordBatch:
            same = current[1] == current[2]
            two = rows[0] if same else rows[1]
            links = _links_between(rows[0], two, same) if rows[0] and two else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.binary()), pa.array([x[1] for x in links], pa.binary())], ["a", "b"])

        for batch in batches:
            for key, i, j, side, node, root, short in zip(*[column(batch, c).to_pylist() for c in ("key", "i", "j", "side", "node", "root", "short")]):
                if (key, i, j) != current:
                    if current is not None:
                        yield done()
                    current, rows = (key, i, j), ([], [])
                rows[side].append((node, root, short))
        if current is not None:
            yield done()

    return members.mapInArrow(run, "a binary, b binary")


def _candidate_sets(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, names) for (node, raw): the texts are fetched by their hash, through a filter of fixed size."""
    wanted = keep(nodes.select("node", F.col("raw").alias("_raw")), "wanted")
    block, lanes = _block_and_bits(F.col("_text_raw"), 1 << 15)
    hit = F.lit(True)
    for i, lane in enumerate(lanes):
        hit &= F.col(f"_w{i}").bitwiseAND(lane) == lane
    texts = documents.select("text", F.xxhash64("text").alias("_text_raw")).withColumn("_block", block)
    # At most 2^15 rows of 72 bytes, whatever the number of candidates.
    texts = texts.join(F.broadcast(bloom_blocks(wanted, "_raw", 1 << 15)), "_block").where(hit).select("_text_raw", "text")
    texts = texts.join(wanted, F.col("_text_raw") == F.col("_raw")).groupBy("node").agg(F.first("text").alias("text"))
    return keep(_shingle_sets(texts), "sets")


def _links(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of every text that is near another; ``texts``: distinct (node, raw, signature)."""
    width = BAND_ROWS * 4
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                        lambda b: F.xxhash64(F.substring(F.col("signature"), b * width + 1, F.lit(width)), b))
    banded = texts.select("node", F.explode(bands).alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1")
    members = keep(banded.join(shared, "key"), "buckets")
    # First each text with the least text it shares a bucket with: most copies are settled by that.
    first = members.where("node <> leader").groupBy("node").agg(F.min("leader").alias("leader"))
    pairs = keep(first.select(F.col("leader").alias("a"), F.col("node").alias("b")), "pairs")
    asked = members.select("node").distinct()
    sets = _candidate_sets(documents, texts.select("node", "raw").join(asked, "node"))
    edges = keep(_exact(pairs, sets), "links")
    roots = keep(components(edges), "roots")
    # Then what is left in different components of a bucket is compared in full, and one link of each join leaves the block.
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least <> _most").select("key")
    open_rows = rooted.join(mixed, "key").join(sets.select("node", "short"), "node")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64("node"), chunks.cast("long")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), chunks - 1),
                        lambda c: F.struct(F.least(c, F.col("chunk")).alias("i"), F.greatest(c, F.col("chunk")).alias("j"),
                                           F.when(c >= F.col("chunk"), 0).otherwise(1).alias("side")))
    dealt = open_rows.withColumn("chunk", chunk).select("key", "node", "root", "short", F.explode(meets).alias("m"))
    dealt = dealt.select("key", "m.i", "m.j", "m.side", "node", "root", "short")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node")
    more = _links_in_buckets(dealt).distinct()
    found = keep(_exact(keep(more, "pairs"), sets), "links")
    return keep(components(edges.unionAll(found)), "roots")


def classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_rows) of every row: class_id is the least doc_id of its class, n_rows the class's rows.

    Two texts are linked if their shingles of five words (lower case, white space apart; a text of fewer words is one shingle), weighed by
    their number, have Jaccard similarity 0.8 or more; a class is what links connect. Texts of equal words are one node from the start,
    so copies are never paired. A text without words (NULL, empty, blank) is a class of its own. Rows that repeat a
    doc_id are rows of their own; NULL ids count only where a class has no other. An empty table gives an empty result.

    Bands of 6 of 216 coordinates find a pair of similarity 0.8 but for 2 in 100,000. A bucket is never expanded to all
    pairs: each text is checked against one leader, and only texts left in different components are compared, in blocks that
    pass on one link of each join.
    """
    return _classified(documents).select("doc_id", "class_id", "n_rows")


def _classified(documents: DataFrame) -> DataFrame:
    """The rows of ``classes`` with raw, and raw of the class's first row (least id, then least raw) as class_raw."""
    rows = keep(sign(documents.select("doc_id", "text")), "signed")
    worded = rows.where("node IS NOT NULL")
    texts = keep(worded.groupBy("node").agg(F.first("signature").alias("signature"), F.min("raw").alias("raw")), "texts")
    roots = _links(documents.select("text"), texts)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw")
    per_node = worded.groupBy("node").agg(F.min(first).alias("least"), F.count("*").alias("n"))
    rooted = per_node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_class = rooted.groupBy("root").agg(F.min("least").alias("first"), F.sum("n").alias("n_rows"))
    of_node = keep(rooted.join(per_class, "root").select(
        "node", F.col("first.doc_id").alias("class_id"), F.col("first.raw").alias("class_raw"), "n_rows"), "classes")
    columns = ["doc_id", "raw", "class_id", "class_raw", "n_rows"]
    own = rows.where("node IS NULL").select("doc_id", "raw", F.col("doc_id").alias("class_id"), F.col("raw").alias("class_raw"), F.lit(1).cast("long").alias("n_rows"))
    return worded.select("doc_id", "raw", "node").join(of_node, "node").select(*columns).unionAll(own)


def one_of_each(documents: DataFrame) -> DataFrame:
    """The first row of each class, by id and then by a hash of the text; of rows that repeat both, one."""
    kept = _classified(documents).where("doc_id <=> class_id AND raw = class_raw").groupBy("doc_id", "raw").agg(F.count("*").alias("_rows"))
    kept = keep(kept.select(F.col("doc_id").alias("_kept_id"), F.col("raw").alias("_kept_raw"), "_rows"), "kept")
    # The columns given travel in one, so that no name of theirs can clash with those made here.
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_given"), F.xxhash64("text").alias("_raw"))
    rows = rows.join(kept, F.col("_given.doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("_raw") == F.col("_kept_raw")))
    single = rows.where("_rows = 1").select("_given.*")
    repeated = rows.where("_rows > 1").dropDuplicates(["_kept_id", "_raw"]).select("_given.*")
    return single.unionAll(repeated)

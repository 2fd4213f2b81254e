"""How far the sources of a language differ in what they say: copies collapse first, terms are counted once per text.

A group is a (lang, source); its share of a term is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), V the terms of the language in at
least ``LEAST`` of its documents, N the group's occurrences of them. Two shares differ by f = floor((p - q)^2 / (p + q)).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import column, keep, small_batches

LEAST = 10        # documents of a language that hold a kept term
TOP = 10          # telling terms reported for a group
HELD = 400_000    # terms that a task holds before it passes on their counts
BLOCK = 512       # sources whose pairs a task adds up at a time
SCALE = 1_000_000_000
# Letters of ASCII in lower case and all bytes beyond ASCII belong to a term, every other byte separates.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def _distinct_texts(documents: DataFrame) -> DataFrame:
    """(lang, text, copies): each text of a language once, with the rows of each source that hold it.

    Texts are told apart by their SHA-256. A source's rows are counted in partial aggregates, so a group of copies is one row for each task
    and source before anything is shuffled.
    """
    text, names = F.coalesce(F.col("text"), F.lit("")), [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    rows = documents.select(*names, text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    of_source = rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
    copies = of_source.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    texts = rows.groupBy("lang", "digest").agg(F.first("text").cast("binary").alias("text"))
    return texts.join(copies, ["lang", "digest"]).select("lang", "text", "copies")


def _count_terms(held: int):
    """(lang, source, term, count, docs) of the texts of a task, added up in dictionaries of bounded size."""
    names = ["lang", "source", "term", "count", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, docs) in groups.items():
                terms = list(counts)
                for at in range(0, len(terms), 50_000):
                    some = terms[at:at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()),
                         pa.array([counts[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())], names)

        for batch in batches:
            for lang, text, copies in zip(*[column(batch, c).to_pylist() for c in ("lang", "text", "copies")]):
                terms = text.translate(TERM_BYTES).split()
                once = len(copies) == 1 and copies[0]["n"] == 1
                tally = None if once else Counter(terms)
                for copy in copies:
                    group = lang, copy["source"]
                    if group not in groups:
                        groups[group] = Counter(), Counter()
                    counts, docs = groups[group]
                    size -= len(counts)
                    if once:
                        counts.update(terms)
                        docs.update(set(terms))
                    else:
                        n = copy["n"]
                        for term, k in tally.items():
                            counts[term] += k * n
                            docs[term] += n
                    size += len(counts)
                if size > held:
                    yield from passed_on()
                    groups, size = {}, 0
        yield from passed_on()

    return run


def kept_terms(documents: DataFrame, least: int = LEAST, held: int = HELD) -> DataFrame:
    """(lang, term, source, count, total, lead, shared) of the terms in at least ``least`` documents of their language.

    ``total``: occurrences in the language; ``lead``: 1 in one row of each term; ``shared``: more than one source has it. One shuffle by term.
    """
    small_batches(documents.sparkSession)
    counted = _distinct_texts(documents).mapInArrow(_count_terms(held), "lang string, source string, term binary, count bigint, docs bigint")
    dealt = counted.withColumn("term", F.col("term").cast("string")).repartition("lang", "term")
    of_source = dealt.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    wide = of_source.withColumns({
        "df": F.sum("docs").over(term), "total": F.sum("count").over(term),
        "lead": (F.min("source").over(term) == F.col("source")).cast("int"), "shared": F.count("*").over(term) > 1})
    return wide.where(F.col("df") >= least).drop("df", "docs")


def _share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), exact for any counts; NULL where nothing is kept."""
    below = f"nullif({total} + 2 * {kept}, 0)"
    return F.expr(f"1 + CASE WHEN {count} < 9000000000 THEN ({SCALE}L * ({count} + 2)) div {below} "
                  f"ELSE (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 2 AS DECIMAL(20, 0))) div CAST({below} AS DECIMAL(20, 0)) END")


def _differ(p: str, q: str) -> str:
    return f"(((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q})))"


def _groups(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """A row for each (lang, source): place in its lang, number of sources, V, N of the lang and the group, share of an absent term."""
    names = documents.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    counts = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.sum("lead").alias("_lead"))
    lang = Window.partitionBy("lang")
    rows = names.join(counts, ["lang", "source"], "left").fillna(0, ["n", "_lead"])
    rows = rows.select(
        "lang", "source", "n", (F.row_number().over(lang.orderBy("source")) - 1).alias("place"), F.count("*").over(lang).alias("sources"),
        F.sum("_lead").over(lang).alias("v"), F.sum("n").over(lang).alias("n_lang"))
    return rows.withColumn("absent", F.coalesce(_share("0", "n", "v"), F.lit(1).cast("long")))


def _met_together(block: int):
    """Sums over terms that two sources share of f(p, q) - f(p, absent) - f(absent, q) + f(absent, absent).

    Rows (lang, i, j, term, place, p, absent) come sorted; the pairs of a term's sources are met by shifting the rows against each other,
    and added up in one matrix of ``block`` x ``block``.
    """
    names = ["lang", "one", "two", "value"]

    def differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((block, block), np.int64)
        touched, current, rest = np.zeros((block, block), bool), None, None

        def passed_on() -> Iterator[pa.RecordBatch]:
            lang, i, j = current
            one, two = np.nonzero(touched)
            if len(one):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(one)), pa.array(one + i * block, pa.int64()), pa.array(two + j * block, pa.int64()), pa.array(sums[one, two])], names)
            sums[:], touched[:] = 0, False

        def add(rows: pa.RecordBatch) -> None:
            terms = column(rows, "term")
            number = np.zeros(rows.num_rows, np.int64)
            if rows.num_rows > 1:
                number[1:] = np.cumsum(pa.compute.not_equal(terms.slice(1), terms.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False))
            place, p, absent = [column(rows, c).to_numpy().astype(np.int64) for c in ("place", "p", "absent")]
            _, i, j = current
            for shift in range(1, rows.num_rows):
                same = np.flatnonzero(number[shift:] == number[:-shift])
                if not len(same):
                    break
                one, two = same, same + shift
                if i != j:
                    apart = (place[one] // block == i) & (place[two] // block == j)
                    one, two = one[apart], two[apart]
                value = differ(p[one], p[two]) - differ(p[one], absent[two]) - differ(absent[one], p[two]) + differ(absent[one], absent[two])
                at = place[one] - i * block, place[two] - j * block
                np.add.at(sums, at, value)
                touched[at] = True

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*[column(batch, c).to_pylist() for c in ("lang", "i", "j")]))
            at = 0
            while at < len(keys):
                to = len(keys) if keys[-1] == keys[at] else next(k for k in range(at + 1, len(keys)) if keys[k] != keys[at])
                if keys[at] != current:
                    if rest is not None:
                        add(rest)
                        yield from passed_on()
                    current, rest = keys[at], None
                rows = batch.slice(at, to - at)
                if rest is not None:
                    rows = pa.Table.from_batches([rest, rows]).combine_chunks().to_batches()[0]
                # The last term may go on in the next batch; a term has at most as many rows as sources of two blocks.
                terms = column(rows, "term")
                whole = int(pa.compute.index(terms, terms[-1]).as_py())
                add(rows.slice(0, whole))
                rest, at = rows.slice(whole), to
        if rest is not None:
            add(rest)
            yield from passed_on()

    return run


def divergence(documents: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair``, how far the group differs from each other source of its lang; part ``term``, its most telling terms.

    NULL text, lang and source count as empty. Identical texts of a language are one text with its rows by source, and
    only that is split into terms. A pair's value is a sum over all kept terms, found sparsely: V times the difference of two absent
    terms, a correction for each count a source has (by a histogram of counts), and one for each term both have. Texts without terms,
    repeated rows and ids count as documents; a lang without kept terms has pairs of value 0 and no terms, a lang of one source no
    pairs; an empty table gives no rows. Other columns are not read.

    Counts are exact: shares by 64-bit or decimal division, sums in 64 bits (V up to 9 * 10^9 terms).
    """
    spark = documents.sparkSession
    documents = documents.select("lang", "source", "text")
    kept = keep(kept_terms(documents, least, held), "terms")
    groups = keep(_groups(documents, kept), "groups")
    small_batches(spark, 10_000)
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", _share("count", "n", "v"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]

    telling = shares.withColumn("q", _share("total", "n_lang", "v")).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_differ("p", "q")).alias("value"))
    telling = telling.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("item_place"), F.col("absent").alias("item_absent"))
    pairs = groups.join(other, "lang").where("place <> item_place")
    base = pairs.select("lang", "source", "item", F.expr(f"v * {_differ('absent', 'item_absent')}").alias("value"))
    # Terms that one of two sources has, as if the other had none: by the shares a source has and how many terms have each.
    seen = shares.groupBy("lang", "source", "place", "absent", "p").agg(F.count("*").alias("terms")).join(other, "lang").where("place <> item_place")
    alone = seen.groupBy("lang", "source", "item").agg(
        F.sum(F.expr(f"terms * ({_differ('p', 'item_absent')} - {_differ('absent', 'item_absent')})")).alias("value"))
    # Then what terms of both sources change.
    met = shares.where("shared").withColumn("_block", F.floor(F.col("place") / block))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / block))
    met = met.withColumn("_other", F.explode(blocks)).select(
        "lang", F.least("_block", "_other").alias("i"), F.greatest("_block", "_other").alias("j"), "term", "place", "p", "absent")
    met = met.repartition("lang", "i", "j", "term").sortWithinPartitions("lang", "i", "j", "term", "place")
    both = met.mapInArrow(_met_together(block), "lang string, one bigint, two bigint, value bigint").groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", "source", "item", F.least("place", "item_place").cast("long").alias("one"),
                        F.greatest("place", "item_place").cast("long").alias("two")).join(both, ["lang", "one", "two"])
    turned = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = base.unionByName(alone).unionByName(turned).unionByName(both.select("lang", "source", "item", "value"))
    found = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    found = found.withColumn("rank", F.row_number().over(ranked))
    return found.select(*columns).unionAll(telling.select(*columns))

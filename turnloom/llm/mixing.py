"""Mixing sources to target weights by weighted fair queueing over shuffled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import WORD, keep, running_total

WEIGHTS = (3, 1, 2)  # by the rank of a source, repeating
SHARE = 1.5          # of all words
EPOCHS = 2           # times a document may be taken


def words_in(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   epochs: int = EPOCHS) -> DataFrame:
    """Adds rank, weight and target to (source, source_size).

    Sources rank by code point, NULL last. The budget is ``share`` of all words. A target is
    the common level times the weight, or ``epochs`` times the source's size if that is
    less; the level rises until the budget is spent. Only two sums reach the driver per step.
    """
    ranked = running_total(sources.withColumn("_one", F.lit(1)), [F.col("source").isNull(), F.col("source")], "_one", "source_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = keep(ranked.withColumn("weight", weight).drop("_one"), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level, capped = float(total) * share, None, -1
    cap = F.col("source_size") * epochs
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        n, spent, rest = ranked.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == capped or not rest:
            break
        level, capped = (budget - float(spent)) / float(rest), n
    level = level if level is not None else 0.0
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), cap.cast("double")))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
        seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, copies, source_size, target, passes) for every distinct (doc_id, source, size).

    Each source is a queue: its documents shuffled by a hash of id and pass, one pass after
    the other. A document's virtual finish time is the queue's words up to and with it, over the
    source's target, so all queues reach their targets at time 1. The documents of all queues are
    sorted by that time and taken until the budget is spent. Rows that agree in id,
    source and size (``copies`` of them) move through the queue together and share one fate.
    NULL and empty texts have size 0 and are taken as nothing; a NULL source is a source, a NULL id an id.
    A run depends on ids, sources, sizes and ``seed`` alone, so reruns agree.
    """
    items = documents.select("doc_id", "source", words_in("text").alias("size"))
    items = keep(items.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")), "items")
    sources = items.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    targets = keep(source_targets(keep(sources, "sizes"), weights, share, epochs), "targets")
    budget = float(targets.agg(F.sum("source_size")).first()[0] or 0) * share
    targets = targets.select(F.col("source").alias("_source"), "source_size", "source_rank", "target")
    items = items.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    lot = F.md5(F.concat_ws(":", F.lit(seed), F.col("pass").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    queued = items.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumns(
        {"lot": lot, "words": F.col("size") * F.col("copies")}).where("words > 0")
    queued = running_total(queued, [F.col(c) for c in ("source_rank", "pass", "lot", "doc_id", "size")], "words", "queue_before", ["source_rank"])
    finish = (F.col("queue_before") + F.col("words")).cast("double") / F.col("target")
    queued = queued.withColumn("finish", finish)
    merged = running_total(queued, [F.col(c) for c in ("finish", "source_rank", "pass", "lot", "doc_id", "size")], "words", "words_before")
    taken = merged.where(F.col("words_before") + F.col("words") <= F.lit(budget))
    taken = taken.groupBy("doc_id", "source_rank", "size").agg(F.count("*").alias("passes"))
    left, right = items.alias("l"), taken.alias("r")
    on = (F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.source_rank") == F.col("r.source_rank"))
          & (F.col("l.size") == F.col("r.size")))
    return left.join(right, on, "left").select("l.*", F.coalesce("r.passes", F.lit(0)).alias("passes"))


def mixture_report(documents: DataFrame, **options) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, taken."""
    mixed = mix(documents, **options)
    rows = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The rows of the mixture, with the columns of ``documents``; a document taken twice is there twice."""
    mixed = mix(documents, **options).where("passes > 0").select(
        F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("size").alias("_mix_size"),
        F.col("passes").alias("_mix_passes"))
    # The columns given travel in one, so that no name of theirs can clash with those made here.
    sized = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_given"), words_in("text").alias("_mix_words"))
    on = (F.col("_given.doc_id").eqNullSafe(F.col("_mix_id")) & F.col("_given.source").eqNullSafe(F.col("_mix_source"))
          & (F.col("_mix_words") == F.col("_mix_size")))
    rows = sized.join(mixed, on).withColumn("_mix_pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_passes"))))
    return rows.select("_given.*")

"""IDF-weighted lexical relevance of items to the question of their group.

Document frequencies, weights and sums are grouped aggregations and equi-joins on
(group, token), so no group's items or vocabulary ever meet in one task. Join sides with
one row per (group, token) leave skew to the adaptive split of the item side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.session import shuffled

COVERAGE_WEIGHT, SIMILARITY_WEIGHT, PHRASE_WEIGHT = 0.60, 0.20, 0.20
ENTITY_BONUS = 0.15
# Sums of weights run in no fixed order; ranks compare scores at this many places.
RANK_PLACES = 12


def smooth_idf(count: Column, frequency: Column) -> Column:
    return F.log(1.0 + count / (1.0 + frequency))


def document_frequencies(items: DataFrame, keys: list[str]) -> DataFrame:
    """(group, token) -> how many items carry it, with the group's item count."""
    counts = items.groupBy(*keys).agg(F.count("*").alias("n_items"))
    # Counts join the items and not their terms, which are many times as many rows.
    terms = items.select(*keys, "tokens").join(shuffled(counts), keys).select(
        *keys, "n_items", F.explode(F.array_distinct("tokens")).alias("token"))
    return terms.groupBy(*keys, "token").agg(F.count("*").alias("df"), F.max("n_items").alias("n_items"))


def phrase_overlap(query_tokens: str, tokens: str) -> Column:
    wanted = X.bigrams_sql(query_tokens)
    return F.expr(f"CASE WHEN size({query_tokens}) < 2 THEN 0d ELSE size(array_intersect({wanted}, "
                  f"{X.bigrams_sql(tokens)})) / size({wanted}) END")


def clamp(value: Column) -> Column:
    """Into [0, 1]; NULL stays NULL (``greatest`` and ``least`` alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def lexical_scores(items: DataFrame, questions: DataFrame, keys: list[str], item: str,
                   entities: str | None = None) -> DataFrame:
    """Add ``lexical``; ``items`` has (keys, item, tokens), ``questions`` (keys, q_tokens)."""
    questions = questions.select(*keys, "q_tokens")
    frequencies = document_frequencies(items, keys)
    counts = items.groupBy(*keys).agg(F.count("*").alias("n_items"))
    asked = questions.select(*keys, F.explode(F.array_distinct("q_tokens")).alias("token"))
    asked = asked.join(shuffled(counts), keys).join(
        shuffled(frequencies.select(*keys, "token", "df")), [*keys, "token"], "left").select(
        *keys, "token", smooth_idf(F.col("n_items"), F.coalesce("df", F.lit(0))).alias("q_idf"))
    asked_weight = asked.groupBy(*keys).agg(F.sum("q_idf").alias("q_weight"))
    weights = frequencies.select(
        *keys, "token", smooth_idf(F.col("n_items"), F.col("df")).alias("idf")
    ).join(shuffled(asked), [*keys, "token"], "left").select(
        *keys, "token", "idf", F.when(F.col("q_idf").isNotNull(), F.col("idf")).otherwise(0.0)
        .alias("shared"))
    terms = items.select(*keys, item, F.explode(F.array_distinct("tokens")).alias("token"))
    sums = terms.join(shuffled(weights), [*keys, "token"]).groupBy(*keys, item).agg(
        F.sum("idf").alias("item_weight"), F.sum("shared").alias("shared_weight"))
    # Questions join the sums and not the items with their texts; an item without a sum scores 0 whatever is asked.
    sums = sums.join(shuffled(questions.join(shuffled(asked_weight), keys, "left")), keys, "left")
    scored = items.join(shuffled(sums), [*keys, item], "left")
    if entities:
        named = (
            items.select(*keys, item, F.explode(
                X.token_set(f"array_join({entities}, ' ')")).alias("token"))
            .join(counts, keys)
            .join(frequencies.select(*keys, "token", "df"), [*keys, "token"], "left")
            .join(asked.select(*keys, "token", F.lit(True).alias("_asked")), [*keys, "token"], "left")
            .withColumn("_w", smooth_idf(F.col("n_items"), F.coalesce("df", F.lit(0))))
            .groupBy(*keys, item).agg(
                (F.coalesce(F.sum(F.when(F.col("_asked"), F.col("_w"))), F.lit(0.0))
                 / F.sum("_w")).alias("entity_share")))
        scored = scored.join(named, [*keys, item], "left")
    shared, own, wanted = (
        F.coalesce("shared_weight", F.lit(0.0)), F.col("item_weight"), F.col("q_weight"))
    score = (COVERAGE_WEIGHT * shared / wanted
             + SIMILARITY_WEIGHT * shared / (wanted + own - shared)
             + PHRASE_WEIGHT * phrase_overlap("q_tokens", "tokens"))
    if entities:
        score = score + ENTITY_BONUS * F.coalesce("entity_share", F.lit(0.0))
    drop = ["item_weight", "shared_weight", "q_weight", "q_tokens"] + (["entity_share"] if entities else [])
    return scored.withColumn(
        "lexical", F.when(wanted.isNull() | own.isNull(), F.lit(0.0)).otherwise(clamp(score))
    ).drop(*drop)


def plain_lexical(query_tokens: str, tokens: str) -> Column:
    """The unweighted form, for when no candidate frequencies are known."""
    q, t = F.col(query_tokens), F.col(tokens)
    shared = F.size(F.array_intersect(q, t))
    score = (COVERAGE_WEIGHT * shared / F.size(F.array_distinct(q))
             + SIMILARITY_WEIGHT * shared / F.size(F.array_union(q, t))
             + PHRASE_WEIGHT * phrase_overlap(query_tokens, tokens))
    return F.when((F.size(q) == 0) | (F.size(t) == 0), F.lit(0.0)).otherwise(clamp(score))

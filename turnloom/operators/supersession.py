"""Which memories a later correction replaces, by joins of their claims instead of arrays of a whole session.

Two claims of a session contradict each other if they share a kind and a subject token, their subjects' tokens are similar enough and their values share none.
A memory is superseded by one seen later that says it replaces something.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators.retrieval import SAME_SUBJECT


def superseded(memories: DataFrame, keys: list[str], seen: str = "seen") -> DataFrame:
    """(keys, older_id, newer_id, subject) of every memory and each later one that supersedes it.

    ``memories`` has (keys, memory_id, ``seen``, replaces, claims) as ``memory_features`` makes them, a row for each memory. Memories without a
    claim or without ``seen``, and those seen at one time, supersede nothing. Claims meet by (keys, kind, subject token), where only corrections stand on one
    side; a subject that a third of all claims share is split by the adaptive join. NULL keys form no session.
    """
    said = memories.select(*keys, "memory_id", F.col(seen).alias("seen"), F.coalesce("replaces", F.lit(False)).alias("replaces"), F.explode("claims").alias("c"))
    said = said.select(*keys, "memory_id", "seen", "replaces", "c.*").where("seen IS NOT NULL")
    met = said.withColumn("kind", F.explode(F.array_distinct("kinds"))).withColumn("token", F.explode(F.array_distinct("subject_tokens")))
    met = met.select(*keys, "kind", "token", "memory_id", "claim", "seen", "replaces", "subject", "subject_tokens", "value_tokens")
    newer = met.where("replaces").select(*keys, "kind", "token", *[F.col(c).alias(f"newer_{c}") for c in ("memory_id", "claim", "seen", "subject_tokens", "value_tokens")])
    pairs = met.join(newer, [*keys, "kind", "token"]).where("seen < newer_seen AND memory_id <> newer_memory_id")
    shared = F.size(F.array_intersect("subject_tokens", "newer_subject_tokens"))
    alike = shared / F.size(F.array_union("subject_tokens", "newer_subject_tokens")) >= SAME_SUBJECT
    pairs = pairs.where(alike & ~F.arrays_overlap("value_tokens", "newer_value_tokens"))
    return pairs.groupBy(*keys, F.col("memory_id").alias("older_id"), F.col("newer_memory_id").alias("newer_id")).agg(
        F.min_by("subject", F.struct("claim", "newer_claim")).alias("subject"))

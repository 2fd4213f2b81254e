"""Queries that find repeats over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators import leaders, supersession
from turnloom.plans.registry import query
from turnloom.plans.workspace import workspace


@query
def dedupe_documents(spark, sf):
    """Every document walked by id: kept, or merged into the first kept one of equal or nearly equal content tokens."""
    rows = workspace(spark, sf).table("documents").select("doc_id", X.content_tokens("text").alias("tokens"))
    return leaders.leader_dedupe(rows, "doc_id", "doc_id", "tokens")


@query
def retrieval_superseded(spark, sf):
    """Memories of every conversation and the later corrections that supersede them, by turns."""
    memories = workspace(spark, sf).memories
    return supersession.superseded(memories.withColumn("seen", F.col("source_turn").cast("long")), ["conv_id"])

"""Queries that grade what was packed: memories and chunks to prompts to scores, roll-ups and failures.

No number here is drawn: facts are looked for in the texts that retrieval chose and in the prompts that were packed, and
answers are the replies the conversations give after their last user turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators import failures, paired, rollups
from turnloom.operators import modes as M
from turnloom.plans.registry import query
from turnloom.plans.workspace import QM, workspace

SETS = [[], ["mode"], ["category", "mode"], ["length_tier", "mode"], ["category"], ["length_tier"]]
FACTS = ["retrieved", "in_prompt", "missing", "forbidden_retrieved", "prompt_forbidden", "absent", "lost_after_selection",
         "unneeded"]


def _six(rows: DataFrame) -> DataFrame:
    """Doubles to six places; slices outside a grouping show -1 as length."""
    rows = rows.withColumns({c: F.bround(c, 6) for c, kind in rows.dtypes if kind == "double"})
    if "length_tier" in rows.columns:
        rows = rows.withColumn("length_tier", F.coalesce(F.col("length_tier").cast("long"), F.lit(-1).cast("long")))
    return rows


def _graded(replays: DataFrame) -> DataFrame:
    return replays.select(
        *QM, *[F.array_join(c, "|").alias(c) for c in FACTS], "recall", "precision", "evidence_in_prompt",
        "prompt_contains_forbidden", "final_tokens", "full_tokens", "token_savings", "context_reduction",
        F.md5("answer").alias("answer_digest"), "matched_answer", "stale_value", "verdict", "error_type", "faithfulness",
        F.bround("qae", 6).alias("qae"))


@query
def replay_transcript_modes(spark, sf):
    """Graded prompts of the modes that show turns and chunks."""
    return _graded(workspace(spark, sf).transcript_replays)


@query
def replay_memory_modes(spark, sf):
    """Graded prompts of the modes that recall memories."""
    return _graded(workspace(spark, sf).memory_replays)


@query
def replay_slices(spark, sf):
    """Headline measures by mode, category and length."""
    return _six(rollups.hide_ungraded(rollups.aggregate_scores(workspace(spark, sf).replays, SETS)))


@query
def replay_evidence_by_length(spark, sf):
    """How the share of prompts that hold all required facts falls with length, for every mode."""
    points = rollups.aggregate_scores(workspace(spark, sf).replays, [["mode", "length_tier"]])
    return _six(rollups.degradation(points, ["mode"], accuracy="evidence_in_prompt_rate").drop("reference_length"))


@query
def replay_comparisons(spark, sf):
    """Paired differences between modes over the same tasks."""
    return _six(paired.paired_differences(workspace(spark, sf).replays, paired.comparison_pairs([m.mode for m in M.MODES])))


@query
def replay_losses(spark, sf):
    """What the policy and the budgets left out, by mode, reason and the failure it counts as."""
    return workspace(spark, sf).replay_losses.groupBy(
        "mode", "reason", failures.drop_label("reason").alias("label")).agg(F.count("*").alias("n"))


@query
def replay_failure_records(spark, sf):
    return workspace(spark, sf).replay_failures.select(
        *QM, "failure_type", "stage", F.array_join("contributors", "|").alias("contributors"), "observed_failure",
        "evidence_lost", "agreement",
        F.expr("array_join(transform(blame, b -> concat(b.fact_id, ':', b.label)), '|')").alias("blame"),
        "expected_memory")


@query
def replay_failure_slices(spark, sf):
    return _six(failures.group_measures(
        workspace(spark, sf).replay_failures, [[], ["mode"], ["category"], ["length_tier"], ["category", "mode"]]))

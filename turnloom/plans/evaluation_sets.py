"""Queries that build and check the planted evaluation set."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators import digests, evalset
from turnloom.plans.registry import query
from turnloom.plans.workspace import workspace


def _joined(*names):
    return [F.array_join(n, "|").alias(n) for n in names]


@query
def eval_tasks(spark, sf):
    tasks = evalset.accepted_answers(workspace(spark, sf).tasks)
    return tasks.select(
        "conv_id", "category", "length_tier", "question", "expected_answer", "abstention_expected",
        F.col("n_facts").cast("long").alias("n_facts"),
        *_joined("required", "supporting", "forbidden", "accepted"))


@query
def eval_facts(spark, sf):
    """Slot assignment and ledger rows."""
    return evalset.exploded_facts(workspace(spark, sf).tasks).select(
        "conv_id", "fact_id", "role", "fact_type", "text", "subject", "value",
        F.array_join("markers", "|").alias("markers"), "supersedes", "superseded_by",
        F.col("introduced_turn").cast("long").alias("introduced_turn"))


@query
def eval_transcript(spark, sf):
    return workspace(spark, sf).transcript.select(
        "conv_id", F.col("pos").cast("long").alias("pos"), "role", "content", "fact_id",
        F.col("session").cast("long").alias("session"))


@query
def eval_given_turns(spark, sf):
    """Rows of the transcript that are given turns: all turns of the table, whatever their length."""
    space = workspace(spark, sf)
    counts = space.transcript.groupBy("conv_id").agg(F.count("*").alias("n"))
    return counts.join(space.tasks.select("conv_id", "n_facts"), "conv_id").select(
        "conv_id", (F.col("n") - 2 * F.col("n_facts")).cast("long").alias("given_turns"))


@query
def eval_answer_variants(spark, sf):
    facts = evalset.exploded_facts(workspace(spark, sf).tasks).where("length(value) > 0")
    return facts.select("conv_id", "fact_id",
                        F.array_join(evalset.answer_variants(F.col("value")), "|").alias("variants"))


@query
def eval_grid(spark, sf):
    """Categories x lengths x variants, one variant per conversation block of the table."""
    space = workspace(spark, sf)
    grid = evalset.task_grid(spark, evalset.TIERS, 2)
    have = space.tasks.groupBy("category", F.col("length_tier").alias("target_tokens")).agg(
        F.count("*").alias("tasks"))
    return grid.join(have, ["category", "target_tokens"], "left").select(
        "task_id", "category", F.col("target_tokens").cast("long").alias("target_tokens"),
        F.col("variant").cast("long").alias("variant"), F.coalesce("tasks", F.lit(0)).alias("tasks"))


@query
def eval_issues(spark, sf):
    """A damaged copy of the set, so that each rule has something to find."""
    space = workspace(spark, sf)
    key = F.col("conv_id")
    damaged = space.tasks.select(
        "conv_id", F.when(key % 5 == 0, F.lit("  ")).otherwise(F.col("question")).alias("question"),
        "session_count", "abstention_expected",
        F.when(key % 6 == 0, F.array(F.lit("fact-99"))).otherwise(F.col("required")).alias("required"),
        "supporting",
        F.when(key % 4 == 0, F.array(F.lit("fact-77"))).otherwise(F.col("forbidden")).alias("forbidden"),
        F.transform("facts", lambda f: F.struct(
            f["fact_id"].alias("fact_id"), f["fact_type"].alias("fact_type"),
            F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(f["markers"]).alias("markers"),
            f["supersedes"].alias("supersedes"),
            F.when(key % 8 == 0, F.lit("fact-55")).otherwise(f["superseded_by"]).alias("superseded_by"),
        )).alias("facts"))
    messages = space.transcript.where(key % 7 != 0).select(
        "conv_id", "session", F.when((key % 9 == 0) & (F.col("pos") == 0), F.lit("narrator"))
        .otherwise(F.col("role")).alias("role"))
    doubled = damaged.unionByName(damaged.where(key % 11 == 0))
    issues = evalset.task_issues(doubled, messages)
    return issues.distinct()


@query
def eval_clean(spark, sf):
    """The set as built has no structural problem: zero rows per task."""
    space = workspace(spark, sf)
    issues = evalset.task_issues(space.tasks, space.transcript)
    return space.tasks.select("conv_id").join(
        issues.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id", "left"
    ).select("conv_id", F.coalesce("n", F.lit(0)).alias("issues"))


@query
def eval_distances(spark, sf):
    """Distance of the first required fact and of the last fact from the end."""
    space = workspace(spark, sf)
    lengths = space.transcript.groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.sum(X.estimate_tokens("content")).alias("achieved_tokens"))
    spoken = F.filter("facts", lambda f: f["role"] != "absent")
    required = F.array_min(F.transform(
        F.filter("facts", lambda f: f["role"] == "required"), lambda f: f["introduced_turn"]))
    turn_map = F.array_join(F.array_sort(F.transform(spoken, lambda f: F.concat_ws(
        ":", f["fact_id"], f["introduced_turn"].cast("string")))), "|")
    return space.tasks.join(lengths, "conv_id").select(
        "conv_id", "messages", "achieved_tokens", turn_map.alias("fact_turns"),
        (F.col("messages") - F.array_max(F.transform(spoken, lambda f: f["introduced_turn"])) - 1)
        .alias("last_fact_distance"),
        (F.col("messages") - required - 1).alias("required_fact_distance"))


@query
def eval_manifest(spark, sf):
    """Task count, per-category counts, mean tokens and a digest of the tasks in the order of their ids."""
    space = workspace(spark, sf)
    sized = space.transcript.groupBy("conv_id").agg(F.sum(X.estimate_tokens("content")).alias("tokens"))
    counts = space.tasks.join(sized, "conv_id").groupBy("category").agg(
        F.count("*").alias("tasks"), F.bround(F.avg("tokens"), 1).alias("mean_tokens"))
    task = F.concat_ws("\n", F.col("conv_id").cast("string"), "question", "expected_answer")
    sealed = digests.ordered_digest(space.tasks, ["category"], "conv_id", task, "digest")
    return counts.join(sealed, "category").select("category", "tasks", "mean_tokens", "digest")

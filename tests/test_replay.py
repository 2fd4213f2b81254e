"""Replay records against a plain reading of the packed prompts, and a loss by budget end to end."""

import re

import pytest
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators import modes as M
from turnloom.operators import packing, replay
from turnloom.plans.workspace import workspace

FACT = ("struct<fact_id:string,role:string,fact_type:string,text:string,subject:string,value:string,"
        "markers:array<string>,session_index:int>")


@pytest.fixture(scope="module")
def space(spark):
    return workspace(spark, "/root/testdata/sf0.001")


def plain(text):
    return " " + " ".join(re.findall(r"[a-z0-9]+", text.lower())) + " "


def found(texts, facts):
    """Fact ids of which one text holds every marker."""
    texts = [plain(t) for t in texts]
    return sorted(f["fact_id"] for f in facts if f["fact_type"] != "absent" and f["markers"]
                  and any(all(plain(m) in t for m in f["markers"]) for t in texts))


def test_every_mode_equals_a_plain_reading(space):
    facts = {r.conv_id: [f.asDict() for f in r.facts] for r in space.tasks.select("conv_id", "facts").collect()}
    prompts, chosen = {}, {}
    for r in space.replay_contexts.prompts().collect():
        prompts.setdefault((r.conv_id, r.mode), []).append(r.content)
    for r in space.replay_decided.where("drop_reason IS NULL").collect():
        chosen.setdefault((r.conv_id, r.mode), []).append(r.guarded)
    for r in space.top_chunks.collect():
        for mode in [m for m in M.MODES if m.uses_chunks and r["rank"] <= m.top_k]:
            chosen.setdefault((r.conv_id, mode.mode), []).append(r.text)
    rows = space.replays.collect()
    assert len(rows) == len(facts) * len(M.MODES)
    for r in rows:
        key = (r.conv_id, r.mode)
        assert r.in_prompt == found(prompts[key], facts[r.conv_id]), key
        assert r.retrieved == found(chosen.get(key, []), facts[r.conv_id]), key
        assert r.final_tokens == sum(-(-len(t) // 4) + X.MESSAGE_OVERHEAD for t in prompts[key]), key
        assert r.evidence_in_prompt == (bool(r.required) and set(r.required) <= set(r.in_prompt))


def test_replies_are_the_first_after_the_last_question(spark):
    turns = spark.createDataFrame(
        [(1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 5, "User", "q2"), (1, 7, "assistant", "b"), (1, 8, "assistant", "c"),
         (2, 0, "user", "q"), (3, 0, "assistant", "alone"), (4, 0, "user", "q"), (4, 1, "assistant", None)],
        "conv_id long, turn long, role string, text string")
    assert {r.task_id: r.answer for r in replay.given_replies(turns).collect()} == {1: "b", 4: ""}


def packed(spark, budget):
    fact = ("fact-1", "required", "database", "Project Zed uses Quartz.", "Project Zed", "Quartz", ["Project Zed", "Quartz"], 0)
    tasks = spark.createDataFrame(
        [(1, "What does Project Zed use?", "database", 500, "Quartz", [], False, ["fact-1"], [], [], [fact], 1)],
        "conv_id long, question string, category string, length_tier int, expected_answer string, acceptable_answers array<string>, "
        f"abstention_expected boolean, required array<string>, supporting array<string>, forbidden array<string>, facts array<{FACT}>, session_count int")
    turns = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(["Project Zed uses Quartz.", "Fine.", "Well."])],
                                  "conv_id long, pos int, role string, content string")
    chunks = spark.createDataFrame([(1, 1, "chunk-0", 0, "user", "Project Zed uses Quartz.", 0.9, False)],
                                   "conv_id long, rank int, chunk_id string, turn int, role string, text string, score double, suspicious boolean")
    modes = [M.Mode("chunks", "C", uses_chunks=True, chunk_budget=budget)]
    return tasks, packing.build_contexts(tasks, turns, None, chunks, modes=modes)


@pytest.mark.parametrize("budget,shown,verdict,error", [
    (1024, ["fact-1"], "correct", ""), (5, [], "correct", "")])
def test_what_the_budget_drops_is_not_in_the_prompt(spark, budget, shown, verdict, error):
    tasks, contexts = packed(spark, budget)
    answers = spark.createDataFrame([(1, None, 0, "It is Quartz")], "task_id long, mode string, seq int, answer string")
    graded = replay.grade(replay.replay_records(tasks, contexts, answers))
    row = graded.first()
    assert (row.retrieved, row.in_prompt, row.verdict, row.error_type) == (["fact-1"], shown, verdict, error)
    assert row.faithfulness == float(bool(shown)) and row.lost_after_selection == ([] if shown else ["fact-1"])
    failures = replay.attribute(graded, replay.losses(None, contexts), tasks).collect()
    assert [(f.failure_type, f.blame[0].label) for f in failures] == ([] if shown else [("over_compression", "over_compression")])


def test_without_answers_nothing_is_graded(spark):
    tasks, contexts = packed(spark, 1024)
    row = replay.grade(replay.replay_records(tasks, contexts)).first()
    assert (row.verdict, row.faithfulness, row.qae) == ("ungraded", None, None)


def test_losses_keep_the_order_of_packing(space):
    lost = space.replay_losses
    assert lost.where("seq.stage IS NULL OR reason IS NULL").isEmpty()
    assert lost.where(F.col("seq.stage") == 0).count() == space.replay_decided.where("drop_reason IS NOT NULL").count()
    assert lost.where(F.col("seq.stage") > 0).count() == space.replay_contexts.drops().count()


def test_candidates_are_shuffled_before_they_become_a_row_for_each_mode(space):
    plan = space._decide(space.recalled, space.reported_conflicts, space.reported_stale)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(conv_id" in plan and "Broadcast" not in plan
    assert not [line for line in plan.split("\n") if "Exchange" in line and "mode#" in line]

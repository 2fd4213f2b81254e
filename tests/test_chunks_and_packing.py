import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators import chunks as C
from turnloom.operators import modes as M
from turnloom.operators import packing as P
from turnloom.operators.prefix import running_index, running_total, running_totals


def test_running_totals_across_spans(spark):
    values = [random.Random(7).randint(0, 9) for _ in range(50)]
    rows = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i int, v int")
    got = running_total(rows, ["k"], "i", F.col("v"), "s", span=8).orderBy("i").collect()
    assert [r.s for r in got] == [sum(values[: i + 1]) for i in range(50)]
    got = running_total(rows, ["k"], "i", F.col("v"), "s", descending=True, span=8).orderBy("i").collect()
    assert [r.s for r in got] == [sum(values[i:]) for i in range(50)]
    assert [r.n for r in running_index(rows, ["k"], "i", "n", span=8).orderBy("i").collect()] == list(range(50))


def test_pack_sentences(spark):
    text = "Aaa bbb. Ccc ddd. " + "e" * 30 + ". Fff."
    got = spark.createDataFrame([(text,)], "t string").select(C.pack_sentences("t", 20)).first()[0]
    assert got == ["Aaa bbb. Ccc ddd.", "e" * 30 + ".", "Fff."]


def brute(rows, k, threshold):
    kept = []
    for score, turn, cid, tokens in sorted(rows, key=lambda r: (-r[0], r[1], r[2])):
        if len(kept) == k:
            break
        if all(len(tokens & t) / len(tokens | t) < threshold for _, t in kept):
            kept.append((cid, tokens))
    return [c for c, _ in kept]


def test_running_total_keeps_rows_without_key_or_order(spark):
    rows = spark.createDataFrame([("k", 1, 2), ("k", None, 3), (None, 1, 5)], "k string, i int, v int")
    got = {(r.k, r.i): r.s for r in running_total(rows, ["k"], "i", F.col("v"), "s").collect()}
    assert got == {("k", None): 3, ("k", 1): 5, (None, 1): 5}


def test_a_copy_that_the_guard_empties_does_not_hide_a_usable_one(spark):
    rows = [("q", f"chunk-{i}", i, "user", t, k, s) for i, (t, k, s) in enumerate(
        [("<system>", ["system"], 1.0), ("system", ["system"], 1.0), ("other words here", ["other", "word"], 0.0)])]
    frame = spark.createDataFrame(rows, "q string, chunk_id string, turn int, role string, text string, tokens array<string>, lexical double")
    assert [r.chunk_id for r in C.greedy_top_k(frame, ["q"], 6, 0.88).orderBy("rank").collect()] == ["chunk-1", "chunk-2"]


def test_top_k_equals_brute_force(spark):
    """Copies and near copies crowd the front."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        base = [f"w{j}" for j in range(12)] if i % 3 else [f"x{rng.randint(0, 9)}" for _ in range(6)]
        tokens = base + ([f"y{i % 4}"] if i % 2 else [])
        rows.append(("q", f"chunk-{i}", i, "user", " ".join(tokens), tokens, round(rng.random(), 1)))
    frame = spark.createDataFrame(rows, "q string, chunk_id string, turn int, role string, text string, tokens array<string>, lexical double")
    got = [r.chunk_id for r in C.greedy_top_k(frame, ["q"], 6, 0.88).orderBy("rank").collect()]
    assert got == brute([(r[6], r[2], r[1], frozenset(r[5])) for r in rows], 6, 0.88)


def packed(spark, lengths, **mode):
    turns = spark.createDataFrame([(1, i, "user", "x" * (4 * n)) for i, n in enumerate(lengths)],
                                  "conv_id long, pos int, role string, content string")
    tasks = spark.createDataFrame([(1, "Why?")], "conv_id long, question string")
    knobs = dict(max_recent=None, recent_budget=256) | {k: v for k, v in mode.items() if k != "max_tokens"}
    return P.build_contexts(tasks, turns, None, None, max_tokens=mode.get("max_tokens"), modes=[M.Mode("m", "M", **knobs)])


@pytest.mark.parametrize("lengths,knobs,kept", [
    ([10, 300], {}, [1]), ([100, 100, 100], {}, [1, 2]), ([10, 10, 10], {"max_recent": 2}, [1, 2])])
def test_window(spark, lengths, knobs, kept):
    got = packed(spark, lengths, **knobs)
    assert sorted(r.pos for r in got.window.collect()) == kept


def test_ceiling_evicts_oldest_history_first_and_keeps_the_question(spark):
    got = packed(spark, [50, 50, 50], max_tokens=100)
    row = got.stats.first()
    assert row.history_messages_selected == 1 and row.dropped_history_for_budget == 2
    assert row.final_context_tokens <= 100
    bare = packed(spark, [50], max_tokens=8).stats.first()
    assert bare.fitted_system == "" and bare.system_truncated and bare.question == "Why?"


def test_block_fill_passes_over_what_does_not_fit(spark):
    rows = [(1, "m", i + 1, f"id{i}", text, "FACT", False, 1.0, False) for i, text in enumerate(["a" * 20, "b" * 4000, "c" * 20])]
    memories = spark.createDataFrame(rows, "conv_id long, mode string, rank int, memory_id string, guarded string, "
                                           "memory_type string, contested boolean, score double, suspicious boolean")
    tasks = spark.createDataFrame([(1, "Why?")], "conv_id long, question string")
    turns = spark.createDataFrame([(1, 0, "user", "hello")], "conv_id long, pos int, role string, content string")
    got = P.build_contexts(tasks, turns, memories, None, modes=[M.Mode("m", "M", uses_memory=True, memory_budget=256)])
    row = got.stats.first()
    assert [i.id for i in row.memory_items] == ["id0", "id2"]
    assert [(r.memory_id, r.reason) for r in got.drops().collect()] == [("id1", "memory_budget")]
    cost = got.prompts().selectExpr("sum(ceil(length(content) / 4) + 4) AS c").first().c
    assert cost == row.final_context_tokens


def test_places_are_counted_whatever_the_turn_numbers(spark):
    for numbers in (range(30), range(1, 31), range(0, 60, 2), [i // 2 for i in range(30)], [10_000 * i for i in range(30)]):
        rows = spark.createDataFrame([("s", n, "user", f"turn {i:02d}") for i, n in enumerate(numbers)], "s string, pos long, role string, content string")
        got = P.history_rows(rows, ["s"]).where("back <= 8").collect()
        assert sorted(r.back for r in got) == list(range(1, 9)) and min(r.content for r in got) == "turn 22"


def test_a_message_is_kept_once_however_many_modes_show_it(spark):
    turns = spark.createDataFrame([(c, i, "user", "x" * 40) for c in (1, 2) for i in range(5)],
                                  "conv_id long, pos int, role string, content string")
    tasks = spark.createDataFrame([(1, "Why?"), (2, "How?")], "conv_id long, question string")
    got = P.build_contexts(tasks, turns, None, None, modes=[M.Mode("a", "A", max_recent=None, recent_budget=None), M.Mode("b", "B", max_recent=2), M.Mode("c", "C", max_recent=0)])
    assert got.history.count() == 10
    shown = {(r.conv_id, r.mode): r.p for r in got.window.groupBy("conv_id", "mode").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect()}
    assert shown == {(c, m): p for c in (1, 2) for m, p in (("a", [0, 1, 2, 3, 4]), ("b", [3, 4]))}


def test_top_k_goes_on_in_rounds_where_the_front_is_all_alike(spark):
    """More near copies than are walked in one row hide what comes after them; a row without a key is no group."""
    alike = [f"w{j}" for j in range(40)]
    rows = [("q", f"chunk-{i}", i, "user", f"text {i}", [*alike, f"y{i}"], 0.9) for i in range(2 * C.FRONT)]
    rows += [("q", f"chunk-{100 + i}", 100 + i, "user", f"text {i}", [f"z{i}"], 0.1) for i in range(3)]
    rows += [("r", "chunk-0", 0, "user", "text", ["a"], 0.5), (None, "chunk-1", 1, "user", "text", ["a"], 0.5), (None, "chunk-2", 2, "user", "text", ["b"], 0.4)]
    frame = spark.createDataFrame(rows, "q string, chunk_id string, turn int, role string, text string, tokens array<string>, lexical double")
    got = C.greedy_top_k(frame, ["q"], 6, 0.88).orderBy("q", "rank").collect()
    assert [(r.q, r["rank"], r.chunk_id) for r in got] == [
        (None, 1, "chunk-1"), ("q", 1, "chunk-0"), ("q", 2, "chunk-100"), ("q", 3, "chunk-101"), ("q", 4, "chunk-102"), ("r", 1, "chunk-0")]


def test_running_totals_read_their_rows_in_one_shuffle(spark):
    rows = spark.createDataFrame([("k", i, "t", i) for i in range(9)], "k string, i int, t string, v int")
    plan = running_totals(rows, ["k"], "i", {"s": F.col("v"), "n": F.lit(1)}, ["t"])._jdf.queryExecution().executedPlan().toString()
    # One exchange of the rows, three of the span totals: summed, put in order, joined.
    assert plan.count("Exchange hashpartitioning") == 4 and "Broadcast" not in plan

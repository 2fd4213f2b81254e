import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators import extraction as EX
from turnloom.operators import retrieval as R

CASES = [
    ("Thanks for that!", []), ("What database do we use?", []),
    ("What do we use? The production database is PostgreSQL 16.", [("PROJECT_STATE", 0.90)]),
    ("Actually, we changed to MySQL 8.", [("CORRECTION", 0.92)]),
    ("I prefer short answers in reports.", [("PREFERENCE", 0.88)]),
    ("You must encrypt every backup.", [("CONSTRAINT", 0.86)]),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_extraction(spark, text, expected):
    rows = EX.candidates(spark.createDataFrame([(1, text)], "id int, content string")).collect()
    assert [(r.memory_type, r.confidence) for r in rows] == expected


def test_first_five_of_a_turn(spark):
    text = " ".join(f"The production database number {i} is ready." for i in range(6))
    found = EX.candidates(spark.createDataFrame([(1, text)], "id int, content string"))
    assert found.count() == 6
    assert EX.select_candidates(found, ["id"]).count() == 5


def decide(spark, rows, question="Atlas MySQL", conflicts=None, policy=None, **kwargs):
    """rows: (id, text, turn, {overrides})"""
    schema = ("q string, memory_id string, text string, memory_type string, position int, source_turn int, "
              "status string, valid_until timestamp, observed_at timestamp, created_at timestamp, "
              "entities array<string>, signals map<string,double>")
    data = []
    for i, (mid, text, turn, extra) in enumerate(rows):
        data.append(("q", mid, text, extra.get("type", "FACT"), i, turn, extra.get("status"), None, None, None, [], None))
    frame = R.memory_features(spark.createDataFrame(data, schema), ["q"]).withColumns({
        "q_tokens": X.content_tokens(f"'{question}'"), "current_turn": F.lit(10)})
    frame = R.with_policy(frame, policy)
    decided = R.select_memories(frame, ["q"], policy, F.to_timestamp(F.lit("2024-06-01")), conflicts, **kwargs)
    return {r.memory_id: r for r in decided.collect()}


def test_scores_and_relative_floor(spark):
    got = decide(spark, [("m1", "Atlas uses MySQL", None, {}), ("m2", "Atlas uses Redis", None, {})])
    # The hand-worked values are cut, not rounded, at the sixth place.
    assert got["m1"].lexical == pytest.approx(0.740421, abs=1e-6)
    assert got["m2"].lexical == pytest.approx(0.296999, abs=1e-6)
    assert got["m1"].score == pytest.approx(0.834813, abs=1e-6)
    assert got["m1"].drop_reason is None and got["m2"].drop_reason == "weak_relevance"


def test_eligibility(spark):
    got = decide(spark, [("a", " ", 1, {}), ("b", "Atlas uses MySQL", 1, {"status": "superseded"}), ("c", "Atlas MySQL", 1, {})])
    assert (got["a"].drop_reason, got["b"].drop_reason, got["c"].drop_reason) == ("empty", "stale", None)


def test_repeats_merge_into_the_first(spark):
    got = decide(spark, [("a", "Atlas uses MySQL.", 1, {}), ("b", "atlas USES mysql", 1, {})])
    assert got["b"].drop_reason == "duplicate" and got["a"].merged_ids == ["b"]


OLD, NEW = "The production database is PostgreSQL 16.", "the production database is MySQL 8."


def test_correction_supersedes(spark):
    got = decide(spark, [("a", OLD, 3, {}), ("b", "Actually, " + NEW, 9, {})], "production database")
    assert got["a"].drop_reason == "superseded" and "source=heuristic" in got["a"].detail
    assert got["b"].drop_reason is None and not got["b"].contested


@pytest.mark.parametrize("turns", [(3, 9), (None, None)])
def test_without_marker_or_clock_both_stay_contested(spark, turns):
    got = decide(spark, [("a", OLD, turns[0], {}), ("b", "The" + NEW[3:], turns[1], {})], "production database")
    assert all(r.drop_reason is None and r.contested for r in got.values())


def test_reported_conflict_without_the_newer_memory(spark):
    conflicts = spark.createDataFrame([("q", 1, "s", "a", "gone", "", "")],
                                      "q string, seq int, subject string, older_id string, newer_id string, older_text string, newer_text string")
    got = decide(spark, [("a", OLD, 3, {})], "production database", conflicts)
    assert got["a"].drop_reason is None and got["a"].contested


def test_reported_conflict_by_text(spark):
    conflicts = spark.createDataFrame([("q", 1, "db", "", "", OLD.upper(), NEW)],
                                      "q string, seq int, subject string, older_id string, newer_id string, older_text string, newer_text string")
    got = decide(spark, [("a", OLD, 3, {}), ("b", "The" + NEW[3:], 9, {})], "production database", conflicts)
    assert got["a"].detail == "superseded by b (subject=db, source=runtime)"


def test_cap_drops_the_last(spark):
    words = "alpha bravo cedar delta ember frost grove hazel ivory jolly karma lemon mango".split()
    got = decide(spark, [(f"m{i:02d}", f"Atlas MySQL {w}", 1, {}) for i, w in enumerate(words)])
    assert [k for k, r in got.items() if r.drop_reason == "cap"] == ["m12"]
    assert sorted(r.rank for r in got.values() if r.rank) == list(range(1, 13))


def test_whole_texts_are_paired_and_repeats_used_up_in_order(spark, tmp_path):
    from turnloom.plans.retrieval import memory_pairing_texts

    texts = ["same beginning a", "same beginning b", "same beginning a", "same beginning a", None]
    rows = [(i + 1, t, "en", "s", 15 + i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = {(-r.position, r.memory_id) for r in memory_pairing_texts(spark, str(tmp_path)).collect()}
    assert got == {(4, "1"), (3, "3"), (1, "4"), (2, "2"), (5, None)}
    assert {r.text for r in memory_pairing_texts(spark, str(tmp_path)).collect()} == set(texts)


def test_every_sentence_of_a_benchmark_item_is_a_marker(spark, tmp_path):
    from turnloom.plans.scoring import score_benchmark_passages

    spark.createDataFrame([(1, "Short one. A later sentence of some eight words here. Short one."), (2, "Alone"), (3, None)],
                          "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "x short, ONE y"), (2, "shortone alone"), (3, "so a later sentence of some eight words here, yes"),
                           (4, "a later sentence of some nine words here"), (5, None), (6, "")],
                          "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, score_benchmark_passages(spark, str(tmp_path)).collect()))
    assert got == [(1, "a later sentence of some eight words here", 3), (1, "short one", 1), (2, "alone", 2)]


def test_only_runs_on_the_place_of_an_opening_become_rows(spark):
    from turnloom.operators import phrases

    pick = np.random.default_rng(2)
    bodies = [[f"w{k}" for k in pick.integers(0, 30, n)] for n in [0, 1, 3, 7, 400, *pick.integers(0, 60, 700)]]
    wanted = ["w1", "w2 w3", "w4 w5 w6", "w1 w1", "w7 w8 w9 w10 w11", " ".join(bodies[4][:5]), "other"]
    texts = spark.createDataFrame(list(enumerate(bodies)) + [(-1, None)], "id long, words array<string>").coalesce(2)
    rows = [tuple(r) for r in phrases.openings_met(texts, "id", "words", spark.createDataFrame([(w,) for w in wanted], "opening string"), 5).collect()]
    every = {(i, " ".join(b[at:at + n])) for i, b in enumerate(bodies) for n in range(1, 6) for at in range(len(b) - n + 1)}
    assert len(set(rows)) == len(rows) and {r for r in rows if r[1] in wanted} == {r for r in every if r[1] in wanted}
    # Before, every run of one to five words was a row.
    assert set(rows) <= every and len(rows) < len(every) / 50


SAID = [
    "İ wıll never usе it, the tasK stays.", "The taſk must not move.", "We uſe the projecт and it İS deployed.",
    "By the way the project is staging.", "CHIT-CHAT is what we need.", "Deadline: every day at 10:30 it runs.", "Der Krämer sagt, the provider IS café.",
    "Please fix the étude today.", "Not café, it's tea.", "The hall (日本) needs light.", "I'm thinking of it is.", "Let's us see the deployment runs.",
    "This island was seen.", "Objective: aim to wın.", "Need to add a lamp here.", "The harbour_is closed.", "ten."]


def test_anchors_and_plain_patterns_agree(spark, monkeypatch):
    """Verdicts are those of the full patterns on every sentence, also with letters that only folding makes equal."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*SAID, " ".join(SAID), None])], "id int, content string")
    verdicts = lambda: sorted(tuple(r) for r in EX.candidates(rows).collect())
    got, patterns = verdicts(), {p for _, _, ps in EX.RULES for p in ps} | {EX.FILLER}
    assert patterns - {EX.STATEMENT} == set(EX.ANCHORS)
    monkeypatch.setattr(EX, "_found", lambda x, low, pattern: EX._matches(x, pattern))
    assert got == verdicts() and len({r[3] for r in got}) >= 5


def test_rules_are_not_repeated_in_a_filter(spark):
    plan = EX.candidates(spark.createDataFrame([(1, "a b.")], "id int, content string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("PROJECT_STATE") == 1

import random

import numpy as np
from pyspark.sql import functions as F

from turnloom.operators import leaders
from turnloom.session import written


def walked(rows, threshold=leaders.THRESHOLD):
    """Row by row, as the definition says."""
    kept, out = [], {}
    for key, tokens in sorted((k, t or []) for k, _, t in rows):
        for other, held in kept:
            both, every = len(set(tokens) & set(held)), len(set(tokens) | set(held))
            if tokens == held or (both / every if every else 1.0) >= threshold:
                out[key] = (False, other, tokens == held)
                break
        else:
            kept.append((key, tokens))
            out[key] = (True, None, None)
    return out


def deduped(spark, rows):
    frame = spark.createDataFrame([(k, o, t, "x", 1) for k, o, t in rows], "id long, place long, tokens array<string>, node string, n int")
    got = leaders.leader_dedupe(frame, "id", "place", "tokens").collect()
    assert len(got) == len(rows)
    return {r.id: (r.kept, r.leader, r.exact) for r in got}


def case():
    pick = random.Random(3)
    rows = []
    for i in range(40):
        base = [f"t{pick.randint(0, 3000)}" for _ in range(pick.randint(6, 45))]
        # Drifting copies: neighbours of neighbours are not always near.
        for step in range(pick.randint(1, 9)):
            rows.append(list(base))
            for _ in range(pick.randint(0, 2)):
                base[pick.randrange(len(base))] = f"u{pick.randint(0, 5000)}"
    rows += [[], None, [], ["a"], ["a", "a"], ["a", "b"]]
    rows += [["hot", *[f"h{pick.randint(0, 14)}" for _ in range(12)]] for _ in range(160)]  # a token of a third of the rows
    rows += [list(rows[3]) for _ in range(30)] + [list(reversed(rows[3]))]
    pick.shuffle(rows)
    return [(i, i, t) for i, t in enumerate(rows)]


def test_rounds_equal_the_walk(spark):
    rows = case()
    assert deduped(spark, rows) == walked(rows)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaders, "HEAVY", 7)
    monkeypatch.setattr(leaders, "EARLY_ROUNDS", 1)
    rows = case()
    assert deduped(spark, rows) == walked(rows)


def test_no_order_ties_and_nothing(spark):
    assert deduped(spark, []) == {}
    long = [f"w{i}" for i in range(20)]
    got = deduped(spark, [(1, None, long), (2, None, long), (3, 5, long[:-1]), (4, 5, None)])
    assert got[1] == (True, None, None) and got[2] == (False, 1, True) and got[3] == (False, 1, False) and got[4][0]


def test_plan_has_no_cross_join(spark):
    frame = spark.createDataFrame([(1, 1, ["a"])], "id long, place long, tokens array<string>")
    plan = leaders.leader_dedupe(frame, "id", "place", "tokens")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and F.lit(1) is not None


def test_similar_sets_share_parts():
    pick = np.random.default_rng(5)
    for n in [*range(8, 60), 150, 333, 1000]:
        for _ in range(20):
            one = pick.integers(-2 ** 63, 2 ** 63 - 1, n)
            gone = pick.integers(0, n)
            two = np.concatenate([one[gone:], pick.integers(-2 ** 63, 2 ** 63 - 1, pick.integers(0, n // 7 + 1))])
            both, every = len(np.intersect1d(one, two)), len(np.union1d(one, two))
            if both / every < leaders.THRESHOLD:
                two = one[:-1]
                if (n - 1) / n < leaders.THRESHOLD:
                    continue
            found, counts = leaders._signatures(np.concatenate([one, two]), np.cumsum([0, len(one), len(two)]), leaders.THRESHOLD)
            assert counts.sum() == len(found)
            assert len(np.intersect1d(found[:counts[0]], found[counts[0]:])) >= leaders.SHARED


def test_sets_that_only_share_tokens_meet_in_no_bucket(spark, monkeypatch):
    pick, rows_of = random.Random(9), {}

    def counted(frame, name):
        out = written(frame, name)
        rows_of[name] = rows_of.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(leaders, "written", counted)
    rows = [(i, i, [f"v{k}" for k in pick.sample(range(400), 60)]) for i in range(400)]
    rows.append((400, 400, rows[7][2][:-1]))
    got = deduped(spark, rows)
    assert got[400] == (False, 7, False) and sum(kept for kept, _, _ in got.values()) == 400
    # Every token is in some 60 sets; before, all of them were buckets of pairs.
    assert rows_of["buckets"] < 100 and rows_of["pairs"] < 400

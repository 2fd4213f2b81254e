import math

import pytest
from pyspark.sql import functions as F

from turnloom.operators import paired, rollups


def diffs(spark, values):
    rows = spark.createDataFrame([("k", float(v), 0.0) for v in values], "k string, a double, b double")
    return paired.difference_rows(rows, ["k"]).first()


def test_published_difference(spark):
    got = diffs(spark, [-1] * 5 + [0] * 2)
    assert (got.mean_difference, got.sd_difference) == (-0.714286, 0.48795)
    assert (got.ci_low, got.ci_high) == (-1.165564, -0.263007)
    assert (got.t_statistic, got.cohens_d, got.hedges_g) == (-3.873, -1.4639, -1.2729)
    assert (round(got.p_value, 4), got.sign_test_p) == (0.0082, 0.0625)
    assert (got.wins, got.losses, got.ties) == (0, 5, 2)


@pytest.mark.parametrize("values,p", [([-1] * 6 + [0], 0.0010), ([1] + [0] * 6, 0.3559)])
def test_published_p_values(spark, values, p):
    assert round(diffs(spark, values).p_value, 4) == p


def test_flat_and_single_pairs(spark):
    flat = diffs(spark, [2, 2, 2])
    assert (flat.t_statistic, flat.cohens_d, flat.p_value) == (0.0, 0.0, 0.0)
    single = diffs(spark, [3])
    assert (single.t_statistic, single.p_value, single.ci_low, single.ci_high) == (0.0, 1.0, 3.0, 3.0)


def two_tailed_p(t, df):
    """The finite sum for whole degrees of freedom."""
    angle = math.atan(abs(t) / math.sqrt(df))
    factor, total = (1.0, 0.0) if df % 2 == 0 else (math.cos(angle), 0.0)
    for j in range(1, df // 2 + 1):
        total += factor
        factor *= ((2 * j - 1) / (2 * j) if df % 2 == 0 else 2 * j / (2 * j + 1)) * math.cos(angle) ** 2
    inside = math.sin(angle) * total
    return 1 - inside if df % 2 == 0 else 1 - 2 / math.pi * (angle + inside)


def test_student_t_against_closed_forms(spark):
    cases = [(t, df) for df in (1, 2, 3, 7, 8, 30, 99, 1000, 5001) for t in (-40.0, -2.5, -0.001, 0.3, 1.0, 1.96, 6.0)]
    rows = spark.createDataFrame(cases, "t double, df long").withColumn("p", paired.student_t_p("t", "df"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    for row in rows.collect():
        assert math.isclose(row.p, two_tailed_p(row.t, row.df), abs_tol=1e-9), row
    assert math.isclose(two_tailed_p(1.0, 1), 0.5, rel_tol=1e-9)
    assert math.isclose(two_tailed_p(2.0, 2), 1 - 2 / math.sqrt(6), rel_tol=1e-9)


def test_student_t_at_its_ends(spark):
    rows = spark.createDataFrame([(0.0, 5), (3.0, 0), (None, 5), (3.0, None), (1e300, 5)], "t double, df long")
    got = [r.p for r in rows.select(paired.student_t_p("t", "df").alias("p")).collect()]
    assert got == [1.0, 1.0, None, None, 0.0]
    far = spark.createDataFrame([(1.5, 2_000_000)], "t double, df long").select(paired.student_t_p("t", "df").alias("p")).first().p
    assert math.isclose(far, math.erfc(1.5 / math.sqrt(2)), abs_tol=1e-6)


def test_degradation(spark):
    points = spark.createDataFrame([("m", 5000, 1.0), ("m", 10000, 0.8), ("m", 20000, 0.5), ("one", 1, 1.0)],
                                   "mode string, length_tier int, answer_accuracy double")
    rows = rollups.degradation(points, ["mode"])
    drops = {r.length_tier: r.absolute_degradation for r in rows.where("mode = 'm'").collect()}
    assert drops == {5000: 0.0, 10000: 0.2, 20000: 0.5}
    areas = {r["mode"]: r for r in rollups.degradation_areas(rows, ["mode"]).collect()}
    assert (areas["m"].area_under_degradation_curve, areas["m"].mean_degradation) == (4000.0, 0.266667)
    assert areas["one"].area_under_degradation_curve is None


def test_failure_mix(spark):
    counts = spark.createDataFrame([("full_context", "a", 2), ("full_context", "b", 2), ("m", "a", 1), ("m", "c", 3)],
                                   "mode string, label string, n long")
    got = {r["mode"]: r for r in paired.mix_distance(paired.failure_mix(counts, ["a", "b", "c"])).collect()}
    assert got["m"].distance == 0.75 and got["full_context"].distance == 0.0
    assert got["m"].largest_divergence == "c" and got["m"].top_label == "c"


def test_paired_differences_without_a_join(spark):
    """Modes of one task meet in one row, whatever trials, NULL metrics and NULL tasks there are."""
    schema = ("conv_id long, mode string, verdict string, faithfulness double, evidence_in_prompt boolean, recall double, "
              "final_tokens long, token_savings long, qae double, latency_ms double")
    row = lambda task, mode, recall, latency: (task, mode, "correct", 1.0, True, recall, 10, 1, 0.1, latency)
    rows = spark.createDataFrame([
        row(1, "a", 0.5, 3.0), row(1, "a", 1.0, None), row(1, "b", 0.25, None), row(2, "a", 0.5, None), row(2, "b", None, 4.0),
        row(3, "a", 1.0, 7.0), row(3, "b", 0.5, 4.0), row(None, "a", 1.0, 1.0), row(None, "b", 0.0, 1.0), row(4, None, 1.0, 1.0)], schema)
    found = paired.paired_differences(rows, [("a", "b"), ("b", "c")])
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.mode_a, r.mode_b, r.metric): r for r in found.collect()}
    assert {(a, b) for a, b, _ in got} == {("a", "b")} and got[("a", "b", "accuracy")].sample_size == 3
    recall, latency = got[("a", "b", "retrieval_recall")], got[("a", "b", "latency_ms")]
    assert (recall.sample_size, recall.mean_difference, recall.wins) == (2, 0.5, 2)
    assert (latency.sample_size, latency.mean_a, latency.mean_b) == (1, 7.0, 4.0)
    assert paired.task_means(rows.where("conv_id = 1 AND mode = 'a'")).where("metric = 'retrieval_recall'").first().value == 0.75


def test_sides_that_grow_are_not_broadcast(spark):
    from turnloom.operators import scoring

    items = spark.createDataFrame([(1, "the lamp")], "conv_id long, text string")
    tasks = spark.createDataFrame([(1, [("fact-1", "durable", ["lamp"])])], "conv_id long, facts array<struct<fact_id:string,fact_type:string,markers:array<string>>>")
    found = scoring.detect_facts(items, tasks, ["conv_id"], "text")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, "fact-1")]

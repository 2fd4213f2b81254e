"""Roll-ups of scored records: rates, slices, degradation curves and trial summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------------
HEADLINE = [
    "answer_accuracy", "retrieval_recall", "retrieval_precision", "evidence_in_prompt_rate",
    "faithfulness", "conflict_resolution_accuracy", "abstention_accuracy",
    "mean_final_context_tokens", "mean_full_context_reference_tokens", "mean_context_reduction",
    "mean_token_savings", "mean_quality_adjusted_efficiency", "quality_per_token", "mean_latency_ms"]
T_CRITICAL_95 = {
    1: 12.706205, 2: 4.302653, 3: 3.182446, 4: 2.776445, 5: 2.570582, 6: 2.446912, 7: 2.364624,
    8: 2.306004, 9: 2.262157, 10: 2.228139, 11: 2.200985, 12: 2.178813, 13: 2.160369, 14: 2.144787,
    15: 2.131450, 16: 2.119905, 17: 2.109816, 18: 2.100922, 19: 2.093024, 20: 2.085963,
    21: 2.079614, 22: 2.073873, 23: 2.068658, 24: 2.063899, 25: 2.059539, 26: 2.055529,
    27: 2.051831, 28: 2.048407, 29: 2.045230, 30: 2.042272, 40: 2.021075, 50: 2.008559,
    60: 2.000298, 80: 1.989972, 100: 1.983972, 120: 1.979930}
Z_95, Z_95_SHORT = 1.959963984540054, 1.96
# ------------------------------------------------------------------------------


def t_critical(df: Column) -> Column:
    """Table value, else the Cornish-Fisher expansion; 1.96 without degrees of freedom."""
    table = F.create_map(*[F.lit(v) for pair in T_CRITICAL_95.items() for v in pair])
    z = Z_95
    series = (F.lit(z) + (z ** 3 + z) / (4.0 * df)
              + (5.0 * z ** 5 + 16.0 * z ** 3 + 3.0 * z) / (96.0 * df * df))
    return F.when(df <= 0, F.lit(Z_95_SHORT)).otherwise(
        F.coalesce(F.try_element_at(table, df.cast("int")), series))


def rate(numerator: str, denominator: str) -> str:
    """A share that is 0 when its denominator is empty."""
    return f"coalesce(try_divide(count_if({numerator}), count_if({denominator})), 0D)"


def mean(value: str) -> str:
    """A mean that is 0 over nothing, to six places; a nudge settles ties, as sums have no fixed order."""
    return f"bround(coalesce(avg({value}), 0D) + 1e-10D, 6)"


GRADED = "verdict <> 'ungraded'"


def score_measures() -> dict[str, str]:
    """Headline rates, each over its own denominator."""
    return {
        "task_count": "count(*)", "graded_answer_count": f"count_if({GRADED})",
        "retrieval_recall": mean("CASE WHEN size(required) > 0 THEN recall END"),
        "retrieval_precision": mean("precision"),
        "evidence_in_prompt_rate": rate("evidence_in_prompt", "size(required) > 0"),
        "answer_accuracy": rate("verdict = 'correct'", GRADED),
        "faithfulness": rate("faithfulness = 1", "faithfulness IS NOT NULL"),
        "faithfulness_count": "count(faithfulness)",
        "conflict_resolution_accuracy": rate(f"conflict_task AND verdict = 'correct'", f"conflict_task AND {GRADED}"),
        "conflict_task_count": f"count_if(conflict_task AND {GRADED})",
        "abstention_accuracy": rate("expects_abstention AND verdict = 'correct'", "expects_abstention"),
        "stale_answer_rate": rate("verdict = 'stale_answer'", GRADED),
        "forbidden_in_prompt_rate": rate("conflict_task AND prompt_contains_forbidden", "conflict_task"),
        "mean_context_reduction": mean("context_reduction"),
        "mean_final_context_tokens": mean("final_tokens"),
        "mean_full_context_reference_tokens": mean("full_tokens"),
        "mean_token_savings": mean("token_savings"),
        "mean_quality_adjusted_efficiency": mean("qae"),
        "mean_latency_ms": "bround(avg(latency_ms), 6)", "latency_count": "count(latency_ms)"}


def aggregate_scores(scores: DataFrame, sets: list[list[str]]) -> DataFrame:
    """All slices in one pass with GROUPING SETS; ``slice`` names the set of a row."""
    names = sorted({c for group in sets for c in group})
    slice_name = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in names])
    rolled = scores.groupingSets([[F.col(c) for c in group] for group in sets], *[F.col(c) for c in names]).agg(
        slice_name.alias("slice"), *[F.expr(sql).alias(name) for name, sql in score_measures().items()])
    return rolled.withColumn("quality_per_token", F.expr(
        "CASE WHEN mean_final_context_tokens = 0 THEN 0D ELSE answer_accuracy / mean_final_context_tokens END"))


def hide_ungraded(rolled: DataFrame) -> DataFrame:
    """NULL for answer-side measures where no answer was graded."""
    answer_side = ["answer_accuracy", "faithfulness", "conflict_resolution_accuracy", "abstention_accuracy",
                   "stale_answer_rate", "mean_quality_adjusted_efficiency", "quality_per_token"]
    return rolled.withColumns({c: F.when(F.col("graded_answer_count") > 0, F.col(c)) for c in answer_side})


def counts_by(frame: DataFrame, keys: list[str], value: Column, out: str = "label") -> DataFrame:
    return frame.groupBy(*keys, value.alias(out)).agg(F.count("*").alias("n"))


def degradation(points: DataFrame, keys: list[str], length: str = "length_tier",
                accuracy: str = "answer_accuracy") -> DataFrame:
    """Per length, the drop from the shortest length of its curve."""
    along = Window.partitionBy(*keys).orderBy(length)
    reference = F.first(accuracy).over(along)
    rows = points.withColumn("_ref", reference)
    return rows.select(
        *keys, length, F.bround(accuracy, 6).alias("accuracy"), F.col("_ref").alias("reference_accuracy"),
        F.bround(F.col("_ref") - F.col(accuracy), 6).alias("absolute_degradation"),
        F.bround(F.when(F.col("_ref") <= 0, 0.0).otherwise(
            (F.col("_ref") - F.col(accuracy)) / F.col("_ref")), 6).alias("relative_degradation"),
        F.first(length).over(along).alias("reference_length"))


def degradation_areas(rows: DataFrame, keys: list[str], length: str = "length_tier") -> DataFrame:
    """Trapezoid areas over the rounded accuracies; NULL when a curve has one point."""
    along = Window.partitionBy(*keys).orderBy(length)
    width = F.col(length) - F.lag(length).over(along)
    drop = F.col("reference_accuracy") - F.col("accuracy")
    mid = lambda c: (F.lag(c).over(along) + c) / 2.0
    parts = rows.select(*keys, length, (width * mid(F.col("accuracy"))).alias("_a"), (width * mid(drop)).alias("_d"))
    span = F.max(length) - F.min(length)
    return parts.groupBy(*keys).agg(
        F.count("*").alias("point_count"), F.bround(F.sum("_a"), 6).alias("area_under_accuracy_curve"),
        F.bround(F.sum("_d"), 6).alias("area_under_degradation_curve"),
        F.bround(F.try_divide(F.sum("_d"), span), 6).alias("mean_degradation"))


def summarize(frame: DataFrame, keys: list[str], value: str, use_t: bool = False) -> DataFrame:
    """n, mean, sd and a 95 % interval; one observation has sd 0 and a point interval."""
    rows = frame.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("_m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_s"))
    times = t_critical(F.col("n") - 1) if use_t else F.lit(Z_95_SHORT)
    margin = F.when(F.col("n") > 1, times * F.col("_s") / F.sqrt("n")).otherwise(0.0)
    return rows.select(
        *keys, "n", F.bround(F.col("_m") + 1e-10, 6).alias("mean"), F.bround("_s", 6).alias("sd"),
        F.bround(F.col("_m") - margin, 6).alias("ci_low"), F.bround(F.col("_m") + margin, 6).alias("ci_high"))


def long_form(rolled: DataFrame, keys: list[str], metrics: list[str] = HEADLINE) -> DataFrame:
    """(keys, metric, value) rows of the headline measures."""
    pairs = ", ".join(f"'{m}', cast({m} AS double)" for m in metrics)
    return rolled.selectExpr(*keys, f"stack({len(metrics)}, {pairs}) AS (metric, value)")

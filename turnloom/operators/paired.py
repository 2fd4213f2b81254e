"""Paired comparisons between strategies, effect sizes and failure-mix distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators import modes as M
from turnloom.operators.rollups import t_critical

PAIR_METRICS = {
    "accuracy": "CASE WHEN verdict = 'correct' THEN 1D WHEN verdict <> 'ungraded' THEN 0D END",
    "faithfulness": "faithfulness",
    "evidence_in_prompt": "CASE WHEN evidence_in_prompt THEN 1D ELSE 0D END",
    "retrieval_recall": "recall",
    "final_context_tokens": "cast(final_tokens AS double)",
    "token_savings": "cast(token_savings AS double)",
    "quality_adjusted_efficiency": "qae",
    "latency_ms": "latency_ms"}


def comparison_pairs(available: list[str], baseline: str = "full_context") -> list[tuple[str, str]]:
    """Every target against the baseline, three fixed pairs, each removal against the full mode."""
    order = [m for m in [*M.BASELINES, *M.ABLATIONS] if m in available]
    pairs = [(m, baseline) for m in order if m != baseline] if baseline in available else []
    special = [("memory", "sliding_window"), ("memory", "chunks"), ("memory_chunks", "memory")]
    special += [(a, "memory") for a in M.ABLATIONS]
    for a, b in special:
        if a in available and b in available and (a, b) not in pairs:
            pairs.append((a, b))
    return pairs


def task_means(scores: DataFrame) -> DataFrame:
    """(task, mode, metric, value): the mean over trials where the metric exists."""
    pairs = ", ".join(f"'{name}', {name}" for name in PAIR_METRICS)
    return _wide_means(scores).selectExpr("conv_id", "mode", f"stack({len(PAIR_METRICS)}, {pairs}) AS (metric, value)").where("value IS NOT NULL")


def _wide_means(scores: DataFrame) -> DataFrame:
    """One row per (task, mode) with the mean of every metric over its trials."""
    return scores.groupBy("conv_id", "mode").agg(*[F.avg(F.expr(sql)).alias(name) for name, sql in PAIR_METRICS.items()])


def _log_gamma_step_sql(a: str) -> str:
    """ln(gamma(a + 1/2) / gamma(a)): carried up sixteen steps, where the asymptotic series is exact to 1e-14."""
    z = f"({a} + 16D)"
    series = f"0.5D * ln({z}) - 1D / (8D * {z}) + 1D / (192D * pow({z}, 3)) - 1D / (640D * pow({z}, 5)) + 17D / (14336D * pow({z}, 7))"
    return f"({series} + aggregate(sequence(0, 15), 0D, (acc, i) -> acc + ln(({a} + i) / ({a} + i + 0.5D))))"


def _beta_fraction_sql(a: str, b: str, x: str, terms: int = 400) -> str:
    """The incomplete-beta continued fraction by Lentz's recurrence, two terms for each of its levels."""
    m = "(i div 2)"
    even = f"{m} * ({b} - {m}) * {x} / (({a} + 2 * {m} - 1) * ({a} + 2 * {m}))"
    odd = f"-({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2 * {m}) * ({a} + 2 * {m} + 1))"
    term = f"(CASE WHEN i % 2 = 0 THEN {even} ELSE {odd} END)"
    apart = lambda v: f"coalesce(nullif({v}, 0D), 1e-30D)"
    d, c = f"(1D / {apart(f'1D + {term} * s.d')})", apart(f"1D + {term} / s.c")
    first = f"(1D / {apart(f'1D - ({a} + {b}) * {x} / ({a} + 1D)')})"
    return (f"aggregate(sequence(2, {terms + 1}), named_struct('d', {first}, 'c', 1D, 'h', {first}), "
            f"(s, i) -> named_struct('d', {d}, 'c', {c}, 'h', s.h * {d} * {c}), s -> s.h)")


def student_t_p(t: str, df: str) -> Column:
    """Two-tailed p of Student's t, without leaving the JVM.

    No degrees of freedom or t = 0 give 1; a NULL in either column gives NULL.
    """
    tail, rest = f"(1D / (1D + {df} / {t} / {t}))", f"(1D / (1D + {t} / {df} * {t}))"
    front = (f"exp({_log_gamma_step_sql('v.half')} - 0.5D * ln(pi()) + v.half * ln(v.rest) + 0.5D * ln(v.tail))")
    near, far = _beta_fraction_sql("v.half", "0.5D", "v.rest"), _beta_fraction_sql("0.5D", "v.half", "v.tail")
    value = (f"CASE WHEN v.rest < (v.half + 1D) / (v.half + 2.5D) THEN {front} * {near} / v.half "
             f"ELSE 1D - {front} * {far} / 0.5D END")
    held = f"array(named_struct('half', {df} / 2D, 'tail', {tail}, 'rest', {rest}))"
    return F.expr(
        f"CASE WHEN {t} IS NULL OR {df} IS NULL THEN NULL WHEN {df} <= 0 OR {t} = 0 THEN 1D "
        f"WHEN {tail} = 0 THEN 1D WHEN {rest} = 0 THEN 0D ELSE greatest(0D, least(1D, transform({held}, v -> {value})[0])) END")


def sign_test_sql(wins: str, losses: str) -> str:
    """Two-sided binomial p at one half, term by term in logs."""
    n, k = f"({wins} + {losses})", f"least({wins}, {losses})"
    return (f"CASE WHEN {n} = 0 THEN 1D ELSE least(1D, 2D * aggregate(sequence(0L, {k}), "
            f"named_struct('sum', 0D, 'log', -{n} * ln(2D)), (acc, i) -> named_struct("
            f"'sum', acc.sum + exp(acc.log), 'log', acc.log + ln({n} - i) - ln(i + 1)), "
            "acc -> acc.sum)) END")


def effect_size(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def hedges(d: Column, df: Column) -> Column:
    return F.when(df <= 1, d).otherwise(d * (1.0 - 3.0 / (4.0 * df - 1.0)))


def difference_rows(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Paired difference summary per key, with the one-pair and zero-spread rules."""
    diff = F.col(a) - F.col(b)
    rows = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(diff).alias("md"),
        F.coalesce(F.stddev_samp(diff), F.lit(0.0)).alias("sd"), F.count_if(diff > 0).alias("wins"),
        F.count_if(diff < 0).alias("losses"), F.count_if(diff == 0).alias("ties"))
    # Equal differences leave only rounding noise in the spread.
    rows = rows.withColumn("sd", F.when(F.col("sd") < 1e-12, 0.0).otherwise(F.col("sd")))
    rows = rows.withColumn("se", F.col("sd") / F.sqrt("n"))
    spread = F.col("sd") > 0
    rows = rows.withColumns({
        "t": F.when(spread, F.col("md") / F.col("se")).otherwise(0.0),
        "d": F.when(spread, F.col("md") / F.col("sd")).otherwise(0.0), "df": F.col("n") - 1,
        "margin": F.when(F.col("n") > 1, t_critical(F.col("n") - 1) * F.col("se")).otherwise(0.0)})
    rows = rows.withColumn("_p", student_t_p("t", "df"))
    p = F.when(F.col("n") <= 1, 1.0).when(spread, F.col("_p")).when(F.col("md") == 0, 1.0).otherwise(0.0)
    six = lambda c: F.bround(c, 6)
    return rows.select(
        *keys, F.col("n").alias("sample_size"), six(F.col("mean_a")).alias("mean_a"), six(F.col("mean_b")).alias("mean_b"),
        six(F.col("md")).alias("mean_difference"), six(F.col("sd")).alias("sd_difference"), six(F.col("se")).alias("standard_error"),
        six(F.col("md") - F.col("margin")).alias("ci_low"), six(F.col("md") + F.col("margin")).alias("ci_high"),
        F.bround("t", 4).alias("t_statistic"), six(p).alias("p_value"), F.bround("d", 4).alias("cohens_d"),
        F.bround(hedges(F.col("d"), F.col("df")), 4).alias("hedges_g"), effect_size(F.col("d")).alias("magnitude"),
        "wins", "losses", "ties", F.bround(F.col("wins") / F.col("n"), 4).alias("win_rate"),
        six(F.expr(sign_test_sql("wins", "losses")) + 1e-10).alias("sign_test_p"))


def paired_differences(scores: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Join each pair of modes on their common tasks and summarise every metric."""
    held = F.struct(*PAIR_METRICS)
    # The modes of one task meet in one row: a contract bounds their number, and no table of all tasks is joined or broadcast.
    tasks = _wide_means(scores).where("conv_id IS NOT NULL AND mode IS NOT NULL").groupBy("conv_id").agg(
        F.map_from_entries(F.collect_list(F.struct("mode", held.alias("values")))).alias("_modes"))
    wanted = F.array(*[F.struct(F.lit(a).alias("mode_a"), F.lit(b).alias("mode_b")) for a, b in pairs])
    met = tasks.select("_modes", F.explode(wanted).alias("p")).select(
        "p.*", F.try_element_at("_modes", F.col("p.mode_a")).alias("_a"), F.try_element_at("_modes", F.col("p.mode_b")).alias("_b"))
    metrics = ", ".join(f"'{name}', _a.{name}, _b.{name}" for name in PAIR_METRICS)
    rows = met.selectExpr("mode_a", "mode_b", f"stack({len(PAIR_METRICS)}, {metrics}) AS (metric, a, b)")
    return difference_rows(rows.where("a IS NOT NULL AND b IS NOT NULL"), ["mode_a", "mode_b", "metric"])


def independent_effect(frame: DataFrame, keys: list[str], value: str, group: Column) -> DataFrame:
    """Pooled Cohen's d and Hedges' g between the rows where ``group`` holds and the rest."""
    a, b = F.when(group, F.col(value)), F.when(~group, F.col(value))
    var = lambda c: F.coalesce(F.var_samp(c), F.lit(0.0))
    rows = frame.groupBy(*keys).agg(
        F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        var(a).alias("_va"), var(b).alias("_vb"))
    df = F.col("n_a") + F.col("n_b") - 2
    pooled = ((F.col("n_a") - 1) * F.col("_va") + (F.col("n_b") - 1) * F.col("_vb")) / df
    ok = (F.col("n_a") > 0) & (F.col("n_b") > 0) & (df > 0) & (pooled > 0)
    d = F.when(ok, (F.col("mean_a") - F.col("mean_b")) / F.sqrt(pooled)).otherwise(0.0)
    return rows.select(*keys, "n_a", "n_b", F.bround("mean_a", 6).alias("mean_a"), F.bround("mean_b", 6).alias("mean_b"),
                       F.bround(d, 4).alias("cohens_d"), F.bround(hedges(d, df), 4).alias("hedges_g"),
                       effect_size(d).alias("magnitude"))


def failure_mix(counts: DataFrame, vocabulary: list[str], baseline: str = "full_context") -> DataFrame:
    """Shares per (mode, label) over a fixed vocabulary, beside the baseline's shares.

    ``counts`` has (mode, label, n). A missing baseline falls back to the first mode.
    """
    labels = F.array(*[F.lit(v) for v in sorted(vocabulary)])
    grid = counts.select("mode").distinct().select("mode", F.explode(labels).alias("label"))
    full = grid.join(counts, ["mode", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("mode"))
    full = full.withColumn("share", F.try_divide(F.col("n"), total))
    chosen = counts.agg(F.coalesce(F.max(F.when(F.col("mode") == baseline, F.col("mode"))), F.min("mode")).alias("base"))
    base = full.join(F.broadcast(chosen), full["mode"] == F.col("base")).select(
        "label", F.col("share").alias("base_share"), "base")
    return full.join(F.broadcast(base), "label")


def mix_distance(mix: DataFrame) -> DataFrame:
    """Total variation distance from the baseline, top label and largest divergence."""
    gap = F.abs(F.col("share") - F.col("base_share"))
    rows = mix.groupBy("mode", "base").agg(
        F.sum("n").alias("label_total"),
        F.when(F.count("share") > 0, F.bround(F.sum(gap) / 2, 6)).alias("distance"),
        F.max_by("label", F.struct("n", "label")).alias("top_label"),
        F.max(F.round(gap, 12)).alias("_gap"),
        F.min_by("label", F.struct((-F.round(gap, 12)).alias("g"), F.col("label"))).alias("_widest"))
    return rows.select("mode", "base", "label_total", "distance",
                       F.when(F.col("label_total") > 0, F.col("top_label")).alias("top_label"),
                       F.when(F.col("_gap") > 0, F.col("_widest")).alias("largest_divergence"))

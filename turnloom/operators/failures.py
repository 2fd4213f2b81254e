"""Failure taxonomy: which stage lost the evidence, and what the answer did with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators.rollups import rate
from turnloom.operators.scoring import spoken_markers
from turnloom.session import shuffled

# Fixed values -----------------------------------------------------------------
ATTRIBUTION_ORDER = [
    "hallucination", "wrong_abstention", "conflicting_memory", "stale_memory", "missed_memory",
    "irrelevant_memory", "over_compression", "under_compression", "wrong_memory"]
STAGES = {
    "missed_memory": "recall", "irrelevant_memory": "selection", "over_compression": "selection",
    "under_compression": "prompt", "conflicting_memory": "generation", "stale_memory": "generation",
    "hallucination": "generation", "wrong_abstention": "generation", "wrong_memory": "generation"}
DROP_LABELS = {
    "low_relevance": "irrelevant_memory", "weak_relevance": "irrelevant_memory",
    "stale": "stale_memory", "expired": "stale_memory", "superseded": "conflicting_memory",
    "cap": "over_compression", "budget": "over_compression", "memory_budget": "over_compression",
    "chunk_budget": "over_compression", "chunk_ceiling": "over_compression",
    "duplicate": "", "duplicate_history": "", "empty": "", "suspicious": ""}
VOLUME_REASONS = ["cap", "budget", "memory_budget", "chunk_budget", "chunk_ceiling"]
RELEVANCE_REASONS = ["low_relevance", "weak_relevance"]
REFINABLE = ["missed_memory", "wrong_answer", "hallucination"]
UNSELECTING_MODES = ["full_context"]
# ------------------------------------------------------------------------------


def _map_sql(values: dict[str, str]) -> str:
    return "map(" + ", ".join(X.lit_sql(v) for pair in values.items() for v in pair) + ")"


def drop_label_sql(reason: str) -> str:
    return f"coalesce(try_element_at({_map_sql(DROP_LABELS)}, {reason}), '')"


def drop_label(reason: str) -> Column:
    return F.expr(drop_label_sql(reason))


def dropped_facts(drops: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys) a map from fact to the reason of the first drop whose preview carries it."""
    ledger = shuffled(spoken_markers(tasks))
    hit = drops.where("length(text) > 0").withColumn("_n", X.normalize_answer("text")).join(ledger, "conv_id").select(
        *keys, "seq", "reason", F.explode(F.expr(
            "transform(filter(_ledger, f -> forall(f.markers, m -> "
            f"{X.contains_normalized_sql('_n', 'm')})), f -> f.fact_id)")).alias("fact_id"))
    first = hit.groupBy(*keys, "fact_id").agg(F.min_by("reason", "seq").alias("reason"))
    return first.groupBy(*keys).agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("fact_id", "reason")))).alias("dropped_by_fact"))


def reason_counts(drops: DataFrame, keys: list[str]) -> DataFrame:
    counts = drops.groupBy(*keys, "reason").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reason_counts"))


def classify(scores: DataFrame) -> DataFrame:
    """Failure records: one per score with any defect, observed or latent.

    ``scores`` carries the scored columns plus ``dropped_by_fact`` and ``reason_counts``.
    """
    rows = scores.withColumns({
        "dropped_by_fact": F.coalesce("dropped_by_fact", F.expr("cast(map() AS map<string,string>)")),
        "reason_counts": F.coalesce("reason_counts", F.expr("cast(map() AS map<string,bigint>)"))})
    seen = lambda names: f"exists({X.array_sql(names)}, r -> map_contains_key(reason_counts, r))"
    label = drop_label_sql("coalesce(try_element_at(dropped_by_fact, f), '')")
    selecting = f"mode NOT IN ({', '.join(X.lit_sql(m) for m in UNSELECTING_MODES)})"
    rows = rows.withColumn("blame", F.expr(
        f"transform(absent, f -> named_struct('fact_id', f, 'label', CASE WHEN {label} <> '' THEN {label} "
        f"WHEN array_contains(retrieved, f) THEN CASE WHEN {seen(RELEVANCE_REASONS)} AND NOT {seen(VOLUME_REASONS)} "
        "THEN 'irrelevant_memory' ELSE 'over_compression' END "
        f"WHEN {selecting} THEN 'missed_memory' ELSE 'over_compression' END))"))
    rows = rows.withColumn("_signals", F.expr(
        "array_union(array_compact(array("
        "CASE WHEN verdict = 'incorrect' AND expects_abstention THEN 'hallucination' END, "
        "CASE WHEN verdict = 'stale_answer' THEN CASE WHEN category = 'conflict' THEN 'conflicting_memory' "
        "ELSE 'stale_memory' END END, "
        "CASE WHEN verdict IN ('abstained', 'wrong_abstention') AND evidence_in_prompt THEN 'wrong_abstention' END, "
        "CASE WHEN size(absent) > 0 THEN 'over_compression' END, "
        "CASE WHEN size(prompt_forbidden) > 0 THEN 'under_compression' END)), transform(blame, b -> b.label))"))
    rows = rows.withColumn("_signals", F.expr(
        "CASE WHEN size(_signals) = 0 AND verdict = 'incorrect' AND size(required) > 0 AND size(absent) = 0 "
        "THEN array(CASE WHEN size(unneeded) > 0 THEN 'wrong_memory' ELSE 'hallucination' END) ELSE _signals END"))
    rows = rows.withColumn("labels", F.expr(
        f"filter({X.array_sql(ATTRIBUTION_ORDER)}, l -> array_contains(_signals, l))"))
    rows = rows.where("size(labels) > 0").drop("_signals")
    return rows.withColumns({
        "failure_type": F.expr("labels[0]"), "contributors": F.expr("slice(labels, 2, size(labels))"),
        "stage": F.expr(f"element_at({_map_sql(STAGES)}, labels[0])"),
        "graded": F.expr("verdict <> 'ungraded'"),
        "observed_failure": F.expr("verdict NOT IN ('correct', 'ungraded')"),
        "evidence_lost": F.expr("array_contains(labels, 'over_compression')"),
        "agreement": F.expr(
            "CASE WHEN error_type IN ('', 'ungraded') THEN 'unlabelled' WHEN error_type = labels[0] THEN 'agree' "
            f"WHEN error_type IN ({', '.join(X.lit_sql(v) for v in REFINABLE)}) THEN 'refined' ELSE 'unexpected' END")})


def expected_memory_sql() -> str:
    """One line naming what the task needed to remember."""
    return ("array_join(transform(required, r -> coalesce(get(transform(filter(facts, f -> f.fact_id = r), f -> "
            "CASE WHEN f.subject <> '' AND f.value <> '' THEN concat(f.subject, ' = ', f.value) "
            "WHEN f.text <> '' THEN f.text ELSE r END), 0), r)), '; ')")


def group_measures(failures: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Defect counts and rates for all slices in one pass."""
    names = sorted({c for group in sets for c in group})
    slice_name = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in names])
    measures = {
        "defect_count": "count(*)", "graded_count": "count_if(graded)",
        "observed_failure_count": "count_if(observed_failure)",
        "latent_defect_count": "count_if(NOT observed_failure)",
        "failure_rate": "try_divide(count_if(observed_failure), count_if(graded))",
        "evidence_lost_count": "count_if(evidence_lost)",
        "absent_required_fact_count": "coalesce(sum(size(absent)), 0)",
        "forbidden_in_prompt_count": "count_if(prompt_contains_forbidden)",
        "unneeded_in_prompt_count": "count_if(size(unneeded) > 0)"}
    return failures.groupingSets([[F.col(c) for c in group] for group in sets], *[F.col(c) for c in names]).agg(
        slice_name.alias("slice"), *[F.expr(sql).alias(name) for name, sql in measures.items()])


def concentration(failures: DataFrame, top: int) -> DataFrame:
    """The (mode, category, label) cells that hold most failures, with their share of the cell."""
    cells = failures.groupBy("mode", "category", "failure_type").agg(F.count("*").alias("n"))
    totals = failures.groupBy("mode", "category").agg(
        F.count("*").alias("defects_in_cell"), F.count_if("observed_failure").alias("observed_failure_count"))
    return cells.join(totals, ["mode", "category"]).select(
        "mode", "category", "failure_type", F.expr(f"element_at({_map_sql(STAGES)}, failure_type)").alias("stage"), "n",
        "defects_in_cell", F.bround(F.col("n") / F.col("defects_in_cell"), 6).alias("share_of_cell"),
        "observed_failure_count").orderBy(F.desc("n"), "mode", "category", "failure_type").limit(top)


def examples(failures: DataFrame, per_label: int, order: list[str]) -> DataFrame:
    """The first few records of every (mode, label)."""
    within = Window.partitionBy("mode", "failure_type").orderBy(*order)
    return failures.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= per_label).drop("_n")

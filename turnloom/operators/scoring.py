"""Scoring of replays against the fact ledger, without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.session import shuffled

# Fixed values -----------------------------------------------------------------
CONFLICT_CATEGORIES = ["conflict", "temporal"]
VERDICTS = ["correct", "abstained", "wrong_abstention", "stale_answer", "incorrect", "ungraded"]
# ------------------------------------------------------------------------------
_NO_IDS = "cast(array() AS array<string>)"


def spoken_markers(tasks: DataFrame) -> DataFrame:
    """Per task, its planted facts with markers in the normalised answer space."""
    markers = "transform(f.markers, m -> %s)" % X.answer_sql("m")
    return tasks.select("conv_id", F.expr(
        "transform(filter(facts, f -> f.fact_type <> 'absent' AND size(f.markers) > 0), "
        f"f -> named_struct('fact_id', f.fact_id, 'markers', {markers}))").alias("_ledger"))


def detect_facts(items: DataFrame, tasks: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, fact_id) for every fact whose markers all occur in one item."""
    found = items.withColumn("_n", X.normalize_answer(text)).join(shuffled(spoken_markers(tasks)), "conv_id").select(
        *keys, F.explode(F.expr(
            "transform(filter(_ledger, f -> forall(f.markers, m -> "
            f"{X.contains_normalized_sql('_n', 'm')})), f -> f.fact_id)")).alias("fact_id"))
    return found.distinct()


def fact_sets(found: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Collapse detected facts to one sorted set per key; a ledger bounds its size."""
    return found.groupBy(*keys).agg(F.array_sort(F.collect_set("fact_id")).alias(out))


def load_answers(records: DataFrame) -> DataFrame:
    """One answer per (task, mode): the last record wins; a NULL mode is the plain row.

    ``records`` has (seq, task_id, mode, answer); task_id and answer are required.
    """
    checked = records.withColumn("task_id", F.when(
        F.col("task_id").isNull() | F.col("answer").isNull(),
        F.raise_error(F.lit("every answer record needs a task_id and an answer")))
        .otherwise(F.col("task_id")))
    return checked.groupBy("task_id", F.coalesce("mode", F.lit("")).alias("mode")).agg(
        F.max_by("answer", "seq").alias("answer"))


def look_up_answers(replays: DataFrame, answers: DataFrame, task: str = "conv_id") -> DataFrame:
    """The answer for (task, mode), else the task's plain answer, else NULL."""
    own = answers.where("mode <> ''").select(F.col("task_id").alias(task), "mode", F.col("answer").alias("_own"))
    plain = answers.where("mode = ''").select(F.col("task_id").alias(task), F.col("answer").alias("_plain"))
    return replays.join(shuffled(own), [task, "mode"], "left").join(shuffled(plain), task, "left").withColumn(
        "answer", F.coalesce("_own", "_plain")).drop("_own", "_plain")


def expected_abstention(frame: DataFrame, isolated: bool = False) -> DataFrame:
    """Add ``expects_abstention``; isolation counts facts of earlier sessions as unreachable."""
    lost = ("size(required) > 0 AND forall(required, r -> exists(facts, f -> f.fact_id = r "
            "AND f.session_index < session_count - 1))")
    return frame.withColumn("expects_abstention", F.expr(
        f"abstention_expected OR ({lost})" if isolated else "abstention_expected"))


def length_tier(record: str, tier: str, target: str, messages: str) -> Column:
    """First non-zero of: the record's own tier, the set's tier, its target, the message count."""
    return F.coalesce(*[F.expr(f"nullif({c}, 0)") for c in (record, tier, target)], F.col(messages), F.lit(0))


def score_retrieval(frame: DataFrame) -> DataFrame:
    """Add ledger sets and flags from ``required/supporting/forbidden/retrieved/in_prompt``."""
    frame = frame.withColumns({
        c: F.coalesce(c, F.expr(_NO_IDS)) for c in ("retrieved", "in_prompt")})
    wanted = "array_union(required, supporting)"
    return frame.withColumns({
        "missing": F.expr("array_except(required, retrieved)"),
        "forbidden_retrieved": F.expr("array_sort(array_intersect(forbidden, retrieved))"),
        "prompt_forbidden": F.expr("array_sort(array_intersect(forbidden, in_prompt))"),
        "absent": F.expr("array_except(required, in_prompt)"),
        "lost_after_selection": F.expr("array_except(array_intersect(required, retrieved), in_prompt)"),
        "unneeded": F.expr(f"array_except(in_prompt, {wanted})"),
        "recall": F.expr("CASE WHEN size(required) = 0 THEN 1D ELSE bround(size(array_intersect(required, retrieved)) "
                         "/ size(array_distinct(required)), 6) END"),
        "precision": F.expr(
            f"CASE WHEN size(retrieved) = 0 THEN CASE WHEN size({wanted}) > 0 THEN 0D ELSE 1D END "
            f"ELSE bround(size(array_intersect(retrieved, {wanted})) / size(retrieved), 6) END"),
        "evidence_in_prompt": F.expr("size(required) > 0 AND size(array_except(required, in_prompt)) = 0"),
        "prompt_contains_forbidden": F.expr("arrays_overlap(forbidden, in_prompt)")})


def score_answers(frame: DataFrame) -> DataFrame:
    """Verdict, refinement, faithfulness and efficiency; NULL stays NULL where nothing was graded."""
    frame = frame.withColumn("answer", F.coalesce(F.trim("answer"), F.lit(""))).withColumn(
        "_n", X.normalize_answer("answer"))
    has = X.contains_normalized_sql("_n", X.answer_sql("v"))
    stale_values = ("transform(filter(facts, f -> array_contains(forbidden, f.fact_id) AND length(f.value) > 0), "
                    "f -> f.value)")
    frame = frame.withColumns({
        "matched_answer": F.expr(f"coalesce(get(filter(accepted, v -> {has}), 0), '')"),
        "stale_value": F.expr(f"coalesce(get(filter({stale_values}, v -> {has}), 0), '')"),
        "_declined": F.expr(X.any_phrase_sql("_n", X.NORMALIZED_ABSTENTIONS))})
    frame = frame.withColumn("_first", F.expr(
        "CASE WHEN answer = '' THEN 'ungraded' "
        "WHEN expects_abstention THEN CASE WHEN _declined THEN 'correct' ELSE 'incorrect' END "
        "WHEN matched_answer <> '' THEN 'correct' WHEN _declined THEN 'abstained' "
        "WHEN stale_value <> '' THEN 'stale_answer' ELSE 'incorrect' END"))
    frame = frame.withColumn("verdict", F.expr(
        "CASE WHEN _first = 'abstained' AND evidence_in_prompt THEN 'wrong_abstention' ELSE _first END"))
    return frame.withColumns({
        "error_type": F.expr(
            "CASE verdict WHEN 'correct' THEN '' WHEN 'ungraded' THEN 'ungraded' "
            "WHEN 'wrong_abstention' THEN 'wrong_abstention' WHEN 'abstained' THEN 'missed_memory' "
            "WHEN 'stale_answer' THEN CASE WHEN category = 'conflict' THEN 'conflicting_memory' ELSE 'stale_memory' END "
            "ELSE CASE WHEN expects_abstention OR evidence_in_prompt THEN 'hallucination' ELSE 'missed_memory' END END"),
        "faithfulness": F.expr(
            "CASE WHEN verdict = 'ungraded' THEN NULL "
            "WHEN expects_abstention THEN CASE WHEN verdict = 'correct' THEN 1D ELSE 0D END "
            "WHEN verdict IN ('abstained', 'wrong_abstention') THEN CASE WHEN evidence_in_prompt THEN 0D ELSE 1D END "
            "WHEN verdict = 'correct' THEN CASE WHEN evidence_in_prompt THEN 1D ELSE 0D END "
            "WHEN verdict = 'stale_answer' THEN CASE WHEN prompt_contains_forbidden THEN 1D ELSE 0D END ELSE 0D END"),
        "qae": F.expr("CASE WHEN verdict = 'ungraded' THEN NULL WHEN final_tokens <= 0 THEN 0D "
                      "WHEN verdict = 'correct' THEN 1D / final_tokens ELSE 0D END"),
        "token_savings": F.expr("greatest(0L, full_tokens - final_tokens)"),
        "context_reduction": F.expr(
            "CASE WHEN full_tokens <= 0 THEN 0D ELSE bround(greatest(0D, 1D - final_tokens / full_tokens), 6) END"),
        "conflict_task": F.col("category").isin(*CONFLICT_CATEGORIES),
    }).drop("_n", "_first", "_declined")


def loose_answer_flag(items: DataFrame, keys: list[str], text: str, expected: str) -> DataFrame:
    """Whether the casefolded expected answer occurs anywhere in the prompt (plain substring)."""
    hit = F.expr(f"length(trim({expected})) > 0 AND contains(lower({text}), lower(trim({expected})))")
    return items.groupBy(*keys).agg(F.max(hit.cast("int")).cast("boolean").alias("answer_text_in_prompt"))

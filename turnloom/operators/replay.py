"""Replay records: what each mode chose, what its packed prompt showed, what was lost, and how the answer fared.

Everything is read from decided memories, offered chunks and packed prompts, so a fact that retrieval or a budget
lost is missing here, too. Facts are found row by row in chosen texts and prompt messages; no prompt is one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators import evalset, failures, scoring
from turnloom.operators import modes as M
from turnloom.operators.packing import Contexts
from turnloom.session import shuffled

PAIR = ["conv_id", "mode"]
CHOSEN = ["memory_items", "memory_skipped", "memory_evicted", "chunk_items", "chunk_skipped", "chunk_evicted",
          "chunk_repeats"]


def given_replies(turns: DataFrame) -> DataFrame:
    """(task_id, mode, seq, answer): the first assistant turn after the last user turn, the same for every mode.

    A conversation that ends with its user has no row, so its answers stay ungraded.
    """
    asked = turns.where("lower(role) = 'user'").groupBy("conv_id").agg(F.max("turn").alias("asked"))
    later = turns.where("lower(role) = 'assistant'").join(shuffled(asked), "conv_id").where("turn > asked")
    return later.groupBy(F.col("conv_id").alias("task_id")).agg(F.min_by(
        F.coalesce("text", F.lit("")), F.struct("turn", "text")).alias("answer")).select(
        "task_id", F.lit(None).cast("string").alias("mode"), F.lit(0).alias("seq"), "answer")


def chosen_texts(contexts: Contexts) -> DataFrame:
    """(conv_id, mode, text) of every memory and chunk that retrieval chose, whether or not the prompt had room for it."""
    return contexts.stats.select(*PAIR, F.explode(F.concat(*CHOSEN)).alias("i")).select(*PAIR, F.col("i.text").alias("text"))


def newest_mentions(history: DataFrame, tasks: DataFrame) -> DataFrame:
    """(conv_id, fact_id, back): the place from the newest of the last message that holds a fact."""
    found = scoring.detect_facts(history.select("conv_id", "back", "content"), tasks, ["conv_id", "back"], "content")
    return found.groupBy("conv_id", "fact_id").agg(F.min("back").alias("back"))


def shown_facts(tasks: DataFrame, contexts: Contexts, mentions: DataFrame) -> DataFrame:
    """(conv_id, mode, fact_id) of the packed prompts.

    A history is shown from its newest message back, so a fact is in it where its newest mention is; each message is
    searched once for all modes, and only blocks, system prompt and question mode by mode.
    """
    framed = scoring.detect_facts(contexts.frames().select(*PAIR, "content"), tasks, PAIR, "content")
    newest = contexts.stats.select(*PAIR, "history_messages_selected")
    said = newest.join(shuffled(mentions), "conv_id").where(F.col("back") <= F.col("history_messages_selected"))
    return framed.unionByName(said.select(*PAIR, "fact_id"))


def replay_records(tasks: DataFrame, contexts: Contexts, answers: DataFrame | None = None,
                   mentions: DataFrame | None = None) -> DataFrame:
    """One record per (task, mode): chosen facts, facts in the prompt, token costs and the looked-up answer.

    ``answers`` has (task_id, mode, seq, answer), a NULL mode being the row for all modes; without one the
    answer is NULL and will be ungraded. A task without messages has a record with nothing chosen. ``mentions`` has the
    ``newest_mentions`` of the history where they are written already.
    """
    chosen = scoring.detect_facts(chosen_texts(contexts), tasks, PAIR, "text")
    shown = shown_facts(tasks, contexts, newest_mentions(contexts.history, tasks) if mentions is None else mentions)
    costs = contexts.stats.select(
        *PAIR, F.col("final_context_tokens").alias("final_tokens"),
        F.col("full_context_reference_tokens").alias("full_tokens"), "selected_memory_count", "selected_chunk_count")
    rows = costs.join(shuffled(scoring.fact_sets(chosen, PAIR, "retrieved")), PAIR, "left").join(
        shuffled(scoring.fact_sets(shown, PAIR, "in_prompt")), PAIR, "left")
    if answers is None:
        rows = rows.withColumn("answer", F.lit(None).cast("string"))
    else:
        rows = scoring.look_up_answers(rows, scoring.load_answers(answers))
    # The ledgers come last, so that they are shuffled once for a task and not once for each mode.
    return rows.join(shuffled(evalset.accepted_answers(tasks)), "conv_id")


def grade(records: DataFrame, latency: str | None = None) -> DataFrame:
    """Retrieval sets, verdict, error type, faithfulness and savings of every record."""
    rows = scoring.score_retrieval(scoring.expected_abstention(records)).withColumn(
        "latency_ms", F.col(latency) if latency else F.lit(None).cast("double"))
    return scoring.score_answers(rows)


def losses(decided: DataFrame | None, contexts: Contexts) -> DataFrame:
    """(conv_id, mode, seq, reason, text): what the policy dropped, by rank, then what the prompt had no room for."""
    seq = lambda stage, place, name: F.struct(
        stage.cast("int").alias("stage"), place.cast("int").alias("place"), name.alias("id"))
    packed = contexts.dropped_items().select(
        *PAIR, seq(F.col("step") + 1, F.col("i.rank"), F.col("i.id")).alias("seq"), "reason", X.preview("i.text").alias("text"))
    if decided is None:
        return packed
    policy = decided.where("drop_reason IS NOT NULL").select(
        *PAIR, seq(F.lit(0), F.col("rn"), F.col("memory_id")).alias("seq"), F.col("drop_reason").alias("reason"),
        X.preview("text").alias("text"))
    return policy.unionByName(packed)


def attribute(graded: DataFrame, lost: DataFrame, tasks: DataFrame) -> DataFrame:
    """Failure records of graded replays, each absent fact blamed on the first loss that carried it."""
    return failures.classify(graded.join(shuffled(failures.reason_counts(lost, PAIR)), PAIR, "left").join(
        shuffled(failures.dropped_facts(lost, tasks, PAIR)), PAIR, "left"))

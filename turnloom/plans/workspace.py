"""The stage tables that many queries share, built lazily once per session and folder."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators import chunks as C
from turnloom.operators import evalset, extraction, failures, packing, replay
from turnloom.operators import modes as M
from turnloom.operators import retrieval as R
from turnloom.session import shared_folder, shuffled

AS_OF = "2024-06-01 00:00:00"
# Session and question coincide: one question per conversation.
Q = ["conv_id"]
QM = ["conv_id", "mode"]


def utc_instants(frame: DataFrame) -> DataFrame:
    """Zone-less timestamps are UTC, whatever zone the session shows."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    naive = [c for c, kind in frame.dtypes if kind == "timestamp_ntz"]
    return frame.withColumns({
        c: F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(c))) for c in naive}) if naive else frame


class Workspace:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.tag = uuid.uuid4().hex
        self._stages = f"{shared_folder(spark)}/stages-{self.tag}"

    def table(self, name: str) -> DataFrame:
        return utc_instants(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """Write a stage once to the shared folder and read it back.

        Later plans then start from a table: short lineage, column pruning, and a known
        size on which the planner decides broadcasts.
        """
        path = f"{self._stages}/{name}"
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    @cached_property
    def turns(self) -> DataFrame:
        return self.table("conversations")

    @cached_property
    def tasks(self) -> DataFrame:
        return self.keep(evalset.plan_tasks(self.turns), "tasks")

    @cached_property
    def transcript(self) -> DataFrame:
        messages = evalset.plant_transcript(self.turns, self.tasks)
        return self.keep(evalset.stamp_sessions(messages, self.tasks), "transcript")

    @cached_property
    def history(self) -> DataFrame:
        """Messages with their costs and places from the newest; every pack reads the same."""
        return self.keep(packing.history_rows(self.transcript, Q), "history")

    @cached_property
    def mentions(self) -> DataFrame:
        return self.keep(replay.newest_mentions(self.history, self.tasks), "mentions")

    @cached_property
    def questions(self) -> DataFrame:
        return self.tasks.select("conv_id", "question", X.content_tokens("question").alias("q_tokens"))

    @cached_property
    def chunks(self) -> DataFrame:
        return self.keep(C.chunk_history(self.transcript, Q), "chunks")

    @cached_property
    def top_chunks(self) -> DataFrame:
        return self.keep(C.retrieve_chunks(self.chunks, self.questions, Q), "top_chunks")

    @cached_property
    def memories(self) -> DataFrame:
        return self.keep(R.memory_features(extraction.observe(self.transcript, Q), Q), "memories")

    @cached_property
    def recalled(self) -> DataFrame:
        """Top memories per question, with the lifecycle state and signals a runtime reports."""
        found = R.recall(self.memories, self.questions, Q)
        lot = evalset.draw(F.col("conv_id") * 31 + F.col("source_turn"), 21, 16)
        tenth = lambda salt: evalset.draw(
            F.col("conv_id") * 31 + F.col("source_turn"), salt, 11) / 10.0
        signals = F.create_map(
            F.lit("lexical"), tenth(22), F.lit("semantic"), F.lit(0.0), F.lit("salience"), tenth(23),
            F.lit("recency"), tenth(24), F.lit("task_relevance"), tenth(25),
            F.lit("redundancy"), tenth(26) / 5)
        stamp = lambda text: F.to_timestamp(F.lit(text))
        turns = self.transcript.groupBy("conv_id").agg((F.count("*") + 1).alias("current_turn"))
        rows = found.join(shuffled(turns), "conv_id").join(shuffled(self.questions), "conv_id")
        return self.keep(rows.select(
            *self.memories.columns, "q_tokens", "current_turn", "position", "recall_score",
            F.when(lot == 0, "archived").otherwise("active").alias("status"),
            F.when(lot == 1, stamp("2024-01-01 00:00:00")).when(lot == 2, stamp("2025-01-01 00:00:00"))
            .alias("valid_until"),
            F.when(lot == 3, stamp("2024-05-30 12:00:00")).alias("observed_at"),
            F.lit(None).cast("timestamp").alias("created_at"),
            F.regexp_extract_all("text", F.lit("Project [A-Z][a-z]+"), F.lit(0)).alias("entities"),
            F.when(lot.between(3, 8), signals).alias("signals")), "recalled")

    @cached_property
    def reported_conflicts(self) -> DataFrame:
        """Runtime contradiction reports for half of the tasks that replace a fact."""
        pairs = self.tasks.where("category IN ('temporal', 'conflict') AND conv_id % 2 = 0").select(
            "conv_id", F.filter("facts", lambda f: f["role"] == "forbidden")[0].alias("o"),
            F.filter("facts", lambda f: f["role"] == "required")[0].alias("n"))
        known = F.col("conv_id") % 4 != 0
        return pairs.select(
            "conv_id", F.lit(1).alias("seq"), F.col("o.subject").alias("subject"),
            X.stable_id("o.text").alias("older_id"), F.lit("").alias("newer_id"),
            F.lit("").alias("older_text"), F.when(known, F.col("n.text")).otherwise("").alias("newer_text"))

    @cached_property
    def reported_stale(self) -> DataFrame:
        first = F.array_min(F.transform(
            F.filter("facts", lambda f: f["role"] == "irrelevant"),
            lambda f: F.struct(f["fact_id"].alias("id"), f["text"].alias("text"))))
        return self.tasks.where("conv_id % 5 = 0").select(
            "conv_id", X.stable_id(first["text"]).alias("memory_id"))

    def _decide(self, recalled: DataFrame, conflicts: DataFrame | None = None, stale: DataFrame | None = None) -> DataFrame:
        modes = [m for m in M.MODES if m.uses_memory]
        fields = ["mode", *R.MODE_KNOBS, "strip_temporal", "strip_lifecycle"]
        # Reports are the same for every mode, and a task has few candidates: rows meet their reports and their task before they
        # become one for each mode.
        reported = R.attach_reports(recalled, Q, conflicts, stale).repartition(*Q)
        rows = M.fan_out(reported, modes, fields)
        rows = R.strip_for_ablation(rows.withColumnsRenamed({k: "p_" + k for k in R.MODE_KNOBS}))
        return R.decide(rows, QM, as_of=F.to_timestamp(F.lit(AS_OF)))

    @cached_property
    def decided(self) -> DataFrame:
        """One row per (task, mode, candidate memory) with its fate."""
        return self.keep(self._decide(
            self.recalled, conflicts=self.reported_conflicts, stale=self.reported_stale), "decided")

    @cached_property
    def resolutions(self) -> DataFrame:
        return R.conflict_resolutions(self.decided, QM)

    @cached_property
    def contexts(self) -> packing.Contexts:
        selected = self.decided.where("drop_reason IS NULL")
        packed = packing.build_contexts(self.tasks, self.transcript, selected, self.offered_chunks, history=self.history)
        return packing.Contexts(self.keep(packed.stats, "contexts"), self.history)

    @cached_property
    def offered_chunks(self) -> DataFrame:
        return self.top_chunks

    @cached_property
    def replay_decided(self) -> DataFrame:
        """Fates of the recalled memories by their texts and turns alone: nothing is reported about them."""
        turns = self.transcript.groupBy("conv_id").agg((F.count("*") + 1).alias("current_turn"))
        found = R.recall(self.memories, self.questions, Q).join(shuffled(turns), "conv_id").join(
            shuffled(self.questions), "conv_id")
        empty = lambda kind: F.lit(None).cast(kind)
        rows = found.select(
            *self.memories.columns, "q_tokens", "current_turn", "position", "recall_score",
            empty("string").alias("status"), *[empty("timestamp").alias(c) for c in ("valid_until", "observed_at", "created_at")],
            F.regexp_extract_all("text", F.lit("Project [A-Z][a-z]+"), F.lit(0)).alias("entities"),
            empty("map<string,double>").alias("signals"))
        return self.keep(self._decide(rows), "replay_decided")

    def _pack(self, name: str, modes: list[M.Mode], memories: DataFrame | None) -> packing.Contexts:
        packed = packing.build_contexts(self.tasks, self.transcript, memories, self.top_chunks, modes=modes, history=self.history)
        return packing.Contexts(self.keep(packed.stats, f"{name}_contexts"), self.history)

    def _graded(self, name: str, contexts: packing.Contexts) -> DataFrame:
        records = replay.replay_records(self.tasks, contexts, replay.given_replies(self.turns), self.mentions)
        # Ledgers are as long as all other columns of a record together; of a record's ledger only this line is read later.
        graded = replay.grade(records).withColumn("expected_memory", F.expr(failures.expected_memory_sql()))
        return self.keep(graded.drop("facts", "accepted", "acceptable_answers"), f"{name}_replays")

    @cached_property
    def transcript_contexts(self) -> packing.Contexts:
        """Packed prompts of the modes that show turns and chunks; no memory is read for them."""
        return self._pack("transcript", [m for m in M.MODES if not m.uses_memory], None)

    @cached_property
    def memory_contexts(self) -> packing.Contexts:
        return self._pack("memory", [m for m in M.MODES if m.uses_memory],
                          self.replay_decided.where("drop_reason IS NULL"))

    @cached_property
    def replay_contexts(self) -> packing.Contexts:
        """The packed prompts of every (task, mode) over ``replay_decided`` and the retrieved chunks."""
        return packing.Contexts(self.transcript_contexts.stats.unionByName(self.memory_contexts.stats), self.history)

    @cached_property
    def replay_losses(self) -> DataFrame:
        return self.keep(replay.losses(self.replay_decided, self.replay_contexts), "replay_losses")

    @cached_property
    def transcript_replays(self) -> DataFrame:
        return self._graded("transcript", self.transcript_contexts)

    @cached_property
    def memory_replays(self) -> DataFrame:
        return self._graded("memory", self.memory_contexts)

    @cached_property
    def replays(self) -> DataFrame:
        """Graded records of every (task, mode); answers are the replies that the conversations give."""
        return self.transcript_replays.unionByName(self.memory_replays)

    @cached_property
    def replay_failures(self) -> DataFrame:
        graded = self.replays.drop("answer", "question", "expected_answer")
        return self.keep(replay.attribute(graded, self.replay_losses, self.tasks), "replay_failures")


_OPEN: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, folder: str) -> Workspace:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, folder)
    return _OPEN[key]


def close_all() -> None:
    _OPEN.clear()

"""Queries over packed contexts, budgets, retention, checks and table maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from turnloom.functions import guard as G
from turnloom.functions import text as X
from turnloom.operators import budgets, packing
from turnloom.operators import chunks as C
from turnloom.operators import modes as M
from turnloom.plans.registry import query
from turnloom.plans.workspace import Q, QM, shared_folder, workspace
from turnloom.sources import tables
from turnloom.sources.stored import StoredTable

PLAIN = [m for m in M.MODES if not m.uses_memory and not m.uses_chunks]


def _stats(contexts):
    return contexts.stats.select(*QM, *packing.STAT_FIELDS)


@query
def conversation_contexts(spark, sf):
    """The last user turn of every conversation asked of its earlier turns: chunks, window, accounting."""
    space = workspace(spark, sf)
    turns = space.turns
    asked = turns.where("lower(role) = 'user'").groupBy("conv_id").agg(
        F.max("turn").alias("asked"), F.max_by("text", "turn").alias("question"))
    messages = turns.join(asked.select("conv_id", "asked"), "conv_id").where("turn < asked").select(
        "conv_id", F.col("turn").cast("int").alias("pos"), "role", F.col("text").alias("content"))
    questions = asked.select("conv_id", X.content_tokens("question").alias("q_tokens"))
    # Scoring reads the chunks several times, so they are written once.
    chunks = space.keep(C.chunk_history(messages, Q), "asked_chunks")
    top = C.retrieve_chunks(chunks, questions, Q)
    history = space.keep(packing.history_rows(messages, Q), "asked_history")
    return _stats(packing.build_contexts(asked, messages, None, top, modes=M.MODES[:3], history=history))


@query
def context_stats(spark, sf):
    """Accounting of every (task, mode)."""
    return _stats(workspace(spark, sf).contexts)


@query
def context_stats_plain(spark, sf):
    """Accounting of the modes that use no evidence, each ceiling sized to its transcript."""
    return _stats(workspace(spark, sf).contexts).where(F.col("mode").isin(*[m.mode for m in PLAIN]))


@query
def context_evicted(spark, sf):
    """A ceiling of 300 tokens: oldest history goes first."""
    space = workspace(spark, sf)
    return _stats(packing.build_contexts(space.tasks, space.transcript, None, None, max_tokens=300, modes=PLAIN, history=space.history))


@query
def context_bare(spark, sf):
    """A ceiling below the question and system prompt: the system prompt is cut last."""
    space = workspace(spark, sf)
    packed = packing.build_contexts(space.tasks, space.transcript, None, None, max_tokens=30, modes=PLAIN, history=space.history)
    return packed.stats.select(*QM, "fitted_system", "system_tokens", "final_context_tokens", "system_truncated",
                               "exceeds_max_tokens", "history_messages_selected")


@query
def context_prompts(spark, sf):
    """Prompt messages of every (task, mode), one row per message."""
    rows = workspace(spark, sf).contexts.prompts()
    return rows.select(*QM, F.col("part").cast("long").alias("part"), F.col("pos").cast("long").alias("pos"), "role",
                       F.md5("content").alias("digest"), X.estimate_tokens("content").alias("tokens"))


@query
def context_sum_of_parts(spark, sf):
    """Invariant: final tokens equal the prompt's message costs plus overhead, per (task, mode)."""
    contexts = workspace(spark, sf).contexts
    cost = contexts.prompts().groupBy(*QM).agg(F.sum(X.estimate_tokens("content") + X.MESSAGE_OVERHEAD).alias("cost"))
    return contexts.stats.join(cost, QM).select(*QM, (F.col("cost") - F.col("final_context_tokens")).alias("gap"))


@query
def context_drops(spark, sf):
    return workspace(spark, sf).contexts.drops()


@query
def context_sections(spark, sf):
    """Prompt cost by section, every (task, mode)."""
    return workspace(spark, sf).contexts.token_breakdown()


@query
def context_modes(spark, sf):
    """Budgets of every mode as applied to every task."""
    rows = M.fan_out(workspace(spark, sf).tasks.select("conv_id"), fields=["mode", "letter", "max_recent", "memory_budget", "chunk_budget"])
    return rows.select("conv_id", "mode", "letter", F.coalesce(F.col("max_recent").cast("long"), F.lit(-1)).alias("max_recent"),
                       F.col("memory_budget").cast("long").alias("memory_budget"), F.col("chunk_budget").cast("long").alias("chunk_budget"))


@query
def context_isolated(spark, sf):
    """Only the last session of a transcript is visible under isolation."""
    rows = workspace(spark, sf).transcript
    last = rows.groupBy("conv_id").agg(F.max("session").alias("session"))
    return rows.join(last, ["conv_id", "session"], "left_semi").groupBy("conv_id").agg(
        F.count("*").alias("visible"), F.sum(X.estimate_tokens("content")).alias("tokens"))


@query
def context_inspection(spark, sf):
    """Stored memories beside what retrieval did with them in the memory mode."""
    space = workspace(spark, sf)
    fate = space.decided.where("mode = 'memory'").select("conv_id", "memory_id", "rank", "drop_reason", F.lit(True).alias("_seen"))
    return space.memories.join(fate, ["conv_id", "memory_id"], "left").select(
        "conv_id", "memory_id", "memory_type", F.expr(
            "CASE WHEN _seen IS NULL THEN 'not recalled' WHEN drop_reason IS NULL THEN 'retrieved' ELSE drop_reason END").alias("fate"))


def _requests(spark, sf):
    events = workspace(spark, sf).table("events")
    counted = X.estimate_tokens("props") * 10
    reported = F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k").cast("long"))
    return events.select("user_id", "event_id", counted.alias("prompt_tokens"),
                         budgets.charged_tokens(reported, counted).alias("charged"), (F.col("event_type") == "error").alias("failed"))


def budget_rows(spark, sf):
    return budgets.run_budget(_requests(spark, sf), ["user_id"], "event_id", max_requests=40, max_failures=8, max_total_tokens=1500)


@query
def limit_run_budget(spark, sf):
    return budget_rows(spark, sf).select("user_id", "event_id", "charged", "sent", F.coalesce("stopped_at", F.lit(-1)).alias("stopped_at"))


@query
def limit_usage_snapshot(spark, sf):
    return budgets.usage_snapshot(budget_rows(spark, sf), ["user_id"], 40, 1500)


@query
def limit_oversize_prompts(spark, sf):
    docs = workspace(spark, sf).table("documents").select("doc_id", X.estimate_tokens("text").alias("tokens"), F.length("text").alias("n"))
    return budgets.skip_oversize(docs, "tokens", 1000).select(
        "doc_id", "tokens", "skipped", (F.col("n") > budgets.MAX_MESSAGE_CHARS).alias("too_long"))


@query
def limit_planned_spend(spark, sf):
    rows = budgets.planned_spend(workspace(spark, sf).tasks)
    return rows.select("preset", *[F.col(c).cast("long").alias(c) for c in ("planned_requests", "allowed_requests", "output_token_ceiling")])


@query
def limit_first_tasks(spark, sf):
    return budgets.first_tasks(workspace(spark, sf).tasks, ["conv_id"], 20).select("conv_id", "category")


@query
def retention_sweep(spark, sf):
    events = workspace(spark, sf).table("events").select(
        F.when(F.col("user_id") % 17 == 0, F.concat(F.lit("../"), F.col("user_id").cast("string")))
        .otherwise(F.concat(F.lit("s-"), F.col("user_id").cast("string"))).alias("session"), "ts")
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    return budgets.retention_sweep(events, "session", "ts", now, 86_400, 25).select(
        "session", F.unix_micros("newest").alias("newest"), "fate")


@query
def check_constants(spark, sf):
    """A damaged comparison: missing tasks, reworded questions, a foreign prompt and two counters."""
    space = workspace(spark, sf)
    tasks = space.tasks.select(F.col("conv_id").alias("task_id"), "question")
    rows = M.fan_out(tasks, fields=["mode"]).where("NOT (mode = 'chunks' AND task_id % 10 = 3)")
    records = rows.select(
        "task_id", F.when((F.col("mode") == "memory") & (F.col("task_id") % 20 == 1), F.lit("ghost")).otherwise(F.col("mode")).alias("mode"),
        F.when((F.col("mode") == "memory") & (F.col("task_id") % 25 == 2), F.concat("question", F.lit("?"))).otherwise(F.col("question")).alias("question"),
        F.when(F.col("task_id") == 5, F.lit("Other words.")).otherwise(F.lit(packing.SYSTEM_TEXT)).alias("system_prompt"),
        F.lit("f1").alias("fingerprint"), F.lit("m").alias("served_model"),
        F.when(F.col("task_id") % 2 == 0, "a").otherwise("b").alias("counter"))
    return budgets.check_constants(records, tasks, [m.mode for m in M.MODES], packing.SYSTEM_TEXT)


@query
def check_fingerprints(spark, sf):
    events = workspace(spark, sf).table("events")
    settings = F.struct(F.col("event_type").alias("a"), (F.col("event_id") % 5).alias("b"))
    return events.groupBy(budgets.settings_fingerprint(settings).alias("fingerprint")).agg(F.count("*").alias("n"))


@query
def provenance_dataset(spark, sf):
    """Distinct categories and tiers of the set, with its size."""
    return workspace(spark, sf).tasks.agg(
        F.count("*").alias("tasks"), F.array_join(F.array_sort(F.collect_set("category")), "|").alias("categories"),
        F.array_join(F.transform(F.array_sort(F.collect_set("length_tier")), lambda v: v.cast("string")), "|").alias("tiers"))


@query
def provenance_manifest(spark, sf):
    from turnloom import __version__
    return provenance_dataset(spark, sf).select(
        "*", F.lit(__version__).alias("package_version"), F.lit(spark.version).alias("spark_version"))


@query
def provenance_file_digests(spark, sf):
    files = tables.file_digests(tables.read_files(spark, sf, "*.parquet"))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256")


@query
def source_transcript(spark, sf):
    """Every transcript in order, with the place of each turn."""
    return workspace(spark, sf).turns.select("conv_id", "turn", F.lower("role").alias("role"), F.md5("text").alias("digest"))


@query
def source_conversations(spark, sf):
    return tables.list_conversations(workspace(spark, sf).turns)


@query
def source_task_lines(spark, sf):
    """Tasks written as JSON Lines and read back under the declared schema."""
    space = workspace(spark, sf)
    path = f"{shared_folder(spark)}/tasks-{space.tag}"
    tables.write_json_lines(space.tasks.select(
        F.col("conv_id").cast("string").alias("task_id"), "category", "question", "expected_answer", "acceptable_answers",
        F.struct("required", "supporting", "forbidden", "abstention_expected").alias("evidence"), "facts"), path)
    rows = tables.read_tasks(spark, path)
    return rows.select(F.col("task_id").cast("long").alias("conv_id"), "question", F.array_join("required_fact_ids", "|").alias("required"),
                       F.size("facts").cast("long").alias("facts"))


@query
def source_quarantined_lines(spark, sf):
    """Malformed JSON lines are set aside, good ones are kept."""
    space = workspace(spark, sf)
    path = f"{shared_folder(spark)}/lines-{space.tag}"
    line = F.when(F.col("event_id") % 50 == 0, F.lit("{\"k\": ")).otherwise(F.col("props"))
    space.table("events").select(line.alias("value")).write.mode("overwrite").text(path)
    good, bad = tables.read_json_lines_quarantined(spark, path, "k int")
    return good.agg(F.count("*").alias("n"), F.sum("k").alias("total")).select(F.lit("good").alias("kind"), "n", "total").unionByName(
        bad.agg(F.count("*").alias("n")).select(F.lit("bad").alias("kind"), "n", F.lit(0).cast("long").alias("total")))


def _changes(spark, sf):
    events = workspace(spark, sf).table("events")
    return events.select("user_id", "event_type", F.unix_micros("ts").alias("stamp"), F.unix_micros("ts").alias("created"),
                         "value", F.lit(1).cast("long").alias("seen"))


@query
def sink_upsert(spark, sf):
    """Events as upserts on (user, type): the latest value, the first creation, summed counters."""
    rows = _changes(spark, sf)
    return tables.upsert(rows.where("stamp % 2 = 0"), rows.where("stamp % 2 = 1"), ["user_id", "event_type"], "stamp",
                         ["created"], ["seen"])


def _stored_events(spark, sf):
    """The changes of ``sink_upsert`` written to a stored table in three batches, one of them delivered twice."""
    rows = _changes(spark, sf)
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    stored = StoredTable(spark, path, rows.schema.simpleString()[7:-1].replace(":", " "), ["user_id", "event_type"], "stamp", ["created"], ["seen"], buckets=16)
    for part in (1, 0, 1, 2):
        stored.upsert(rows.where(f"pmod(stamp, 3) = {part}"), f"events-{part}")
    return stored


@query
def sink_stored_upsert(spark, sf):
    """A stored table after all changes came in out of order, and some twice."""
    return _stored_events(spark, sf).read()


@query
def sink_stored_rows(spark, sf):
    """The stored rows of every user who met an error, read by key after all rows of users with a purchase over 90 were taken out."""
    rows, stored = _changes(spark, sf), _stored_events(spark, sf)
    keys = rows.select("user_id", "event_type").distinct()
    doomed = rows.where("event_type = 'purchase' AND value > 90").select("user_id").distinct()
    stored.delete(keys.join(doomed, "user_id"), "doomed")
    errors = rows.where("event_type = 'error'").select("user_id").distinct()
    return stored.read_keys(keys.join(errors, "user_id"))


@query
def sink_delete(spark, sf):
    rows = _changes(spark, sf)
    doomed = rows.where("event_type = 'error' AND value > 60").select("user_id")
    return tables.delete_keys(rows, doomed, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query
def sink_session_export(spark, sf):
    """Every session's messages, memories, usage and findings as scrubbed rows, with a digest of each body."""
    space = workspace(spark, sf)
    usage = space.turns.groupBy("conv_id").agg(F.count("*").alias("requests"), F.sum(X.estimate_tokens("text")).alias("tokens"))
    security = space.turns.where(G.role_was_privileged("role")).select(
        "conv_id", "turn", F.lit("role_downgraded").alias("category"), F.col("role").alias("detail"))
    security = security.unionByName(space.memories.where("suspicious").select(
        "conv_id", F.col("source_turn").alias("turn"), F.lit("injection_detected").alias("category"), F.col("text").alias("detail")))
    rows = tables.session_export(space.turns, space.memories, usage, "conv_id", security=security)
    return rows.select("conv_id", "kind", "seq", F.md5("body").alias("digest"))

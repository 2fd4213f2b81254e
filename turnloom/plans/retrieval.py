"""Queries over extraction, recall, selection and chunk retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators import extraction, lexical
from turnloom.operators import retrieval as R
from turnloom.plans.registry import query
from turnloom.plans.workspace import Q, QM, workspace


def _six(*names):
    return [F.bround(n, 6).alias(n) for n in names]


@query
def memory_candidates(spark, sf):
    """Sentences of non-assistant turns classified by the storage rules."""
    found = extraction.candidates(workspace(spark, sf).transcript.where("role <> 'assistant'"))
    return found.select("conv_id", F.col("pos").cast("long").alias("pos"),
                        F.col("sentence_pos").cast("long").alias("sentence_pos"),
                        "sentence", "memory_type", "confidence")


@query
def memory_selected(spark, sf):
    """The first accepted candidates of each turn, from every whole document as a turn."""
    documents = workspace(spark, sf).table("documents").select("doc_id", F.col("text").alias("content"))
    found = extraction.select_candidates(extraction.candidates(documents), ["doc_id"])
    return found.select("doc_id", F.col("sentence_pos").cast("long").alias("sentence_pos"), "sentence", "memory_type", "confidence")


@query
def memory_observed(spark, sf):
    memories = workspace(spark, sf).memories
    return memories.select("conv_id", "memory_id", "text", "memory_type", "confidence", "mentions",
                           F.col("source_turn").cast("long").alias("source_turn"),
                           F.col("first_turn").cast("long").alias("first_turn"))


@query
def memory_storability(spark, sf):
    """Per task: planted statements, those that are stored, and stored memories that only given turns say."""
    space = workspace(spark, sf)
    stored = space.memories.select("conv_id", "text")
    planted = space.transcript.where("role = 'user' AND length(fact_id) > 0").select("conv_id", F.col("content").alias("text"))
    facts = planted.join(stored.withColumn("hit", F.lit(1)), ["conv_id", "text"], "left").groupBy("conv_id").agg(
        F.count("*").alias("planted"), F.count("hit").alias("stored_facts"))
    given = stored.join(planted, ["conv_id", "text"], "left_anti").groupBy("conv_id").agg(F.count("*").alias("n"))
    return facts.join(given, "conv_id", "left").select(
        "conv_id", "planted", "stored_facts", F.coalesce("n", F.lit(0)).alias("stored_given"))


@query
def memory_types_and_signals(spark, sf):
    """External type names mapped, and the numeric entries of the event properties."""
    events = workspace(spark, sf).table("events")
    raw = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("kind"), F.col("event_type"),
                       F.lit("value"), F.col("value").cast("string"))
    kinds = F.array(*[F.lit(v) for v in ["episodic", "procedural", "Goal", "decision", "belief", "other"]])
    typed = events.select(
        "event_id", extraction.app_memory_type(F.get(kinds, (F.col("event_id") % 6).cast("int"))).alias("memory_type"),
        extraction.numeric_signals(raw).alias("signals"))
    return typed.select("event_id", "memory_type", F.size("signals").cast("long").alias("n_signals"),
                        F.bround(F.element_at("signals", "k"), 6).alias("k"))


@query
def memory_new_this_turn(spark, sf):
    """Memories first stored in the second half of a transcript: after minus before."""
    space = workspace(spark, sf)
    half = space.transcript.groupBy("conv_id").agg(F.floor(F.count("*") / 2).alias("half"))
    memories = space.memories.join(half, "conv_id")
    before = memories.where("first_turn < half").select("conv_id", "memory_id")
    return memories.join(before, ["conv_id", "memory_id"], "left_anti").select("conv_id", "memory_id", "text")


@query
def memory_enriched(spark, sf):
    """External scores by id for even sessions, by text for odd ones; the first entry wins."""
    space = workspace(spark, sf)
    base = space.memories.select("conv_id", "memory_id", "text", "source_turn")
    even = F.col("conv_id") % 2 == 0
    entry = lambda seq: base.select(
        "conv_id", F.lit(seq).alias("seq"), F.when(even, F.col("memory_id")).otherwise("").alias("entry_id"),
        F.upper("text").alias("content"), (F.col("source_turn") + seq / 10.0).alias("score"),
        F.create_map(F.lit("salience"), F.lit(seq / 10.0)).alias("signals")).where("source_turn % 3 <> 1")
    return R.enrich(base, entry(2).unionByName(entry(1)), Q).select(
        "conv_id", "memory_id", F.bround("relevance", 6).alias("relevance"),
        F.bround(F.element_at("signals", "salience"), 6).alias("salience"))


@query
def memory_pairing(spark, sf):
    """Recalled strings matched with stored rows; repeated lines are used up in order."""
    docs = workspace(spark, sf).table("documents")
    stored = docs.select("lang", F.left("text", F.lit(6)).alias("text"), F.col("doc_id").alias("stored_at"),
                         F.col("doc_id").cast("string").alias("memory_id"))
    recalled = docs.where("n_chars % 2 = 0").select(
        "lang", F.left("text", F.lit(6)).alias("text"), (-F.col("doc_id")).alias("position"))
    return R.pair_recalled(recalled, stored, ["lang"]).select("lang", "position", "text", "memory_id")


@query
def memory_pairing_texts(spark, sf):
    """Every whole document recalled and matched with the stored ones; repeated texts are used up in order."""
    docs = workspace(spark, sf).table("documents")
    stored = docs.select("lang", "text", F.col("doc_id").alias("stored_at"), F.col("doc_id").cast("string").alias("memory_id"))
    recalled = docs.select("lang", "text", (-F.col("doc_id")).alias("position"))
    return R.pair_recalled(recalled, stored, ["lang"]).select("lang", "position", "text", "memory_id")


@query
def recall_top(spark, sf):
    return workspace(spark, sf).recalled.select(
        "conv_id", "memory_id", F.col("position").cast("long").alias("position"), *_six("recall_score"))


@query
def retrieval_frequencies(spark, sf):
    """Document frequency and smooth IDF per conversation and token."""
    space = workspace(spark, sf)
    rows = lexical.document_frequencies(space.chunks, Q)
    return rows.select("conv_id", "token", "df", "n_items",
                       F.bround(lexical.smooth_idf(F.col("n_items"), F.col("df")), 6).alias("idf"))


@query
def retrieval_scores(spark, sf):
    """Score parts and rank of every candidate, all modes that use memory."""
    return workspace(spark, sf).decided.where("lexical IS NOT NULL").select(
        *QM, "memory_id", F.col("rn").cast("long").alias("rn"),
        *_six("lexical", "runtime", "query_runtime", "recency", "relevance", "score"),
        F.array_join("informative", "|").alias("informative"))


@query
def retrieval_decisions(spark, sf):
    """Every candidate with its reason, detail, rank, merges and contested flag."""
    return workspace(spark, sf).decided.select(
        *QM, "memory_id", "drop_reason", "detail", F.col("rank").cast("long").alias("rank"), "contested",
        F.array_join("merged_ids", "|").alias("merged_ids"), "suspicious")


@query
def retrieval_resolutions(spark, sf):
    return workspace(spark, sf).resolutions.select(
        *QM, "subject", "left_id", "right_id", "older_id", "newer_id", "outcome")


@query
def retrieval_report(spark, sf):
    return R.retrieval_report(workspace(spark, sf).decided, QM)


@query
def retrieval_reason_counts(spark, sf):
    return workspace(spark, sf).decided.where("drop_reason IS NOT NULL").groupBy("mode", "drop_reason").agg(
        F.count("*").alias("n"))


@query
def retrieval_ablation_prep(spark, sf):
    """What each removal strips from the records before they are judged."""
    rows = workspace(spark, sf).decided
    return rows.groupBy("mode").agg(
        F.count("*").alias("n"), F.count("status").alias("with_status"), F.count("valid_until").alias("with_validity"),
        F.count_if(F.coalesce(F.map_contains_key("signals", "recency"), F.lit(False))).alias("with_recency"))


@query
def retrieval_claims(spark, sf):
    """Subject-value claims of every stored memory."""
    claims = R.extract_claims(workspace(spark, sf).memories.select("conv_id", "memory_id", "text"))
    return claims.select("conv_id", "memory_id", F.col("claim").cast("long").alias("claim"), "subject", "value",
                         F.array_join("kinds", "|").alias("kinds"))


@query
def retrieval_plain_lexical(spark, sf):
    """The form without frequencies: every document against its first sentence."""
    docs = workspace(spark, sf).table("documents").select(
        "doc_id", X.content_tokens("text").alias("tokens"),
        X.content_tokens("element_at(split(text, '\n'), 1)").alias("q"))
    return docs.select("doc_id", F.bround(lexical.plain_lexical("q", "tokens"), 6).alias("lexical"))


@query
def chunk_history(spark, sf):
    return workspace(spark, sf).chunks.select(
        "conv_id", "chunk_id", F.col("turn").cast("long").alias("turn"), "role", "text")


@query
def chunk_packing_documents(spark, sf):
    """Sentence packing over whole documents."""
    from turnloom.operators.chunks import pack_sentences
    docs = workspace(spark, sf).table("documents")
    return docs.select("doc_id", F.posexplode(pack_sentences("text")).alias("piece", "text")).select(
        "doc_id", F.col("piece").cast("long").alias("piece"), F.length("text").cast("long").alias("chars"),
        F.md5("text").alias("digest"))


@query
def chunk_top_k(spark, sf):
    return workspace(spark, sf).top_chunks.select(
        "conv_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.col("turn").cast("long").alias("turn"),
        "role", "text", F.bround("score", 6).alias("score"))

"""Memory extraction: which sentences of a turn are worth storing, and as what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import text as X

# Fixed values -----------------------------------------------------------------
GREETING = r"^(hi|hello|hey|thanks|thank you|ok|okay|yo|good morning|good evening)\b"
STATEMENT = (
    r"\b(?:is|are|was|were|has|have|had|use|uses|used|run|runs|running|"
    r"require|requires|required|need|needs|happen|happens|occur|occurs|"
    r"contain|contains|include|includes|support|supports|expire|expires|"
    r"last|lasts|take|takes|cost|costs|mean|means|start|starts|begin|begins|"
    r"end|ends|deploy|deploys|deployed|migrate|migrates|migrated|switch|switched|"
    r"move|moves|moved|schedule|scheduled|configure|configured|limit|limited|"
    r"cap|capped|retain|retains|keep|keeps|store|stores)\b")
INTERROGATIVE = (
    r"^(?:what|when|where|why|how|who|whom|whose|which|can|could|would|should|"
    r"shall|may|might|do|does|did|is|are|was|were|am|tell me|remind me|explain|"
    r"summarise|summarize|help me|i wonder|let'?s|let us|please could)\b")
FILLER = (
    r"\b(?:i am thinking|i'?m thinking|just making conversation|i wonder|"
    r"let'?s talk about|let us talk about|by the way|anyway|small talk|"
    r"chit[- ]?chat|nice weather|how are you|thanks for|thank you for)\b")
TEMPORAL = (
    r"\b(friday|monday|tuesday|wednesday|thursday|saturday|sunday|at \d{1,2}:\d{2}|"
    r"deadline|every (week|day|friday)|valid (from|until))\b")
PROJECT = r"\b(project|database|deploy|deployment|production|staging|provider)\b"
# Type, confidence, patterns that must all match; the first that holds wins.
RULES = [
    ("CORRECTION", 0.92, [r"\b(actually|correction|instead of|changed to|not\s+\w+.+\b(it's|it is|use))\b"]),
    ("PREFERENCE", 0.88, [r"\b(prefer|preference|like to|don't like|do not like|always use|never use)\b"]),
    ("CONSTRAINT", 0.86, [r"\b(must not|must|cannot|can't|required to|constraint|never)\b"]),
    ("DECISION", 0.86, [r"\b(decided|decision|we'll use|we will use|going with)\b"]),
    ("GOAL", 0.84, [r"\b(goal|objective|aim to|we need to|deadline)\b"]),
    ("TASK", 0.84, [r"\b(todo|task|please (do|implement|fix|add)|need to (implement|fix|add))\b"]),
    ("TEMPORAL_EVENT", 0.86, [TEMPORAL, STATEMENT]),
    ("PROJECT_STATE", 0.90, [PROJECT, STATEMENT]),
]
# What every match of a pattern holds in lower case: searching for it is far cheaper than the pattern.
ANCHORS = {
    FILLER: ["thinking", "just making conversation", "i wonder", "let's talk about", "lets talk about", "let us talk about", "by the way",
             "anyway", "small talk", "chit", "nice weather", "how are you", "thanks for", "thank you for"],
    TEMPORAL: ["friday", "monday", "tuesday", "wednesday", "thursday", "saturday", "sunday", "at ", "deadline", "every week", "every day",
               "every friday", "valid from", "valid until"],
    PROJECT: ["project", "database", "deploy", "production", "staging", "provider"],
    RULES[0][2][0]: ["actually", "correction", "instead of", "changed to", "not"],
    RULES[1][2][0]: ["prefer", "like to", "don't like", "do not like", "always use", "never use"],
    RULES[2][2][0]: ["must", "cannot", "can't", "required to", "constraint", "never"],
    RULES[3][2][0]: ["decided", "decision", "we'll use", "we will use", "going with"],
    RULES[4][2][0]: ["goal", "objective", "aim to", "we need to", "deadline"],
    RULES[5][2][0]: ["todo", "task", "please ", "need to "],
}
GENERAL_FACT = ("FACT", 0.80, 20)
MEMORY_TYPES = ["FACT", "PREFERENCE", "PROJECT_STATE", "DECISION", "GOAL", "TASK",
                "TEMPORAL_EVENT", "CORRECTION", "CONSTRAINT"]
RUNTIME_TYPES = {"semantic": "FACT", "episodic": "FACT", "procedural": "TASK",
                 "preference": "PREFERENCE", "goal": "GOAL", "constraint": "CONSTRAINT",
                 "reflection": "DECISION", "belief": "FACT", "fact": "FACT"}
MIN_CHARS, GREETING_CHARS = 12, 48
MIN_CONFIDENCE, MAX_PER_TURN = 0.75, 5
# ------------------------------------------------------------------------------

_I = "(?iU)"


def _matches(x: str, pattern: str) -> str:
    return f"rlike({x}, {X.lit_sql(_I + pattern)})"


def lowered_sql(x: str) -> str:
    """Lower case as matching without case sees it, letters outside ASCII that equal i, k or s included."""
    return f"lower(CASE WHEN octet_length({x}) = length({x}) THEN {x} ELSE translate({x}, 'İıſ\u212a', 'iisk') END)"


def _found(x: str, low: str, pattern: str) -> str:
    """``_matches`` where ``low`` is ``lowered_sql(x)``: ASCII needs no Unicode classes and no folding."""
    hit = f"CASE WHEN octet_length({x}) = length({x}) THEN rlike({low}, {X.lit_sql(pattern)}) ELSE {_matches(x, pattern)} END"
    if pattern not in ANCHORS:
        return f"({hit})"
    return "((" + " OR ".join(f"contains({low}, {X.lit_sql(a)})" for a in ANCHORS[pattern]) + f") AND ({hit}))"


def is_question_or_filler_sql(x: str, low: str | None = None) -> str:
    """``x`` is already stripped of surrounding white space; ``low`` is its ``lowered_sql``."""
    low = low or lowered_sql(x)
    return f"(length({x}) = 0 OR contains({x}, '?') OR {_found(x, low, INTERROGATIVE)} OR {_found(x, low, FILLER)})"


def classify_sql(x: str, low: str | None = None) -> str:
    """Struct (memory_type, confidence), NULL when no rule holds."""
    low = low or lowered_sql(x)
    body = lambda name, c: f"named_struct('memory_type', '{name}', 'confidence', {c}D)"
    arms = [f"WHEN {' AND '.join(_found(x, low, p) for p in patterns)} THEN {body(name, confidence)}"
            for name, confidence, patterns in RULES]
    name, confidence, chars = GENERAL_FACT
    arms.append(f"WHEN length({x}) >= {chars} AND {_found(x, low, STATEMENT)} THEN {body(name, confidence)}")
    return f"CASE {' '.join(arms)} END"


def candidates(turns: DataFrame, text: str = "content") -> DataFrame:
    """Every classified sentence with its place in the turn."""
    stripped = turns.withColumn("_text", F.expr(X.strip_spaces_sql(text))).where(
        f"length(_text) >= {MIN_CHARS} AND NOT (length(_text) < {GREETING_CHARS} "
        f"AND {_matches('_text', GREETING)})")
    # Sentences are judged inside the array and come out by an outer explode: a filter on the verdict would be moved below
    # and repeat the rules.
    parts = stripped.withColumn("_parts", X.split_sentences("_text")).withColumn("_said", F.expr(
        f"transform(_parts, (s, i) -> named_struct('sentence_pos', i, 'sentence', s, 'low', {lowered_sql('s')}))"))
    judged = parts.withColumn("_said", F.expr(
        "filter(transform(_said, p -> named_struct('sentence_pos', p.sentence_pos, 'sentence', p.sentence, 'c', "
        f"CASE WHEN (size(_parts) <= 1 OR length(p.sentence) >= {MIN_CHARS}) AND NOT {is_question_or_filler_sql('p.sentence', 'p.low')} "
        f"THEN {classify_sql('p.sentence', 'p.low')} END)), p -> p.c IS NOT NULL)"))
    return judged.select(*turns.columns, F.explode_outer("_said").alias("_s")).where("_s IS NOT NULL").select(
        *turns.columns, "_s.sentence_pos", "_s.sentence", "_s.c.memory_type", "_s.c.confidence")


def select_candidates(found: DataFrame, turn_keys: list[str], minimum: float = MIN_CONFIDENCE,
                      allowed: list[str] | None = None, per_turn: int = MAX_PER_TURN) -> DataFrame:
    """Confidence gate, then the first few of each turn in order."""
    allowed = allowed or MEMORY_TYPES
    accepted = found.where(
        (F.col("confidence") >= minimum) & F.col("memory_type").isin(*allowed)
        & (F.length(F.trim("sentence")) > 0))
    order = Window.partitionBy(*turn_keys).orderBy("sentence_pos")
    return accepted.withColumn("_n", F.row_number().over(order)).where(
        F.col("_n") <= per_turn).drop("_n")


def app_memory_type(raw: Column | str) -> Column:
    raw = F.trim(F.coalesce(X.col(raw), F.lit("FACT")))
    mapped = F.create_map(*[F.lit(v) for pair in RUNTIME_TYPES.items() for v in pair])
    upper = F.upper(raw)
    return F.coalesce(F.try_element_at(mapped, F.lower(raw)),
                      F.when(upper.isin(*MEMORY_TYPES), upper), F.lit("FACT"))


def numeric_signals(raw: Column) -> Column:
    """Map of text to map of double, dropping what is not a number."""
    parsed = F.transform_values(raw, lambda k, v: v.try_cast("double"))
    return F.map_filter(parsed, lambda k, v: v.isNotNull())


def observe(messages: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Memories of user turns, one row per distinct text of a session.

    A repeated statement keeps its first place and takes type, confidence and turn of
    the latest mention, as an upsert by stable id does.
    """
    spoken = messages.where("role <> 'assistant'")
    taken = select_candidates(candidates(spoken), [*keys, order])
    rows = taken.withColumn("memory_id", X.stable_id("sentence"))
    first, last = F.struct(order, "sentence_pos"), F.struct(order, "sentence_pos")
    return rows.groupBy(*keys, "memory_id").agg(
        F.first("sentence").alias("text"), F.min(first).alias("_first"),
        F.max_by("memory_type", last).alias("memory_type"),
        F.max_by("confidence", last).alias("confidence"),
        F.max(order).alias("source_turn"), F.count("*").alias("mentions"),
    ).select(*keys, "memory_id", "text", "memory_type", "confidence", "source_turn", "mentions",
             F.col("_first")[order].alias("first_turn"),
             F.col("_first.sentence_pos").alias("first_sentence"))

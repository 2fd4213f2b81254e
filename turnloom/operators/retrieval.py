"""Memory selection: eligibility, scores, repeats, conflicts, floors and caps, with reasons.

Recall bounds every group to a few rows, so the window and array steps after it hold
small groups only; recall itself scores any number of memories with grouped joins.
Each candidate stays one row from start to end and carries at most one drop reason.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import guard as G
from turnloom.functions import text as X
from turnloom.operators.lexical import (
    COVERAGE_WEIGHT, ENTITY_BONUS, PHRASE_WEIGHT, RANK_PLACES, SIMILARITY_WEIGHT, clamp,
    lexical_scores, phrase_overlap)
from turnloom.operators.prefix import running_index
from turnloom.session import shuffled

# Fixed values -----------------------------------------------------------------
INACTIVE = ["superseded", "expired", "deleted", "quarantined", "archived", "tombstoned"]
SIGNAL_WEIGHTS = {"lexical": 0.30, "semantic": 0.25, "task_relevance": 0.10, "salience": 0.15,
                  "confidence": 0.05, "recency": 0.10, "temporal_relevance": 0.05}
QUERY_SIGNAL_WEIGHTS = {"lexical": 0.60, "semantic": 0.25, "task_relevance": 0.15}
PENALTIES = {"redundancy": 0.50, "token_cost": 0.25}
TEMPORAL_SIGNALS = ["recency", "temporal_relevance"]
SUBJECT_VALUE = [
    r"(?i)^([^.?!]{2,60}?)\s+\b(?:is|are|uses|use|runs on|runs|hosted on|based on)\b\s+([^.?!]{1,60})$",
    r"(?i)^(?:we\s+|i\s+)?\b(?:migrated|switched|moved|changed|upgraded|downgraded)\b\s+"
    r"(?:the\s+|our\s+)?([^.?!]{1,50}?)\s+\bto\b\s+([^.?!]{1,50})$",
    r"^([^:=?!]{2,50}?)(?<![\d:])\s*[:=]\s*(?!\d)([^:=?!]{1,50})$",
]
VALUE_KINDS = {
    "number": r"\d",
    "proper": r"\b[A-Z][A-Za-z0-9_.+-]{2,}\b",
    "day": r"(?i)\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|"
           r"april|may|june|july|august|september|october|november|december)\b",
    "time": r"(?i)\b\d{1,2}:\d{2}\b|\b(?:utc|est|pst|cet)\b",
    "boolean": r"(?i)\b(true|false|enabled|disabled|on|off|yes|no)\b",
}
SAME_SUBJECT, SAME_VALUE = 0.6, 0.6
MAX_CLAIM_CHARS, MAX_VALUE_TOKENS = 160, 8
RECALL_LIMIT = 8
# ------------------------------------------------------------------------------


@dataclass(frozen=True)
class RetrievalPolicy:
    relevance_floor: float = 0.12
    relative_relevance_ratio: float = 0.55
    max_memories: int = 12
    near_duplicate_threshold: float = 0.88
    weight_runtime_signals: float = 0.45
    weight_lexical: float = 0.35
    weight_recency: float = 0.20
    recency_half_life_hours: float = 48.0
    recency_half_life_turns: float = 20.0
    recency_half_life_positions: float = 4.0
    max_memory_chars: int = 600
    resolve_conflicts: bool = True
    drop_stale_memories: bool = True
    heuristic_conflict_detection: bool = True
    drop_suspicious_memories: bool = False

    def __post_init__(self) -> None:
        for name in ("relevance_floor", "relative_relevance_ratio", "near_duplicate_threshold"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must be between 0 and 1")
        weights = (self.weight_runtime_signals, self.weight_lexical, self.weight_recency)
        if min(weights) < 0 or sum(weights) <= 0:
            raise ValueError("weights cannot be negative and one must be positive")
        if self.max_memories < 0:
            raise ValueError("max_memories cannot be negative")
        if min(self.recency_half_life_hours, self.recency_half_life_turns,
               self.recency_half_life_positions) <= 0:
            raise ValueError("half-lives must be greater than zero")


# Knobs a mode may override travel as columns, the rest as literals.
MODE_KNOBS = ["relevance_floor", "relative_relevance_ratio", "max_memories", "weight_recency",
              "resolve_conflicts", "drop_stale_memories", "heuristic_conflict_detection"]


def with_policy(frame: DataFrame, policy: RetrievalPolicy | None = None) -> DataFrame:
    knobs = asdict(policy or RetrievalPolicy())
    return frame.select("*", *[F.lit(knobs[k]).alias("p_" + k) for k in MODE_KNOBS])


def recall(memories: DataFrame, questions: DataFrame, keys: list[str],
           limit: int = RECALL_LIMIT) -> DataFrame:
    """The session's best memories for a question, ties in insertion order.

    ``memories`` holds any number of rows per session and carries ``tokens``.
    """
    scored = lexical_scores(memories.select(*keys, "memory_id", "tokens", "first_turn", "first_sentence"),
                            questions, keys, "memory_id")
    order = Window.partitionBy(*keys).orderBy(
        F.round("lexical", RANK_PLACES).desc(), "first_turn", "first_sentence")
    # The plain comparison lets the planner keep the best few of each task before the shuffle.
    top = scored.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= limit)
    top = top.withColumn("position", F.col("_place") - 1)
    return memories.join(shuffled(top.select(
        *keys, "memory_id", "position", F.col("lexical").alias("recall_score"))), [*keys, "memory_id"])


def eligibility(as_of: Column | None = None) -> Column:
    """Reason a record may not be scored, or NULL."""
    as_of = as_of if as_of is not None else F.current_timestamp()
    return (
        F.when(F.expr("length(" + X.strip_spaces_sql("coalesce(text, '')") + ") = 0"), "empty")
        .when(F.lower(F.trim(F.coalesce("status", F.lit("")))).isin(*INACTIVE), "stale")
        .when(F.col("valid_until") < as_of, "expired"))


def _blend(weights: dict[str, float], signals: Column, informative: Column) -> Column:
    total, mass = F.lit(0.0), F.lit(0.0)
    for name, weight in weights.items():
        value = F.try_element_at(signals, F.lit(name))
        use = value.isNotNull() & ((F.size(informative) == 0) | F.array_contains(informative, name))
        total = total + F.when(use, weight * clamp(value)).otherwise(0.0)
        mass = mass + F.when(use, F.lit(weight)).otherwise(0.0)
    return F.when(mass > 0, total / mass)


def runtime_component(signals: Column, informative: Column) -> Column:
    value = _blend(SIGNAL_WEIGHTS, signals, informative)
    for name, weight in PENALTIES.items():
        value = value - weight * clamp(
            F.coalesce(F.try_element_at(signals, F.lit(name)), F.lit(0.0)))
    return clamp(value)


def query_component(signals: Column, informative: Column) -> Column:
    return clamp(_blend(QUERY_SIGNAL_WEIGHTS, signals, informative))


def weighted_mean(parts: list[tuple[Column, Column]]) -> Column:
    """Mean over the parts that are present and carry weight."""
    total, mass = F.lit(0.0), F.lit(0.0)
    for value, weight in parts:
        use = value.isNotNull() & (weight > 0)
        total = total + F.when(use, weight * value).otherwise(0.0)
        mass = mass + F.when(use, weight).otherwise(0.0)
    return F.when(mass > 0, clamp(total / mass)).otherwise(0.0)


def recency_score(policy: RetrievalPolicy, as_of: Column) -> Column:
    """Half-life decay by the best clock: timestamp, else turn, else recall position."""
    seen = F.coalesce("observed_at", "created_at")
    age = lambda value: F.when(value.isNotNull(), F.greatest(F.lit(0.0), value.cast("double")))
    decay = lambda value, half: F.pow(F.lit(0.5), age(value) / half)
    return F.coalesce(
        decay((F.unix_micros(as_of) - F.unix_micros(seen)) / 3.6e9, policy.recency_half_life_hours),
        decay(F.col("current_turn") - F.col("source_turn"), policy.recency_half_life_turns),
        decay(F.col("position"), policy.recency_half_life_positions))


def informative_signals(alive: Column, keys: list[str]) -> Column:
    """Names non-zero for some surviving candidate of the group."""
    names = F.when(alive, F.map_keys(F.map_filter("signals", lambda k, v: v != 0)))
    return F.array_sort(F.array_distinct(F.flatten(
        F.collect_list(names).over(Window.partitionBy(*keys)))))


def extract_claims(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row per subject-value claim, in sentence order (``claim``)."""
    said = rows.select("*", F.posexplode(X.split_sentences(text)).alias("claim", "_s")).withColumn(
        "_c", F.trim(F.regexp_replace(X.strip_discourse_markers("_s"), r"^[.!?;:, ]+|[.!?;:, ]+$", "")))
    trim = lambda c: F.regexp_replace(c, r"^[ ,;]+|[ ,;]+$", "")
    options = said
    for i, pattern in enumerate(SUBJECT_VALUE):
        options = options.withColumns({
            f"_s{i}": trim(F.regexp_extract("_c", pattern, 1)),
            f"_v{i}": trim(F.regexp_extract("_c", pattern, 2))})
        options = options.withColumns({
            f"_st{i}": X.token_set(f"_s{i}"), f"_vt{i}": X.content_tokens(f"_v{i}"),
            f"_k{i}": F.array_compact(F.array(*[
                F.when(F.col(f"_v{i}").rlike(p), F.lit(k)) for k, p in VALUE_KINDS.items()]))})
    valid = [
        F.when(F.length("_c").between(1, MAX_CLAIM_CHARS) & (F.size(f"_st{i}") > 0) & (F.size(f"_vt{i}").between(1, MAX_VALUE_TOKENS))
               & (F.size(f"_k{i}") > 0) & ~F.arrays_overlap(f"_st{i}", f"_vt{i}"),
               F.struct(F.col(f"_s{i}").alias("subject"), F.col(f"_v{i}").alias("value"),
                        F.col(f"_k{i}").alias("kinds"), F.col(f"_st{i}").alias("subject_tokens"),
                        F.array_distinct(f"_vt{i}").alias("value_tokens")))
        for i in range(len(SUBJECT_VALUE))]
    # Exploding drops the sentences without a claim and keeps the expressions evaluated once.
    return options.select(*rows.columns, "claim", F.explode(F.array_compact(F.array(
        F.coalesce(*valid)))).alias("_v")).select(*rows.columns, "claim", "_v.*")


def memory_features(memories: DataFrame, keys: list[str], max_chars: int = 600) -> DataFrame:
    """Everything about a memory that no question changes, computed once per memory.

    Adds its tokens, guarded text with the guard's audit, and its claims; selection then
    works on arrays alone.
    """
    rows = G.neutralize(memories.withColumn("tokens", X.content_tokens("text")), "text", max_chars)
    rows = rows.select(
        *memories.columns, "tokens", F.col("_g.text").alias("guarded"), "_g.suspicious", "_g.families",
        "_g.neutralized")
    rows = rows.withColumn("norm", X.normalize_text("guarded"))
    rows = rows.withColumn("guarded_tokens", X.content_tokens("guarded")).withColumn(
        "replaces", F.expr(X.any_phrase_sql("norm", X.CORRECTION_MARKERS)) | (F.col("memory_type") == "CORRECTION"))
    claims = extract_claims(rows.select(*keys, "memory_id", "guarded"), "guarded").groupBy(
        *keys, "memory_id").agg(F.sort_array(F.collect_list(F.struct(
            "claim", "subject", "kinds", "subject_tokens", "value_tokens"))).alias("claims"))
    return rows.join(shuffled(claims), [*keys, "memory_id"], "left").withColumn(
        "claims", F.coalesce("claims", F.expr(f"cast(array() AS {_CLAIMS})")))


_CLAIMS = ("array<struct<claim:int,subject:string,kinds:array<string>,subject_tokens:array<string>,"
           "value_tokens:array<string>>>")


def _jaccard_sql(a: str, b: str) -> str:
    return (f"CASE WHEN size(array_union({a}, {b})) = 0 THEN 1D ELSE "
            f"size(array_intersect({a}, {b})) / size(array_union({a}, {b})) END")


def group_lexical(rows: DataFrame, keys: list[str], alive: str) -> DataFrame:
    """Lexical score against the group's surviving candidates, for small groups.

    Same measure as ``lexical_scores``; the few token sets of a group travel in a window
    array, so no join is needed.
    """
    peers = F.collect_list(F.when(F.expr(alive), F.array_distinct("tokens"))).over(Window.partitionBy(*keys))
    idf = "ln(1D + size(_sets) / (1D + size(filter(_sets, s -> array_contains(s, t)))))"
    total = lambda terms: f"aggregate({terms}, 0D, (acc, t) -> acc + {idf})"
    rows = rows.withColumn("_sets", peers).withColumn("_named", X.token_set("array_join(entities, ' ')"))
    rows = rows.withColumns({
        "_shared": F.expr(total("array_intersect(q_tokens, tokens)")), "_wanted": F.expr(total("array_distinct(q_tokens)")),
        "_union": F.expr(total("array_union(q_tokens, tokens)")),
        "_entity": F.expr(total("array_intersect(_named, q_tokens)") + " / nullif(" + total("_named") + ", 0D)")})
    score = (COVERAGE_WEIGHT * F.col("_shared") / F.col("_wanted")
             + SIMILARITY_WEIGHT * F.col("_shared") / F.col("_union")
             + PHRASE_WEIGHT * phrase_overlap("q_tokens", "tokens")
             + ENTITY_BONUS * F.coalesce("_entity", F.lit(0.0)))
    empty = F.expr("size(q_tokens) = 0 OR size(tokens) = 0")
    return rows.withColumn("lexical", F.when(F.expr(alive), F.when(empty, F.lit(0.0)).otherwise(clamp(score)))).drop(
        "_sets", "_named", "_shared", "_wanted", "_union", "_entity")


def score_candidates(candidates: DataFrame, keys: list[str], policy: RetrievalPolicy,
                     as_of: Column) -> DataFrame:
    """Eligibility, score parts and rank of every candidate."""
    rows = candidates.withColumn("drop_reason", eligibility(as_of))
    rows = rows.withColumn("informative", informative_signals(F.col("drop_reason").isNull(), keys))
    rows = group_lexical(rows, keys, "drop_reason IS NULL")
    has = F.coalesce(F.size("signals"), F.lit(0)) > 0
    weights = [F.lit(policy.weight_runtime_signals), F.lit(policy.weight_lexical)]
    rows = rows.withColumns({
        "runtime": F.when(has, runtime_component(F.col("signals"), F.col("informative"))),
        "query_runtime": F.when(has, query_component(F.col("signals"), F.col("informative"))),
        "recency": recency_score(policy, as_of)})
    rows = rows.withColumns({
        "relevance": weighted_mean([(F.col("query_runtime"), weights[0]), (F.col("lexical"), weights[1])]),
        "score": weighted_mean([(F.col("runtime"), weights[0]), (F.col("lexical"), weights[1]),
                                (F.col("recency"), F.col("p_weight_recency"))])})
    order = Window.partitionBy(*keys).orderBy(
        F.col("drop_reason").isNotNull(), F.round("score", RANK_PLACES).desc(), "position", "memory_id")
    return rows.withColumn("rn", F.row_number().over(order)).withColumn(
        "detail", F.lit(None).cast("string"))


def _peers(rows: DataFrame, keys: list[str], fields: list[str], condition: str = "drop_reason IS NULL") -> DataFrame:
    """Add the group's surviving rows in rank order as ``_peers``."""
    row = F.when(F.expr(condition), F.struct("rn", *fields))
    return rows.withColumn("_peers", F.sort_array(F.collect_list(row).over(Window.partitionBy(*keys))))


def merge_repeats(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Greedy repeats in rank order: same token list, or near enough to a kept one."""
    rows = _peers(rows, keys, ["memory_id", "guarded_tokens"])
    alike = f"k.tokens = x.guarded_tokens OR {_jaccard_sql('k.tokens', 'x.guarded_tokens')} >= {threshold}D"
    walk = (
        "aggregate(_peers, cast(array() AS array<struct<id:string,tokens:array<string>,"
        "m:struct<id:string,exact:boolean>>>), (acc, x) -> concat(acc, array(named_struct("
        "'id', x.memory_id, 'tokens', x.guarded_tokens, 'm', get(transform("
        f"filter(acc, k -> k.m IS NULL AND ({alike})), "
        "k -> named_struct('id', k.id, 'exact', k.tokens = x.guarded_tokens)), 0)))))")
    rows = rows.withColumn("_walk", F.expr(walk)).withColumn(
        "_m", F.expr("CASE WHEN drop_reason IS NULL THEN get(filter(_walk, w -> w.id = memory_id), 0).m END"))
    return rows.withColumns({
        "merged_ids": F.expr("transform(filter(_walk, w -> w.m.id = memory_id), w -> w.id)"),
        "detail": F.expr("CASE WHEN _m IS NOT NULL THEN concat(CASE WHEN _m.exact THEN 'exact' ELSE 'near' END, "
                         "' duplicate of ', _m.id) ELSE detail END"),
        "drop_reason": F.expr("CASE WHEN _m IS NOT NULL THEN 'duplicate' ELSE drop_reason END"),
    }).drop("_peers", "_walk", "_m")


def attach_reports(candidates: DataFrame, keys: list[str], conflicts: DataFrame | None,
                   stale: DataFrame | None) -> DataFrame:
    """Join outside reports to the candidates they may name, before anything is ranked.

    ``conflicts`` has (keys, seq, subject, older_id, newer_id, older_text, newer_text) and
    is matched by id and by normalised text; ``stale`` has (keys, memory_id).
    """
    kind = "array<struct<seq:int,subject:string,older_id:string,newer_id:string,newer_norm:string>>"
    rows = candidates
    if conflicts is None:
        rows = rows.selectExpr("*", f"cast(array() AS {kind}) AS _by_id", f"cast(array() AS {kind}) AS _by_text")
    else:
        found = conflicts.withColumn("newer_norm", X.normalize_text("newer_text")).withColumn(
            "older_norm", X.normalize_text("older_text"))
        report = F.sort_array(F.collect_list(F.struct("seq", "subject", "older_id", "newer_id", "newer_norm"))).cast(kind)
        by_id = found.where("length(older_id) > 0").groupBy(*keys, F.col("older_id").alias("memory_id")).agg(
            report.alias("_by_id"))
        by_text = found.where("length(older_norm) > 0").groupBy(*keys, F.col("older_norm").alias("norm")).agg(
            report.alias("_by_text"))
        rows = rows.join(shuffled(by_id), [*keys, "memory_id"], "left").join(shuffled(by_text), [*keys, "norm"], "left")
        rows = rows.withColumns({c: F.expr(f"coalesce({c}, cast(array() AS {kind}))") for c in ("_by_id", "_by_text")})
    if stale is None:
        return rows.withColumn("_stale", F.lit(False))
    named = stale.select(*keys, "memory_id").distinct().withColumn("_stale", F.lit(True))
    return rows.join(shuffled(named), [*keys, "memory_id"], "left").withColumn("_stale", F.coalesce("_stale", F.lit(False)))


def apply_reports(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Reported contradictions, then reported staleness; the last report on a memory wins."""
    rows = _peers(rows, keys, ["memory_id", "norm"])
    first_of_text = "get(filter(_peers, p -> p.norm = norm), 0).memory_id = memory_id"
    mine = (f"concat(_by_id, CASE WHEN {first_of_text} THEN filter(_by_text, r -> NOT exists(_peers, "
            "p -> p.memory_id = r.older_id)) ELSE filter(_by_text, r -> false) END)")
    newer = ("coalesce(get(filter(_peers, p -> p.memory_id = r.newer_id), 0).memory_id, "
             "get(filter(_peers, p -> length(r.newer_norm) > 0 AND p.norm = r.newer_norm), 0).memory_id)")
    rows = rows.withColumn("_reports", F.expr(
        "CASE WHEN drop_reason IS NULL AND p_resolve_conflicts THEN array_sort(transform("
        f"{mine}, r -> named_struct('seq', r.seq, 'newer', {newer}, 'subject', r.subject))) END"))
    rows = rows.withColumn("_last", F.expr(
        "get(reverse(filter(_reports, r -> r.newer IS NOT NULL)), 0)"))
    stale = "drop_reason IS NULL AND _last IS NULL AND _stale AND p_drop_stale_memories"
    return rows.withColumns({
        "reported_contested": F.expr("coalesce(exists(_reports, r -> r.newer IS NULL), false)"),
        "reported_newer": F.expr("transform(filter(_reports, r -> r.newer IS NOT NULL), r -> r.newer)"),
        "detail": F.expr(
            "CASE WHEN _last IS NOT NULL THEN concat('superseded by ', _last.newer, ' (subject=', "
            "coalesce(nullif(_last.subject, ''), 'unknown'), ', source=runtime)') "
            f"WHEN {stale} THEN 'reported stale by runtime (subject=unknown, source=runtime)' ELSE detail END"),
        "drop_reason": F.expr(
            f"CASE WHEN _last IS NOT NULL THEN 'superseded' WHEN {stale} THEN 'stale' ELSE drop_reason END"),
    }).drop("_peers", "_reports", "_last", "_by_id", "_by_text", "_stale")


def _first_claim_sql() -> str:
    """Subject of the first claim of ``l`` that some claim of ``r`` contradicts."""
    fits = (f"arrays_overlap(a.kinds, b.kinds) AND arrays_overlap(a.subject_tokens, b.subject_tokens) AND "
            f"{_jaccard_sql('a.subject_tokens', 'b.subject_tokens')} >= {SAME_SUBJECT}D AND "
            f"NOT arrays_overlap(a.value_tokens, b.value_tokens) AND "
            f"{_jaccard_sql('a.value_tokens', 'b.value_tokens')} < {SAME_VALUE}D")
    return f"get(filter(%s, a -> exists(%s, b -> {fits})), 0).subject"


def apply_claim_conflicts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Resolve or flag claim conflicts among a group's survivors (column ``pairs``).

    A pair drops its older memory only when the newer one says it replaces something;
    otherwise both stay and are contested. Position never counts as age.
    """
    on = "p_resolve_conflicts AND p_heuristic_conflict_detection"
    rows = rows.withColumn("seen", F.coalesce("observed_at", "created_at"))
    rows = _peers(rows, keys, ["memory_id", "claims", "seen", "source_turn", "replaces", "reported_newer"],
                  f"drop_reason IS NULL AND {on}")
    subject = _first_claim_sql()
    found = (f"CASE WHEN rn < p.rn THEN {subject % ('claims', 'p.claims')} "
             f"ELSE {subject % ('p.claims', 'claims')} END")
    older = ("CASE WHEN seen < p.seen THEN memory_id WHEN p.seen < seen THEN p.memory_id "
             "WHEN source_turn < p.source_turn THEN memory_id WHEN p.source_turn < source_turn THEN p.memory_id END")
    pair = ("named_struct('l_rn', least(rn, p.rn), 'r_rn', greatest(rn, p.rn), 'peer', p.memory_id, 'peer_rn', p.rn, "
            f"'subject', {found}, 'older', {older}, 'peer_replaces', p.replaces)")
    rows = rows.withColumn("_pairs", F.expr(
        f"CASE WHEN drop_reason IS NULL AND {on} THEN filter(transform(filter(_peers, p -> p.rn <> rn "
        "AND NOT array_contains(p.reported_newer, memory_id) AND NOT array_contains(reported_newer, p.memory_id)), "
        f"p -> {pair}), q -> q.subject IS NOT NULL) END"))
    rows = rows.withColumn("pairs", F.expr(
        "array_sort(transform(_pairs, q -> named_struct('l_rn', q.l_rn, 'r_rn', q.r_rn, 'peer', q.peer, "
        "'peer_rn', q.peer_rn, 'subject', q.subject, 'older', q.older, 'outcome', "
        "CASE WHEN q.older IS NULL THEN 'unordered' "
        "WHEN CASE WHEN q.older = memory_id THEN q.peer_replaces ELSE replaces END THEN 'superseded' "
        "ELSE 'contested' END)))"))
    rows = rows.withColumn("_loss", F.expr(
        "get(reverse(filter(pairs, q -> q.outcome = 'superseded' AND q.older = memory_id)), 0)"))
    return rows.withColumns({
        "contested": F.expr("reported_contested OR coalesce(exists(pairs, q -> q.outcome <> 'superseded'), false)"),
        "detail": F.expr("CASE WHEN _loss IS NOT NULL THEN concat('superseded by ', _loss.peer, ' (subject=', "
                         "_loss.subject, ', source=heuristic)') ELSE detail END"),
        "drop_reason": F.expr("CASE WHEN _loss IS NOT NULL THEN 'superseded' ELSE drop_reason END"),
    }).drop("_peers", "_pairs", "_loss", "seen")


def conflict_resolutions(decided: DataFrame, keys: list[str]) -> DataFrame:
    """One row per conflicting pair found by claims, ranked left before right."""
    return decided.select(*keys, "memory_id", "rn", F.explode("pairs").alias("q")).where("q.peer_rn > rn").select(
        *keys, "q.subject", F.col("memory_id").alias("left_id"), F.col("q.peer").alias("right_id"),
        F.col("q.older").alias("older_id"),
        F.expr("CASE WHEN q.older = memory_id THEN q.peer WHEN q.older IS NOT NULL THEN memory_id END").alias("newer_id"),
        F.col("q.outcome").alias("outcome"))


def apply_floors_and_cap(rows: DataFrame, keys: list[str], policy: RetrievalPolicy) -> DataFrame:
    """Absolute and relative relevance floors, then suspicion and the cap."""
    group = Window.partitionBy(*keys)
    alive = F.col("drop_reason").isNull()
    # A floor compares the same noise-free number that ranks do.
    rows = rows.withColumn("_rel", F.round("relevance", RANK_PLACES)).withColumn(
        "_best", F.max(F.when(alive, F.round("relevance", RANK_PLACES))).over(group))
    rows = rows.withColumn("drop_reason", (
        F.when(~alive, F.col("drop_reason"))
        .when(F.col("_rel") < F.col("p_relevance_floor"), "low_relevance")
        .when(F.col("_rel") < F.round(F.col("_best") * F.col("p_relative_relevance_ratio"), RANK_PLACES),
              "weak_relevance")
        .when(F.lit(policy.drop_suspicious_memories) & F.col("suspicious"), "suspicious"))).drop("_rel", "_best")
    place = F.sum(F.col("drop_reason").isNull().cast("int")).over(group.orderBy("rn"))
    return rows.withColumn("rank", place).withColumn("drop_reason", F.expr(
        "CASE WHEN drop_reason IS NULL AND p_max_memories > 0 AND rank > p_max_memories THEN 'cap' "
        "ELSE drop_reason END")).withColumn("rank", F.expr("CASE WHEN drop_reason IS NULL THEN rank END"))


def select_memories(candidates: DataFrame, keys: list[str], policy: RetrievalPolicy | None = None,
                    as_of: Column | None = None, conflicts: DataFrame | None = None,
                    stale: DataFrame | None = None) -> DataFrame:
    """The whole chain: one decided row per candidate.

    ``candidates`` carries (keys, q_tokens, current_turn, position, the record columns, the
    columns of ``memory_features`` and the policy columns ``p_*``); groups are as small as
    recall leaves them. Every step is a window on the keys, so rows shuffle once.
    """
    return decide(attach_reports(candidates, keys, conflicts, stale), keys, policy, as_of)


def decide(reported: DataFrame, keys: list[str], policy: RetrievalPolicy | None = None,
           as_of: Column | None = None) -> DataFrame:
    """``select_memories`` for candidates to which ``attach_reports`` has joined what was reported."""
    policy = policy or RetrievalPolicy()
    as_of = as_of if as_of is not None else F.current_timestamp()
    rows = score_candidates(reported, keys, policy, as_of)
    rows = merge_repeats(rows, keys, policy.near_duplicate_threshold)
    rows = apply_claim_conflicts(apply_reports(rows, keys), keys)
    return apply_floors_and_cap(rows, keys, policy)


def retrieval_report(decided: DataFrame, keys: list[str]) -> DataFrame:
    """Per-question counts of what each stage removed."""
    count = lambda *reasons: F.count_if(F.coalesce(
        F.col("drop_reason").isin(*reasons), F.lit(False)))
    kept = F.col("drop_reason").isNull()
    return decided.groupBy(*keys).agg(
        F.count("*").alias("candidate_count"), count("empty").alias("empty_count"),
        count("duplicate").alias("duplicate_count"), count("stale", "expired").alias("stale_count"),
        count("superseded").alias("conflict_count"),
        count("low_relevance", "weak_relevance").alias("low_relevance_count"),
        count("cap", "suspicious").alias("cap_count"), F.count_if(kept).alias("selected_count"),
        (F.count_if(kept & F.col("suspicious")) + count("suspicious")).alias("suspicious_count"),
        F.count_if("suspicious").alias("suspicious_candidate_count"))


def enrich(memories: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Attach score and signals by id, else by normalised text; the first entry wins.

    ``evidence`` has (keys, seq, entry_id, content, score, signals).
    """
    body = F.struct("score", "signals")
    by_id = evidence.where("length(entry_id) > 0").groupBy(
        *keys, F.col("entry_id").alias("memory_id")).agg(F.min_by(body, "seq").alias("_id"))
    by_text = evidence.where("length(content) > 0").groupBy(
        *keys, X.normalize_text("content").alias("_norm")).agg(F.min_by(body, "seq").alias("_text"))
    joined = (
        memories.withColumn("_norm", X.normalize_text("text"))
        .join(by_id, [*keys, "memory_id"], "left").join(by_text, [*keys, "_norm"], "left")
        .withColumn("_e", F.coalesce("_id", "_text")))
    return joined.select(
        *[c for c in memories.columns if c not in ("relevance", "signals")],
        F.col("_e.score").alias("relevance"), F.col("_e.signals").alias("signals"))


def pair_recalled(recalled: DataFrame, memories: DataFrame, keys: list[str]) -> DataFrame:
    """Match recalled strings with stored records; equal texts are used up in order.

    Whole texts are told apart by their SHA-256, and only the digests are numbered and paired. Repeats are numbered along
    ``stored_at`` and ``position`` (integers) by split running totals, so a text with a third of all rows is many tasks.
    """
    by = [*keys, "_digest", "_n"]
    said = recalled.withColumn("_digest", F.sha2("text", 256))
    rest = [c for c in recalled.columns if c != "text"]
    numbered = running_index(said.drop("text"), [*keys, "_digest"], "position", "_n")
    stored = memories.select(*keys, "stored_at", "memory_id", F.sha2("text", 256).alias("_digest"))
    stored = running_index(stored, [*keys, "_digest"], "stored_at", "_n").select(*by, "memory_id")
    paired = numbered.join(stored, by, "left").select(*rest, "_digest", "memory_id")
    texts = said.select("_digest", "text").dropDuplicates(["_digest"])
    return paired.join(texts, "_digest", "left").select(*recalled.columns, "memory_id")


def strip_for_ablation(rows: DataFrame) -> DataFrame:
    """Per-mode preparation: without temporal signals, or without lifecycle state."""
    temporal = F.map_filter("signals", lambda k, v: ~k.isin(*TEMPORAL_SIGNALS))
    return rows.withColumns({
        "signals": F.when(F.col("strip_temporal"), temporal).otherwise(F.col("signals")),
        "status": F.when(~F.col("strip_lifecycle"), F.col("status")),
        "valid_until": F.when(~F.col("strip_lifecycle"), F.col("valid_until"))})

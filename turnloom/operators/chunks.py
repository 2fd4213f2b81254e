"""Transcript chunks: sentence packing, numbering, and top-k retrieval without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import guard as G
from turnloom.functions import text as X
from turnloom.operators.lexical import RANK_PLACES, lexical_scores
from turnloom.operators.prefix import running_index
from turnloom.session import cut_lineage, shuffled

CHUNK_CHARS = 400
GUARD_CHARS = 1200
NEAR_DUPLICATE = 0.88
# So many of the best chunks of a group are walked in one row; a group that needs more goes on in rounds.
FRONT = 32


def pack_sentences(text: str, limit: int = CHUNK_CHARS) -> Column:
    """Fill pieces up to ``limit`` characters; a longer sentence stays whole."""
    fits = f"length(acc.open) + 1 + length(s) <= {limit}"
    return F.expr(
        f"aggregate({X.sentences_sql(text)}, "
        "named_struct('done', cast(array() AS array<string>), 'open', ''), "
        "(acc, s) -> named_struct("
        f"'done', CASE WHEN length(acc.open) = 0 OR {fits} THEN acc.done "
        "ELSE concat(acc.done, array(acc.open)) END, "
        f"'open', CASE WHEN length(acc.open) = 0 THEN s WHEN {fits} THEN concat(acc.open, ' ', s) ELSE s END), "
        "acc -> CASE WHEN length(acc.open) = 0 THEN acc.done ELSE concat(acc.done, array(acc.open)) END)")


def chunk_history(messages: DataFrame, keys: list[str], order: str = "pos",
                  text: str = "content", limit: int = CHUNK_CHARS) -> DataFrame:
    """(keys, chunk_id, turn, role, text, tokens) for every piece with lexical content."""
    pieces = messages.select(
        *keys, F.col(order).alias("turn"), X.coerce_role("role").alias("role"),
        F.posexplode(pack_sentences(text, limit)).alias("piece", "text"))
    pieces = pieces.withColumn("tokens", X.content_tokens("text")).where(F.size("tokens") > 0)
    numbered = running_index(pieces, keys, "turn", "_n", ["piece"])
    return numbered.select(
        *keys, F.concat(F.lit("chunk-"), F.col("_n").cast("string")).alias("chunk_id"),
        "turn", "role", "text", "tokens")


def retrieve_chunks(chunks: DataFrame, questions: DataFrame, keys: list[str], top_k: int = 6,
                    min_score: float = 0.0, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """The top-k chunks per group, most relevant first, skipping restatements."""
    scored = lexical_scores(chunks, questions, keys, "chunk_id").where(
        F.col("lexical") >= min_score)
    return greedy_top_k(scored, keys, top_k, threshold)


def greedy_top_k(scored: DataFrame, keys: list[str], top_k: int, threshold: float) -> DataFrame:
    """Walk each group by (score desc, turn, chunk id), keeping what nothing kept resembles.

    Chunks that the guard would empty are out from the start. Of the rest, those with one token set always fall
    together, so only the first of each set is carried past the partial aggregation; a group of mostly
    copies shrinks before the shuffle. The first ``FRONT`` of a group are walked in one row. A group of which they do not
    give ``top_k``, though it has more, goes through rounds of "best remaining, then drop what resembles it", each
    a grouped minimum and a join with one row per group, so no group of any size meets in one task.
    """
    rank = F.struct((-F.round("lexical", RANK_PLACES)).alias("neg"), "turn", "chunk_id")
    body = F.struct("role", "text", "lexical", F.array_distinct("tokens").alias("tokens"))
    same = F.sha2(F.array_join(F.sort_array(F.array_distinct("tokens")), " "), 256) if threshold > 0 else F.col("chunk_id")
    usable = scored.where(F.expr(G.survives_guard_sql("text")))
    pool = (usable.select(*keys, rank.alias("r"), body.alias("b"), same.alias("_set"))
            .groupBy(*keys, "_set").agg(F.min(F.struct("r", "b")).alias("c"))
            .select(*keys, "c.r", "c.b.*"))
    ahead = Window.partitionBy(*keys).orderBy("r")
    front = pool.withColumn("_n", F.row_number().over(ahead)).where(F.col("_n") <= FRONT + 1).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("r", "role", "lexical", "tokens", "text"))).alias("_f"))
    alike = f"x.r = y.r OR {jaccard_sql('x.tokens', 'y.tokens')} >= {threshold}D" if threshold > 0 else "x.r = y.r"
    walk = (f"aggregate(slice(_f, 1, {FRONT}), slice(_f, 1, 0), (acc, x) -> CASE WHEN size(acc) >= {top_k} "
            f"OR exists(acc, y -> {alike}) THEN acc ELSE concat(acc, array(x)) END)")
    # NULL keys meet nothing in a join, so of rows without a key only the best is taken, by rounds as well as here.
    named = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    walked = cut_lineage(front.withColumn("_k", F.expr(walk)).select(
        *keys, F.expr(f"CASE WHEN {named} THEN _k ELSE slice(_k, 1, 1) END").alias("_k"),
        F.expr(f"{named} AND size(_f) > {FRONT} AND size(_k) < {top_k}").alias("_more")))
    done = walked.where("NOT _more").select(*keys, F.posexplode("_k").alias("_i", "k"))
    found = _picks(done, keys, "_i").withColumn("rank", (F.col("_i") + 1).cast("int")).drop("_i")
    left = walked.where("_more").select(*keys)
    if left.isEmpty():
        return found
    rest = cut_lineage(pool.join(shuffled(left), keys, "left_semi"))
    return found.unionByName(_rounds(rest, keys, top_k, threshold))


def _rounds(pool: DataFrame, keys: list[str], top_k: int, threshold: float) -> DataFrame:
    found = None
    for number in range(1, top_k + 1):
        best = pool.groupBy(*keys).agg(F.min_by(
            F.struct("r", "role", "lexical", "tokens", "text"), "r").alias("k"))
        rows = _picks(best, keys).withColumn("rank", F.lit(number))
        found = rows if found is None else found.unionByName(rows)
        if number == top_k:
            break
        alike = X.jaccard(F.col("tokens"), F.col("k.tokens")) >= threshold
        same = F.col("r") == F.col("k.r")
        pool = cut_lineage(
            pool.join(shuffled(best), keys).where(~same & ~(alike & F.lit(threshold > 0)))
            .select(*pool.columns))
    return found


def jaccard_sql(a: str, b: str) -> str:
    return (f"CASE WHEN size(array_union({a}, {b})) = 0 THEN 1D ELSE "
            f"size(array_intersect({a}, {b})) / size(array_union({a}, {b})) END")


def _picks(best: DataFrame, keys: list[str], *rest: str) -> DataFrame:
    keys = [*keys, *rest]
    rows = best.select(
        *keys, F.col("k.r.chunk_id").alias("chunk_id"), F.col("k.r.turn").alias("turn"),
        F.col("k.role").alias("role"), F.col("k.lexical").alias("score"), F.col("k.text").alias("_text"))
    return G.neutralize(rows, "_text", GUARD_CHARS).select(
        *keys, "chunk_id", "turn", "role", "score", F.col("_g.text").alias("text"),
        F.col("_g.suspicious").alias("suspicious"), F.col("_g.families").alias("families"),
        F.col("_g.neutralized").alias("neutralized"))

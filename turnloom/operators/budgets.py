"""Run and session ceilings, usage snapshots, retention sweeps and comparison checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators import modes as M
from turnloom.operators.prefix import running_total

# Fixed values -----------------------------------------------------------------
PRESETS = {
    "quick": dict(modes=3, trials=1, max_tasks=20, max_requests=60, max_input_tokens=16_000,
                  max_output_tokens=512, max_total_tokens=250_000, max_generation_failures=5),
    "standard": dict(modes=5, trials=1, max_tasks=100, max_requests=500, max_input_tokens=64_000,
                     max_output_tokens=1024, max_total_tokens=5_000_000, max_generation_failures=10),
    "research": dict(modes=5, trials=3, max_tasks=500, max_requests=7_500, max_input_tokens=200_000,
                     max_output_tokens=2048, max_total_tokens=100_000_000, max_generation_failures=25)}
MAX_MESSAGE_CHARS = 8_000
SAFE_ID = r"^[A-Za-z0-9_-][A-Za-z0-9._-]{0,127}$"
# ------------------------------------------------------------------------------


def charged_tokens(reported: Column, counted: Column) -> Column:
    return F.greatest(F.lit(0), F.coalesce(reported, counted)).cast("long")


def run_budget(requests: DataFrame, keys: list[str], order: str, max_requests: int | None = None,
               max_failures: int | None = None, max_total_tokens: int | None = None) -> DataFrame:
    """Requests a run may send: in order, until the first that would break a ceiling.

    ``requests`` has (keys, order, prompt_tokens, charged, failed); adds ``stopped_at`` and
    ``sent``. The cut is the smallest position where a ceiling breaks, so no row waits for
    the one before it.
    """
    rows = running_total(requests, keys, order, F.col("charged"), "_spent")
    rows = running_total(rows, keys, order, F.col("failed").cast("long"), "_failed")
    rows = running_total(rows, keys, order, F.lit(1).cast("long"), "_sent")
    before_tokens = F.col("_spent") - F.col("charged")
    before_failed = F.col("_failed") - F.col("failed").cast("long")
    stop = F.lit(False)
    if max_requests is not None:
        stop = stop | (F.col("_sent") > max_requests)
    if max_failures is not None:
        stop = stop | (before_failed >= max_failures)
    if max_total_tokens is not None:
        stop = stop | (before_tokens >= max_total_tokens) | (
            before_tokens + F.greatest(F.lit(0), "prompt_tokens") > max_total_tokens)
    cuts = rows.where(stop).groupBy(*keys).agg(F.min(order).alias("stopped_at"))
    # NULL keys are a group of their own here, too.
    cuts = cuts.select("stopped_at", *[F.col(k).alias(f"_cut_{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_cut_{i}"))
    rows = rows.drop("_spent", "_failed", "_sent").join(cuts, same, "left").drop(*[f"_cut_{i}" for i in range(len(keys))])
    return rows.withColumn("sent", F.col("stopped_at").isNull() | (F.col(order) < F.col("stopped_at")))


def usage_snapshot(sent: DataFrame, keys: list[str], max_requests: int, max_tokens: int) -> DataFrame:
    usage = sent.groupBy(*keys).agg(
        F.count_if("sent").alias("requests"), F.coalesce(F.sum(F.when(F.col("sent"), F.col("charged"))), F.lit(0)).alias("tokens"),
        F.count_if(~F.col("sent")).alias("refused"), F.count_if(F.col("sent") & F.col("failed")).alias("failures"))
    left = lambda limit, used: F.greatest(F.lit(0), F.lit(limit) - F.col(used)).cast("long")
    return usage.withColumns({
        "remaining_requests": left(max_requests, "requests"), "remaining_tokens": left(max_tokens, "tokens"),
        "within_limits": (F.col("requests") <= max_requests) & (F.col("tokens") <= max_tokens)})


def skip_oversize(prompts: DataFrame, tokens: str, max_input_tokens: int) -> DataFrame:
    return prompts.withColumn("skipped", F.col(tokens) > max_input_tokens)


def planned_spend(tasks: DataFrame) -> DataFrame:
    """Planned requests and worst-case output for every preset, for the tasks at hand."""
    rows = F.array(*[F.struct(
        F.lit(name).alias("preset"), F.lit(p["modes"]).alias("modes"), F.lit(p["trials"]).alias("trials"),
        F.lit(p["max_tasks"]).alias("max_tasks"), F.lit(p["max_requests"]).alias("max_requests"),
        F.lit(p["max_output_tokens"]).alias("max_output_tokens")) for name, p in PRESETS.items()])
    have = tasks.agg(F.count("*").alias("available"))
    spread = have.select("available", F.explode(rows).alias("p")).select("available", "p.*")
    planned = F.least("available", "max_tasks") * F.col("modes") * F.col("trials")
    return spread.withColumn("planned_requests", planned).withColumns({
        "allowed_requests": F.least("planned_requests", "max_requests"),
        "output_token_ceiling": F.col("planned_requests") * F.col("max_output_tokens")})


def first_tasks(tasks: DataFrame, order: list[str], limit: int) -> DataFrame:
    return tasks.orderBy(*order).limit(limit)


def retention_sweep(activity: DataFrame, session: str, stamp: str, now: Column, max_age_seconds: int,
                    limit: int) -> DataFrame:
    """Fate of every session: kept, expired (oldest first, up to the limit), waiting or skipped."""
    rows = activity.groupBy(session).agg(F.max(stamp).alias("newest"))
    age = (F.unix_micros(now) - F.unix_micros("newest")) / 1e6
    usable = F.col(session).cast("string").rlike(SAFE_ID)
    rows = rows.withColumn("fate", F.when(~usable, "skipped").when(age > max_age_seconds, "expired").otherwise("kept"))
    first = rows.where("fate = 'expired'").orderBy("newest", session).limit(limit).select(session, F.lit(True).alias("_go"))
    return rows.join(first, session, "left").select(
        session, "newest", F.when((F.col("fate") == "expired") & F.col("_go").isNull(), "waiting")
        .otherwise(F.col("fate")).alias("fate"))


def check_constants(records: DataFrame, tasks: DataFrame, modes: list[str], system_text: str) -> DataFrame:
    """Violations of the controlled comparison, one row each; none means it was controlled.

    ``records`` has (task_id, mode, question, system_prompt, fingerprint, served_model, counter).
    """
    row = lambda frame, rule, subject: frame.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))
    several = lambda name: row(
        records.agg(F.count_distinct(name).alias("n")).where("n > 1"), f"{name} differs", F.col("n"))
    wanted = tasks.select("task_id").withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    have = records.select("task_id", "mode").distinct()
    prefix = F.startswith(F.lit(system_text), F.regexp_replace("system_prompt", "[ …]+$", ""))
    parts = [
        row(have.where(~F.col("mode").isin(*modes)).select("mode").distinct(), "unplanned mode", F.col("mode")),
        row(wanted.join(have, ["task_id", "mode"], "left_anti").groupBy("mode").agg(F.count("*").alias("n")),
            "mode misses tasks", F.concat_ws(":", "mode", F.col("n").cast("string"))),
        row(records.groupBy("task_id").agg(F.count_distinct("question").alias("n")).where("n > 1"),
            "question differs", F.col("task_id")),
        row(records.where(~prefix).select("system_prompt").distinct(), "foreign system prompt", F.sha2("system_prompt", 256)),
        several("system_prompt"), several("fingerprint"), several("served_model"), several("counter")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def settings_fingerprint(settings: Column) -> Column:
    """First 16 hex digits over the settings' JSON; give the fields in sorted order."""
    return F.left(F.sha2(F.to_json(settings), 256), F.lit(16))

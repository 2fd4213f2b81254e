"""Readers and writers for task sets, answers, run artefacts, transcripts and memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import guard as G
from turnloom.sources import parts

TASK_SCHEMA = (
    "task_id string, category string, question string, expected_answer string, "
    "conversation array<struct<role:string,content:string,session:int>>, "
    "required_fact_ids array<string>, required_memory_ids array<string>, conversation_length int, "
    "acceptable_answers array<string>, session_count int, "
    "facts array<struct<fact_id:string,text:string,fact_type:string,introduced_turn:int,markers:array<string>,"
    "subject:string,value:string,supersedes:string,superseded_by:string,session_index:int>>, "
    "evidence struct<required:array<string>,supporting:array<string>,forbidden:array<string>,"
    "abstention_expected:boolean>, metadata map<string,string>")
ANSWER_SCHEMA = "task_id string, mode string, answer string"


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task set from JSON Lines: blank lines are skipped, a malformed line fails the read."""
    rows = spark.read.schema(TASK_SCHEMA).option("mode", "FAILFAST").json(path)
    return rows.withColumn("required_fact_ids", F.coalesce(
        "required_fact_ids", "required_memory_ids", "evidence.required")).drop("required_memory_ids")


def read_json_lines_quarantined(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the malformed lines with the file they came from."""
    lines = spark.read.text(path).where("length(trim(value)) > 0").select(
        F.col("_metadata.file_name").alias("file"), "value",
        F.from_json("value", schema + ", _corrupt_record string", {
            "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    broken = F.col("r._corrupt_record").isNotNull()
    return lines.where(~broken).select("r.*").drop("_corrupt_record"), lines.where(broken).select("file", F.col("value").alias("line"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answer records in file order (``seq``), ready for ``load_answers``."""
    rows = spark.read.schema(ANSWER_SCHEMA).option("mode", "FAILFAST").json(path)
    return rows.select("*", F.struct("_metadata.file_path", F.monotonically_increasing_id()).alias("seq"))


ARTIFACT_SCHEMA = (
    "mode string, label string, trial int, config struct<mode:string,trial:int>, "
    "scores array<map<string,string>>, task_results array<struct<task_id:string,scores:map<string,string>>>, "
    "modes array<struct<mode:string,label:string,trial:int,scores:array<map<string,string>>>>")


def read_run_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Three artefact shapes (experiment, single run, mode result) as (mode, trial, score) rows."""
    raw = spark.read.schema(ARTIFACT_SCHEMA).option("multiLine", "true").json(path)
    experiments = raw.where("modes IS NOT NULL").select(F.explode("modes").alias("m")).select(
        "m.mode", F.coalesce("m.trial", F.lit(0)).alias("trial"), F.explode("m.scores").alias("score"))
    single = raw.where("modes IS NULL").select(
        F.coalesce("config.mode", "mode").alias("mode"), F.coalesce("trial", "config.trial", F.lit(0)).alias("trial"),
        F.explode(F.when(F.size("scores") > 0, F.col("scores")).otherwise(
            F.transform("task_results", lambda r: r["scores"]))).alias("score"))
    return experiments.unionByName(single)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a path with size and digest; version-control and bytecode folders left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.where(~F.col("path").rlike(r"/(\.git|__pycache__)/"))


def file_digests(files: DataFrame) -> DataFrame:
    """SHA-256 of files of ``read_files``. Large ones go by parts, except those that Spark unpacks by their name."""
    digest = lambda rows: rows.select("path", "length", F.sha2("content", 256).alias("sha256"))
    if not parts.resumable():
        return digest(files)
    spark = files.sparkSession
    large = files.where(F.col("length") > parts.PART_BYTES).select("path", "length", F.col("_metadata.file_path").alias("uri")).collect()
    rows = digest(files.where(F.col("length") <= parts.PART_BYTES))
    packed = [f.path for f in large if parts.PACKED.search(f.path)]
    if packed:
        rows = rows.unionByName(digest(spark.read.format("binaryFile").load([parts.literal(p) for p in packed])))
    plain = [f for f in large if not parts.PACKED.search(f.path)]
    if plain:
        rows = rows.unionByName(parts.digests_by_parts(spark, plain))
    return rows


def read_transcript(turns: DataFrame, conversation: int) -> DataFrame:
    return turns.where(F.col("conv_id") == conversation).orderBy("turn")


def list_conversations(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id").distinct()


def append_transcript(rows: DataFrame, path: str, partition: str, metadata: str = "metadata") -> None:
    """Append turns partitioned by session bucket, with secret-named metadata removed."""
    rows.withColumn(metadata, G.strip_secret_fields(F.col(metadata))).write.mode("append").partitionBy(partition).parquet(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def upsert(current: DataFrame, updates: DataFrame, keys: list[str], order: str, keep_first: list[str],
           counters: list[str] = ()) -> DataFrame:
    """Key-wise latest row; ``keep_first`` columns stay as first written, counters add up."""
    rows = current.unionByName(updates)
    rest = [c for c in rows.columns if c not in (*keys, *keep_first, *counters, order)]
    return rows.groupBy(*keys).agg(
        F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest],
        *[F.min_by(c, order).alias(c) for c in keep_first], *[F.sum(c).alias(c) for c in counters])


def delete_keys(rows: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(doomed.select(*keys).distinct(), keys, "left_anti")


def session_export(turns: DataFrame, memories: DataFrame, usage: DataFrame, key: str,
                   runs: DataFrame | None = None, security: DataFrame | None = None) -> DataFrame:
    """Rows of one long export per session, kind by kind and in order, secrets scrubbed.

    ``runs`` has (key, run, mode, final_tokens), ``security`` (key, turn, category, detail); either may be left out.
    Long form keeps any session's size out of a single row; write it partitioned by session. Texts are redacted before
    they are quoted, so that no pattern runs over the quotes. NULL fields are left out of a body.
    """
    body = lambda frame, kind, order, *fields: frame.select(
        key, F.lit(kind).alias("kind"), F.col(order).cast("long").alias("seq"), F.to_json(F.struct(*fields)).alias("body"))
    clean = lambda name: G.redact_patterns(name).alias(name)
    rows = body(turns, "message", "turn", "role", clean("text"))
    rows = rows.unionByName(body(memories, "memory", "source_turn", "memory_type", clean("text")))
    rows = rows.unionByName(body(usage, "usage", "requests", "requests", "tokens"))
    if runs is not None:
        rows = rows.unionByName(body(runs, "run", "run", "mode", "final_tokens"))
    if security is not None:
        rows = rows.unionByName(body(security, "security", "turn", "category", clean("detail")))
    return rows

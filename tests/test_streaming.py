import pytest
from pyspark.sql import functions as F

from turnloom.operators import budgets, extraction, retrieval, supersession
from turnloom.sources.stored import StoredTable
from turnloom.streaming import jobs


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def run(spark, frame, name, mode, tmp_path):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_observed_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame(
        [("s", i, "user", t) for i, t in enumerate(["Actually, we changed to MySQL 8.", "What do we use?",
                                                    "You must encrypt every backup. Thanks!"])],
        "session string, pos int, role string, content string")
    for i in (0, 1):
        rows.where(f"pos % 2 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.observe_into(stream, ["session"], "pos", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = extraction.select_candidates(extraction.candidates(rows), ["session", "pos"])
    pick = lambda f: sorted((r.pos, r.sentence, r.memory_type) for r in f.collect())
    assert pick(got) == pick(want) and got.count() == 2


def test_session_budget_equals_batch(rocks, tmp_path):
    rows = rocks.createDataFrame([("s", i, 10, False) for i in range(5)] + [("t", i, 30, i == 3) for i in range(5)],
                                 "session string, seq long, charged long, reset boolean")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = run(rocks, jobs.session_budget(stream, 3, 60), "budget", "update", tmp_path).collect()
    allowed = {(r.session, r.seq): r.allowed for r in got}
    batch = budgets.run_budget(
        rows.where("session = 's'").selectExpr("session", "seq", "charged AS prompt_tokens", "charged", "false AS failed"),
        ["session"], "seq", max_requests=3)
    assert {("s", r.seq): r.sent for r in batch.collect()}.items() <= allowed.items()
    assert [allowed[("t", i)] for i in range(5)] == [True, True, False, True, True]


def test_ledger_counts_all_and_keeps_the_last(rocks, tmp_path):
    rows = rocks.createDataFrame([("s", i, "injection") for i in range(70)], "session string, seq long, category string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = run(rocks, jobs.security_ledger(stream), "ledger", "update", tmp_path).collect()
    assert [(r.total, r.kept, r.oldest_kept) for r in got] == [(70, 50, 20)]


def test_idle_sessions_and_repeats(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", 1, "2024-01-01 00:00:00"), ("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-01 00:05:00"),
         ("b", 3, "2024-01-02 00:00:00")], "s string, id int, t string").select("s", "id", F.to_timestamp("t").alias("t"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    once = run(spark, jobs.without_repeats(stream(), ["s", "id"], "t", "1 day"), "once", "append", tmp_path)
    assert sorted(r.id for r in once.collect()) == [1, 2, 3]
    idle = run(spark, jobs.idle_sessions(stream(), "s", "t", "10 minutes", "1 hour"), "idle", "append", tmp_path).collect()
    assert [(r.s, r.events) for r in idle] == [("a", 3)]


SAID = ["The production database is PostgreSQL 16.", "The cache runs on Redis 7.", "Actually, the production database is MySQL 8.", "I prefer short answers in reports.",
        "Correction: the production database is MariaDB 11.", "Actually, the cache runs on Valkey 8.", "The production database is PostgreSQL 16."]


def test_supersession_stream_equals_batch_in_any_order(rocks, tmp_path):
    rows = rocks.createDataFrame([(s, f"{s}{i}", i, t, "FACT") for s in ("a", "b") for i, t in enumerate(SAID)],
                                 "session string, memory_id string, seen long, text string, memory_type string")
    memories = retrieval.memory_features(rows, ["session"]).select("session", "memory_id", "seen", "replaces", "claims")
    want = sorted(tuple(r) for r in supersession.superseded(memories, ["session"]).collect())
    assert ("a", "a0", "a2", "production database") in [(s, o, n, sub.lower().removeprefix("the ")) for s, o, n, sub in want]
    assert not any(n.endswith("6") for _, _, n, _ in want) and len(want) >= 6
    kept = memories.cache()
    for part in (2, 0, 1, 0):  # out of order, one file twice
        kept.where(f"seen % 3 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema(memories.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(rocks, jobs.supersession(stream), "superseded", "append", tmp_path)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_observed_table_equals_batch_whatever_the_order_of_files(spark, tmp_path):
    said = ["You must encrypt every backup. Thanks!", "Actually, we changed to MySQL 8.", "You must encrypt every backup.", "What do we use?"]
    rows = spark.createDataFrame([(s, i, "user", t) for s in ("s", "t") for i, t in enumerate(said)], "session string, pos int, role string, content string")
    for i in (2, 0, 1, 3):
        rows.where(f"pos = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stored = StoredTable(spark, str(tmp_path / "table"), f"session string, {jobs.MEMORY_SCHEMA}", ["session", "memory_id"], "source_turn", ["first_turn"], ["mentions"], buckets=4)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.observe_into_table(stream, ["session"], "pos", stored, str(tmp_path / "cp")).awaitTermination(200)
    columns = ["session", "memory_id", "text", "memory_type", "confidence", "source_turn", "first_turn", "mentions"]
    pick = lambda f: sorted(tuple(r) for r in f.select(*columns).collect())
    assert pick(stored.read()) == pick(extraction.observe(rows, ["session"])) and stored.read().count() == 4

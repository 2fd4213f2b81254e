import pytest

from turnloom.sources.stored import StoredTable

SCHEMA = "s string, m string, stamp long, created long, text string, seen long"


def table(spark, tmp_path, **more):
    return StoredTable(spark, str(tmp_path / "t"), SCHEMA, ["s", "m"], "stamp", ["created"], ["seen"], buckets=8, **more)


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def held(stored):
    return sorted((tuple(r) for r in stored.read().collect()), key=str)


def test_upserts_keep_first_and_latest_and_ignore_repeated_batches(spark, tmp_path):
    stored = table(spark, tmp_path)
    assert held(stored) == [] and stored.version() == 0
    assert stored.upsert(rows(spark, ("a", "1", 5, 5, "new", 1), (None, "1", 1, 1, "none", 1)), "b0")
    late = rows(spark, ("a", "1", 3, 3, "old", 1), ("b", "2", 9, 9, None, 2))
    assert stored.upsert(late, "b1") and not stored.upsert(late, "b1") and stored.version() == 2
    assert held(stored) == sorted([("a", "1", 5, 3, "new", 2), ("b", "2", 9, 9, None, 2), (None, "1", 1, 1, "none", 1)], key=str)
    assert not stored.upsert(rows(spark), "b1") and stored.upsert(rows(spark), "empty") and len(held(stored)) == 3
    assert [r.text for r in stored.read_keys(spark.createDataFrame([(None, "1"), ("zz", "1")], "s string, m string")).collect()] == ["none"]


def test_a_write_that_breaks_off_before_the_commit_loses_nothing(spark, tmp_path, monkeypatch):
    stored = table(spark, tmp_path)
    stored.upsert(rows(spark, *[("a", str(i), i, i, "x", 1) for i in range(40)]), "b0")
    before = held(stored)
    with monkeypatch.context() as broken:
        broken.setattr(StoredTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("executor lost")))
        with pytest.raises(OSError):
            stored.upsert(rows(spark, ("a", "7", 99, 99, "y", 1)), "b1")
    assert held(stored) == before
    assert stored.upsert(rows(spark, ("a", "7", 99, 99, "y", 1)), "b1")
    assert [r for r in held(stored) if r[1] == "7"] == [("a", "7", 99, 7, "y", 2)] and len(held(stored)) == 40


def test_only_touched_buckets_are_rewritten_and_deletes_empty_them(spark, tmp_path):
    stored = table(spark, tmp_path)
    stored.upsert(rows(spark, *[("a", str(i), i, i, "x", 1) for i in range(60)]), "b0")
    old = stored._folders()
    stored.upsert(rows(spark, ("a", "3", 99, 99, "y", 1)), "b1")
    assert len(old) == 8 and sum(stored._folders()[b] != old[b] for b in old) == 1
    doomed = spark.createDataFrame([("a", str(i)) for i in range(60) if i != 3], "s string, m string")
    assert stored.delete(doomed, "b2") and not stored.delete(doomed, "b2")
    assert [r[1] for r in held(stored)] == ["3"]
    assert stored.upsert(rows(spark, ("a", "4", 1, 1, "z", 1))) and [r[1] for r in held(stored)] == ["3", "4"]

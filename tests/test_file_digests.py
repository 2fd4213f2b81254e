"""Digests of files: small ones whole, large ones by parts, both equal to hashlib's."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from turnloom.sources import parts, tables

PART = 4000


def contents() -> dict[str, bytes]:
    draw = random.Random(7)
    noise = draw.randbytes(20_000)
    return {
        "small.bin": noise[:900], "part.bin": noise[:PART], "over.bin": noise[: PART + 1], "noise.bin": noise,
        "ends.bin": noise + b"\n", "ends twice.bin": noise + b"\n\n", "feeds.bin": b"\n" * 9001, "none.bin": noise.replace(b"\n", b""),
        "mark.bin": parts.BOM + noise, "mark%20ends.bin": parts.BOM + noise + b"\n", "two marks.bin": parts.BOM * 2 + noise,
        "zeros.bin": bytes(30_000), "run.bin": noise[:9000] + bytes(13_000) + noise[:9000], "dos.txt": b"one\r\n\rtwo\r\n" * 2000,
        "a/noise.bin": noise[::-1], "k=1/[x]{y}*+?.bin": noise[1:], "a/.git/left.bin": noise, 
        "cut.bin": noise[: PART - 1] + b"\n" + noise[:PART] + b"\n" + noise,
    }


@pytest.fixture
def small_parts(spark, monkeypatch):
    """Files above PART go by parts, and a row of more bytes fails the read, as one of 2 GB would."""
    monkeypatch.setattr(parts, "PART_BYTES", PART)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", PART)
    yield
    spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def write(folder, files: dict[str, bytes]) -> dict[str, tuple[int, str]]:
    for name, content in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content)
    return {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items() if ".git/" not in n}


def digests(spark, folder) -> dict[str, tuple[int, str]]:
    rows = tables.file_digests(tables.read_files(spark, str(folder))).collect()
    found = {r.path.split(f"{folder}/", 1)[1]: (r.length, r.sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def test_no_row_holds_a_large_file_and_digests_are_those_of_whole_files(spark, tmp_path, small_parts):
    settings = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum")
    before = [spark.conf.get(name, None) for name in settings]
    expected = write(tmp_path, contents())
    assert digests(spark, tmp_path) == expected
    assert [spark.conf.get(name, None) for name in settings] == before


def test_parts_are_bounded_and_hold_every_byte_once(spark, tmp_path, small_parts, monkeypatch):
    monkeypatch.setattr(parts, "shared_folder", lambda spark: str(tmp_path / "shared"))
    noise = contents()["noise.bin"]
    expected = write(tmp_path / "in", {"a.bin": noise, "b.bin": noise[::-1], "c.bin": noise[:100]})
    assert digests(spark, tmp_path / "in") == expected
    kept = spark.read.parquet(str(next((tmp_path / "shared").iterdir()))).collect()
    longest = max(map(len, noise.split(b"\n")))
    assert len({(r.uri, r.start) for r in kept}) == len(kept) >= 2 * len(noise) // (PART + longest)
    assert max(r.bytes for r in kept) <= PART + longest + 1
    assert sorted(b"".join(r.content for r in kept)) == sorted(noise * 2)


def test_files_that_the_reader_unpacks_are_read_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parts, "PART_BYTES", PART)
    noise = contents()["noise.bin"]
    expected = write(tmp_path, {"lines[1].txt.gz": gzip.compress(noise), "noise.bin": noise, "small.bin": noise[:9]})
    assert digests(spark, tmp_path) == expected
    listed = tables.read_files(spark, str(tmp_path), "noise.bin").select("path", "length", F.col("_metadata.file_path").alias("uri")).first()
    rows = [Row(path=listed.path, length=listed.length + 2, uri=listed.uri)]
    with pytest.raises(ValueError, match="changed"):
        parts.digests_by_parts(spark, rows)


def test_without_openssl_files_are_read_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parts, "PART_BYTES", PART)
    monkeypatch.setattr(parts, "resumable", lambda: False)
    monkeypatch.setattr(parts, "digests_by_parts", None)
    expected = write(tmp_path, {"noise.bin": contents()["noise.bin"]})
    assert digests(spark, tmp_path) == expected


def test_a_state_goes_on_where_it_was_left():
    state = None
    for piece in (b"", b"a" * 63, b"b" * 130, b"c"):
        state = parts.update(state, piece)
    assert parts.final(state) == hashlib.sha256(b"a" * 63 + b"b" * 130 + b"c").hexdigest()

"""SHA-256 of files larger than a task should read: the state of the digest goes on from part to part."""

from __future__ import annotations

import _hashlib
import ctypes
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from turnloom.session import shared_folder

PART_BYTES = 32 << 20
# The text reader unpacks files of these names, so they can't be read by parts.
PACKED = re.compile(r"\.(gz|bz2|deflate|snappy|lz4|lzo|zst|zstd|xz)$", re.IGNORECASE)
BOM = b"\xef\xbb\xbf"
# OpenSSL's SHA256_CTX takes 112 bytes and holds no pointers.
STATE_BYTES = 128


def _openssl() -> ctypes.CDLL:
    """The OpenSSL that ``hashlib`` is bound to; it gives the state between two updates, which ``hashlib`` keeps."""
    return ctypes.CDLL(_hashlib.__file__)


def resumable() -> bool:
    return hasattr(_openssl(), "SHA256_Update")


def update(state: bytes | None, content: bytes) -> bytes:
    """The state of a SHA-256 after some more bytes; None is the state before the first."""
    openssl, held = _openssl(), ctypes.create_string_buffer(state or b"", STATE_BYTES)
    if state is None:
        openssl.SHA256_Init(held)
    openssl.SHA256_Update(held, content, ctypes.c_size_t(len(content)))
    return held.raw


def final(state: bytes) -> str:
    out = ctypes.create_string_buffer(32)
    _openssl().SHA256_Final(out, ctypes.create_string_buffer(state, STATE_BYTES))
    return out.raw.hex()


def literal(path: str) -> str:
    """A path that readers take as it stands, not as a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of (uri, start, value) as one row for each split; all lines but a file's first bring the line feed before them."""
    split, pieces = None, []

    def part() -> pa.RecordBatch:
        content = b"\n".join(pieces if split[1] == 0 else [b"", *pieces])
        return pa.RecordBatch.from_pydict({
            "uri": [split[0]], "start": pa.array([split[1]], pa.int64()), "bytes": pa.array([len(content)], pa.int64()), "content": [content]})

    for batch in batches:
        uris, starts, lines = batch.columns
        place = lambda i: (uris[i].as_py(), starts[i].as_py())
        at, end = 0, batch.num_rows
        while at < end:
            # A split's lines come together, so most batches are of the split that their last line is of.
            now = place(at)
            to = end if place(end - 1) == now else next(i for i in range(at + 1, end) if place(i) != now)
            if now != split:
                if split is not None:
                    yield part()
                split, pieces = now, []
            run = pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), lines.slice(at, to - at))
            pieces.append(pc.binary_join(run, b"\n")[0].as_py())
            at = to
    if split is not None:
        yield part()


def _go_on(states: dict[str, bytes], marked: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                state = states.get(uri) or (update(None, BOM) if uri in marked else None)
                yield pa.RecordBatch.from_pydict({"uri": [uri], "state": [update(state, content.as_py())]})
    return run


def digests_by_parts(spark: SparkSession, files: list[Row]) -> DataFrame:
    """(path, length, sha256) of files given as (path, length, uri), which no task reads whole.

    A first job cuts the files at line feeds near every ``PART_BYTES`` and writes the parts to the shared folder. Then
    one job for each place takes the parts of that place of all files, a row each, on from the states after the parts
    before them. A part is larger only by a run of bytes without a line feed. The reader drops a byte order mark and
    does not tell whether the last line ended in a line feed; the length of a file does.
    """
    path = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"
    with _settings(spark, {"spark.sql.files.maxPartitionBytes": str(PART_BYTES), "spark.sql.files.minPartitionNum": "1"}):
        lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(sorted({literal(f.path) for f in files}))
        parts = lines.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("start"),
                             F.col("value").cast("binary").alias("content"))
        schema = "uri string, start long, bytes long, content binary"
        parts.mapInArrow(_gather, schema).write.partitionBy("start").option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
        parts = spark.read.schema(schema).parquet(path)
        found = parts.select("uri", "start", "bytes").collect()
        # What the lines lack of their file: the last line feed, a byte order mark, or both.
        lacks = {f.uri: f.length for f in files}
        for part in found:
            lacks[part.uri] -= part.bytes
        if changed := [f.path for f in files if lacks[f.uri] not in (0, 1, len(BOM), 1 + len(BOM))]:
            raise ValueError(f"changed while they were read, or unpacked by the reader: {changed[:5]}")
        states, marked = {}, {uri for uri, n in lacks.items() if n >= len(BOM)}
        for start in sorted({part.start for part in found}):
            here = parts.where(F.col("start") == start).select("uri", "content")
            states |= {r.uri: bytes(r.state) for r in here.mapInArrow(_go_on(states, marked), "uri string, state binary").collect()}
    ended = {uri: final(update(state, b"\n") if lacks[uri] in (1, 1 + len(BOM)) else state) for uri, state in states.items()}
    return spark.createDataFrame(pa.table({"path": [f.path for f in files], "length": [f.length for f in files], "sha256": [ended[f.uri] for f in files]}))

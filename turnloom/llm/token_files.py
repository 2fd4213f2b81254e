"""Token ids in binary files: byte planes of fixed-size blocks, zstandard, and a chunk index.

A file is: MAGIC; for each block of BLOCK ids its byte planes (plane p holds byte p of every id; a
plane of zeros is left out), each compressed by itself; the index, compressed; the length of the
compressed index as unsigned 64-bit; MAGIC. The index has, for each block, its place in the
file, its number of ids and the size of each plane, and for each document its id and number of ids.
A reader may fetch any block through the index without the rest.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import column, keep, scratch, small_batches

MAGIC = b"TLPLANE1"
BLOCK = 1 << 16
PLANES = 4
CACHED_WORDS, CACHED_LENGTH = 400_000, 64
# A run of these after a letter is a word of its own to the tokenizer; no contraction and no added token has them after its last letter.
STOPS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
OTHER_STOP = re.compile(r"[.,](?<![a-z\u00df-\u00f6\u00f8-\u00ff][.,]) ").search  # after no letter
PLAIN = re.compile(rf"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]{{1,{CACHED_LENGTH}}}").fullmatch


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder named by a path or a URI (``file:/x`` as Spark writes it, too)."""
    if folder.startswith("file:"):
        folder = "/" + folder[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(folder)


class WordEncoder:
    """Encodes whole texts with a tokenizer whose white space only separates; repeated words are looked up.

    Exact for BPE tokenizers that drop white space and mark the end of words (as word_bpe_49k). A text is cut at
    blanks and line feeds alone, as no rule looks across those. Stops after a last letter are a word of their own to the
    tokenizer. New words of letters are encoded many at a time, and told apart by the marked ends. Latin-1 texts are lower-cased first.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], np.uint32).tobytes()
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.recent: dict[str, bytes] = {}  # words met in one batch not long ago

    def _each(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, np.uint32).tobytes() for x in found]

    def _together(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of plain letters."""
        out: dict[str, bytes] = {}
        for at in range(0, len(words), 256):
            some = words[at:at + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(some) or ends[-1] != len(ids) * 4:
                out.update(zip(some, self._each(some)))
                continue
            data, begin = ids.tobytes(), 0
            for word, end in zip(some, ends.tolist()):
                out[word] = data[begin:end]
                begin = end
        return out

    def _new(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not known."""
        # These letters stay letters of their own in all normal forms and in lower case.
        plain = set(filter(PLAIN, words))
        known, recent, stopped, rest = self.known, self.recent, [], set()
        for word in words.difference(plain):
            bare = word.rstrip(STOPS)
            if bare and bare[-1].isalpha() and bare != word:
                stopped.append((word, bare, word[len(bare):]))
            else:
                rest.add(word)
        parts = {part for _, *two in stopped for part in two if part not in known and part not in recent}
        bares = set(filter(PLAIN, parts))
        found = self._together(list(plain | bares))
        rest |= parts.difference(bares)
        found.update(zip(rest, self._each(list(rest))))
        extra = parts.difference(words)
        for word, *two in stopped:
            found[word] = b"".join([found[x] if x in found else known[x] if x in known else recent[x] for x in two])
        for part in extra:
            del found[part]
        return found

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > CACHED_WORDS:
            self.known = {"": b""}
        if len(self.recent) > CACHED_WORDS:
            self.recent = {}
        known, recent, cut = self.known, self.recent, [_eased(text or "").split(" ") for text in texts]
        missing = set().union(*cut).difference(known)
        # Only words that come again are worth their place.
        again = missing & recent.keys()
        for word in again:
            known[word] = recent.pop(word)
        new = self._new(missing - again) if missing else {}
        known.update(new)
        out = [b"".join(map(known.__getitem__, words)) + self.end for words in cut]
        for word in new:
            del known[word]
        recent.update((word, ids) for word, ids in new.items() if len(word) <= CACHED_LENGTH)
        return out


def _eased(text: str) -> str:
    """A text of the same ids with blanks for line feeds and, if no normal form and no added token is at stake, in lower case and with
    blanks before stops at the end of words."""
    text = text.replace("\n", " ")
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    text = text.lower()
    return text if OTHER_STOP(text) else text.replace(". ", " . ").replace(", ", " , ")


@lru_cache(maxsize=1)
def shared_encoder(path: str, end_id: int) -> WordEncoder:
    """One encoder for all tasks of a Python worker, with the words it has met."""
    return WordEncoder(path, end_id)


class PlaneWriter:
    def __init__(self, stream):
        self.stream, self.place = stream, len(MAGIC)
        self.pending, self.waiting, self.blocks, self.documents = [], 0, [], []
        self.squeeze = zstandard.ZstdCompressor(level=3)
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.documents.append((0 if doc_id is None else doc_id, doc_id is None, len(ids) // 4))
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK * 4:
            data = b"".join(self.pending)
            whole = len(data) // (BLOCK * 4) * (BLOCK * 4)
            for at in range(0, whole, BLOCK * 4):
                self._block(data[at:at + BLOCK * 4])
            self.pending, self.waiting = [data[whole:]], len(data) - whole

    def _block(self, data: bytes) -> None:
        planes = np.frombuffer(data, np.uint8).reshape(-1, PLANES).T
        packed = [self.squeeze.compress(p.tobytes()) if p.any() else b"" for p in planes]
        self.blocks.append((self.place, len(data) // 4, *map(len, packed)))
        for p in packed:
            self.stream.write(p)
            self.place += len(p)

    def close(self) -> int:
        if self.waiting:
            self._block(b"".join(self.pending))
        blocks = np.array(self.blocks, np.int64).reshape(-1, 2 + PLANES)
        documents = np.array(self.documents, np.int64).reshape(-1, 3)
        index = np.array([len(blocks), len(documents)], np.int64).tobytes() + blocks.tobytes() + documents.tobytes()
        index = self.squeeze.compress(index)
        self.stream.write(index + len(index).to_bytes(8, "little") + MAGIC)
        return int(documents[:, 2].sum())


class PlaneReader:
    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        stream.seek(size - 16)
        tail = stream.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a whole token file")
        length = int.from_bytes(tail[:8], "little")
        stream.seek(size - 16 - length)
        index = np.frombuffer(zstandard.ZstdDecompressor().decompress(stream.read(length)), np.int64)
        n, m = index[:2]
        self.blocks = index[2:2 + n * (2 + PLANES)].reshape(-1, 2 + PLANES)
        self.documents = index[2 + n * (2 + PLANES):].reshape(-1, 3)
        assert len(self.documents) == m

    def block(self, number: int) -> np.ndarray:
        """The ids of one block."""
        place, n, *sizes = self.blocks[number].tolist()
        planes = np.zeros((PLANES, n), np.uint8)
        self.stream.seek(place)
        data, at = self.stream.read(sum(sizes)), 0
        expand = zstandard.ZstdDecompressor()
        for p, size in enumerate(sizes):
            if size:
                planes[p] = np.frombuffer(expand.decompress(data[at:at + size]), np.uint8)
            at += size
        return planes.T.copy().view(np.uint32).ravel()

    def texts(self) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id, number of ids, crc32 of the ids) in file order, one block in memory at a time."""
        number, rest = 0, np.zeros(0, np.uint32)
        for doc_id, null, n in self.documents.tolist():
            crc, left = 0, n
            while left:
                if not len(rest):
                    rest, number = self.block(number), number + 1
                part, rest = rest[:left], rest[left:]
                crc, left = zlib.crc32(part.tobytes(), crc), left - len(part)
            yield None if null else doc_id, n, crc


def write_token_files(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encode every whole text and write the ids in ascending doc_id order; returns the table of files.

    NULL and empty texts are the end id alone. A NULL doc_id comes first; rows that repeat
    a doc_id stay, ordered by text. Documents are dealt out by range of doc_id, and each range
    is sorted and written by one task to one file under a name of its own, so a task that is run again
    leaves no damage: only files that the returned table (part, file, n_ids, n_docs) lists count.
    An empty table makes no file that holds a document.
    """
    small_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange("doc_id", F.hash("text")).sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, writer, sink = TaskContext.get().partitionId(), None, None
        files, root = open_folder(folder)
        name, encode = f"ids-{part:06d}-{uuid.uuid4().hex}.planes", None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                files.create_dir(root, recursive=True)
                sink = files.open_output_stream(f"{root}/{name}")
                writer, encode = PlaneWriter(sink), shared_encoder(tokenizer, end_id)
            for doc_id, ids in zip(column(batch, "doc_id").to_pylist(), encode(column(batch, "text").to_pylist())):
                writer.add(doc_id, ids)
        if writer is not None:
            total = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_ids": [total], "n_docs": [len(writer.documents)]})

    return keep(rows.mapInArrow(write, "part bigint, file string, n_ids bigint, n_docs bigint"), "token-files")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, read back block by block."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listed = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        for batch in batches:
            for name, start in zip(column(batch, "file").to_pylist(), column(batch, "first").to_pylist()):
                with files.open_input_file(f"{root}/{name}") as stream:
                    rows = []
                    for doc_id, n, crc in PlaneReader(stream).texts():
                        rows.append((doc_id, start, n, crc))
                        start += n
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    n = max(1, manifest.count())
    return listed.repartition(n).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_file_report(documents: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    folder = scratch(documents.sparkSession, "tokens")
    return read_token_files(write_token_files(documents, folder, tokenizer, end_id), folder)

"""Piece ids of texts and back, for sentencepiece models with byte fallback, by a shared-prefix Viterbi pass."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnloom.llm.common import column, small_batches

MARK = "▁"
CACHED_UNITS, CACHED_LENGTH = 400_000, 48
SEEN = (1 << 23) - 1  # places of the table of units met before


class PieceModel:
    """The pieces and scores of a model file, and what its merges make of texts.

    A text is cut into units (a run of marks with what follows up to the next mark, and at line
    feeds if no piece holds one); no merge crosses a cut. Units seen before are looked up. The new
    units of a batch are sorted, so that they form a trie read depth-first, and a Viterbi pass goes over
    them: the lattice has an arc for every piece, and an arc may follow another only if the merges leave the
    two beside each other as they are. Such a path is what the merges give for the prefix it spells,
    so one arc survives at each place and depends on the prefix alone: units with a
    common prefix share its part of the pass.
    """

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        if library.bos_id() < 0 or library.encode("a  b", out_type=str) == library.encode("a b", out_type=str):
            raise ValueError("only models that keep all white space are supported")
        n = library.get_piece_size()
        self.special = {i for i in range(n) if library.is_control(i) or library.is_unknown(i) or library.is_unused(i)}
        self.bytes_ids = {int(library.id_to_piece(i)[1:-1], 16): i for i in range(n) if library.is_byte(i)}
        if len(self.bytes_ids) != 256:
            raise ValueError("only models with byte fallback are supported")
        plain = [i for i in range(n) if i not in self.special and not library.is_byte(i)]
        self.ids = {library.id_to_piece(i): i for i in plain}
        self.scores = {library.id_to_piece(i): library.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes over the start of a word")
        self.split_lines = not any("\n" in p for p in self.ids)
        self.spelling = [b""] * n
        for piece, i in self.ids.items():
            self.spelling[i] = piece.replace(MARK, " ").encode()
        for byte, i in self.bytes_ids.items():
            self.spelling[i] = bytes([byte])
        # For each piece, whether it may follow another, as far as it has been asked.
        self.follows: dict[str, dict[str, bool]] = {p: {} for p in self.ids}
        self.asked = 0
        tails: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 2:
                tails.setdefault(piece[-3:], set()).add(len(piece))
        self.lengths = {tail: (*sorted(n, reverse=True), 2, 1) for tail, n in tails.items()}
        self.known: dict[str, bytes] = {}
        self.seen = bytearray(SEEN + 1)
        cut = r"[^{0}\n]" if self.split_lines else r"[^{0}]"
        rest = cut.format(MARK)
        self.units_pattern = re.compile(rf"{MARK}+{rest}*|\n{rest}*|{rest}+")

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or not self.split_lines:
            return self.units_pattern.findall(MARK + text.replace(" ", MARK))
        return (MARK + text.replace(" ", " " + MARK).replace("\n", " \n")).split(" ")

    def merge(self, text: str) -> list[str]:
        """The pieces left when the best-scored neighbours merge first, leftmost of equals."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap = [(-self.scores[a + b], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores]
        heapify(heap)
        while heap:
            _, i, whole = heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(parts):
                    new = parts[left] + parts[right]
                    if new in self.scores:
                        heappush(heap, (-self.scores[new], left, new))
        return [p for p in parts if p is not None]

    def may_follow(self, last: str, piece: str) -> bool:
        return self.merge(last + piece) == ([last, piece] if last else [piece])

    def ids_of(self, pieces: list[str]) -> bytes:
        ids = []
        for piece in pieces:
            i = self.ids.get(piece)
            ids += [i] if i is not None else [self.bytes_ids[b] for b in piece.encode()]
        return array("i", ids).tobytes()

    def shared_prefix_pass(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        """(unit, ids) of sorted distinct units."""
        follows, lengths, short = self.follows, self.lengths, (2, 1)
        arcs, last = [""], ""  # arcs[i]: the piece of the surviving path that ends at place i
        for unit in units:
            if unit.startswith(MARK + MARK):
                # Runs of marks have pieces with equal scores, where the order of merges counts.
                yield unit, self.ids_of(self.merge(unit))
                continue
            common, most = 0, min(len(unit), len(last))
            while common < most and unit[common] == last[common]:
                common += 1
            del arcs[common + 1:]
            for end in range(common + 1, len(unit) + 1):
                for length in lengths.get(unit[end - 3:end], short) if end > 2 else short:
                    begin = end - length
                    if begin < 0:
                        continue
                    piece = unit[begin:end]
                    after = follows.get(piece)
                    if after is None:
                        if length > 1:
                            continue
                        after = follows[piece] = {}  # a character that is spelled in bytes
                    fits = after.get(arcs[begin])
                    if fits is None:
                        fits = after[arcs[begin]] = self.may_follow(arcs[begin], piece)
                        self.asked += 1
                    if fits:
                        arcs.append(piece)
                        break
                else:
                    raise AssertionError(f"no path spells {unit[:end]!r}")
            last, end, path = unit, len(unit), []
            while end:
                path.append(arcs[end])
                end -= len(arcs[end])
            yield unit, self.ids_of(path[::-1])

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """The ids of each text as 32-bit integers; of NULL, NULL."""
        cut = [None if t is None else self.units(t) for t in texts]
        if len(self.known) > CACHED_UNITS:
            self.known, self.seen = {}, bytearray(SEEN + 1)
        if self.asked > 4 * CACHED_UNITS:
            self.follows, self.asked = {p: {} for p in self.ids}, 0
        new = {u for units in cut if units for u in units} - self.known.keys()
        found = dict(self.shared_prefix_pass(sorted(new)))
        out = []
        for units in cut:
            ids = None if units is None else list(map(self.known.get, units))
            if ids and None in ids:
                ids = [found[u] if i is None else i for u, i in zip(units, ids)]
            out.append(None if ids is None else b"".join(ids))
        # Only units that come again are worth their place.
        for unit, ids in found.items():
            place = hash(unit) & SEEN
            if not self.seen[place]:
                self.seen[place] = 1
            elif len(unit) <= CACHED_LENGTH:
                self.known[unit] = ids
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.spelling.__getitem__, ids.tolist()))
        return text.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=1)
def shared_model(path: str) -> PieceModel:
    """One model for all tasks of a Python worker, with the units it has met."""
    return PieceModel(path)


def encode_and_decode(documents: DataFrame, model: str) -> DataFrame:
    """Replaces text by its piece ids: piece_ids, n_pieces and round_trip (the ids decode to the text).

    Other columns stay; columns of those three names are replaced. NULL text: NULL in all three. Empty text: no ids, round_trip true. A text
    that holds the mark U+2581 itself decodes with a blank in its place (round_trip false), as in the library.
    Each row stands for itself: repeats are encoded alike, and a lost task only encodes its rows again.
    Memory is bounded by one batch of texts and a dictionary of at most CACHED_UNITS units.
    """
    small_batches(documents.sparkSession)
    added = ("piece_ids", "n_pieces", "round_trip")
    kept = [c for c in documents.columns if c not in (*added, "text")]
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept)
    schema += (", " if kept else "") + "piece_ids array<int>, n_pieces int, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared_model(model)
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            coded = pieces.encode(texts)
            lengths = np.array([0 if c is None else len(c) // 4 for c in coded], np.int64)
            values = np.frombuffer(b"".join(c for c in coded if c), np.int32)
            ends = np.cumsum(lengths)
            null = np.array([c is None for c in coded], bool)
            # The ids go out as they are and come back from the column that is returned.
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values), mask=pa.array(null))
            back = lists.flatten().to_numpy()
            same = [None if t is None else pieces.decode(back[e - n:e]) == t for t, e, n in zip(texts, ends, lengths)]
            counts = pa.array(lengths.astype(np.int32), mask=null)
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in kept], lists, counts, pa.array(same, pa.bool_())], [*kept, *added])

    return documents.select(*kept, "text").mapInArrow(run, schema)

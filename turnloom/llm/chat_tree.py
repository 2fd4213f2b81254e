"""Chat formatting as a prefix tree: conversations that begin alike share their first turns.

A node is a turn after a certain history. Its tokens are emitted once, depth-first over the whole forest,
with the place in its conversation (position ids) and the emitted ranges of its ancestors, which
with its own earlier tokens are all it attends to.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import column, keep, running_total, small_batches

# Control strings of the template; a text that holds one gets a backslash after its first character, and one
# that holds an escaped one gets one more.
CONTROL = r"/?INST\]|/?ROLE\]|ROLE:|/?s>"
ESCAPE = re.compile(rf"([\[<])(\\*)({CONTROL})")
UNESCAPE = re.compile(rf"([\[<])\\(\\*)({CONTROL})")
TURN = re.compile(r"(?s)\[INST\] (.*) \[/INST\]|<s> (.*) </s>|\[ROLE:([^\]]*)\] (.*) \[/ROLE\]")


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def frame_of(role: str) -> tuple[str, str]:
    """What stands before and after the text of a turn."""
    if role == "user":
        return "[INST] ", " [/INST]"
    if role == "assistant":
        return "<s> ", " </s>"
    return f"[ROLE:{quote(role, safe='')}] ", " [/ROLE]"


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    user, assistant, role, other = TURN.fullmatch(segment).groups()
    if user is not None:
        return "user", unescape(user)
    if assistant is not None:
        return "assistant", unescape(assistant)
    return unquote(role), unescape(other)


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _by_conversation(frame: DataFrame, step, schema: str) -> DataFrame:
    """Stream each conversation's rows by depth through ``step()``; only the state of one is held, never its rows."""
    dealt = frame.repartition("conv_id").sortWithinPartitions("conv_id", "depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != last:
                    if begun and (end := state.end()):
                        out.append(end)
                    state, last, begun = step(), row["conv_id"], True
                if (made := state.add(row)):
                    out.append(made)
            if out:
                yield _batch(out, target)
        if begun and (end := state.end()):
            yield _batch([end], target)

    empty = frame.sparkSession.createDataFrame([], schema)
    target = _arrow_schema(empty)
    return dealt.mapInArrow(run, schema)


def _arrow_schema(frame: DataFrame) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
             "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in frame.dtypes])


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def turn_chains(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, node, parent, role, text): a node's name is a hash of its turn and all turns before it."""
    ordered = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                           F.coalesce("text", F.lit("")).alias("text"))
    dealt = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begun, depth, parent = None, False, 0, b""
        for batch in batches:
            depths, nodes, parents = [], [], []
            roles, texts = column(batch, "role").to_pylist(), column(batch, "text").to_pylist()
            for conversation, role, text in zip(column(batch, "conv_id").to_pylist(), roles, texts):
                if not begun or conversation != last:
                    last, begun, depth, parent = conversation, True, 0, b""
                said = f"{len(role)}:{role}{text}".encode()
                node = hashlib.sha256(parent + said).digest()[:16]
                depths.append(depth)
                nodes.append(node)
                parents.append(parent)
                depth, parent = depth + 1, node
            yield pa.RecordBatch.from_arrays(
                [column(batch, "conv_id"), pa.array(depths, pa.int64()), pa.array(nodes, pa.binary()),
                 pa.array(parents, pa.binary()), column(batch, "role"), column(batch, "text")],
                ["conv_id", "depth", "node", "parent", "role", "text"])

    return dealt.mapInArrow(run, "conv_id bigint, depth bigint, node binary, parent binary, role string, text string")


def _node_writer(tokenizer_path: str):
    class Writer:
        """The rows of the nodes a conversation stands for: tokens, and the branches on the way to each."""

        tokenizer = None

        def __init__(self):
            self.path = b""

        def add(self, row: dict) -> dict | None:
            if row["fork"]:
                self.path += row["depth"].to_bytes(8, "big") + row["node"]
            if not row["stands"]:
                return None
            if Writer.tokenizer is None:
                Writer.tokenizer = load_tokenizer(tokenizer_path)
            opening, closing = frame_of(row["role"])
            parts = [opening, escape(row["text"]), closing]
            ids = [x.ids for x in Writer.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
            counts = row["role"] == "assistant"
            return {"node": row["node"], "parent": row["parent"], "depth": row["depth"], "conv_id": row["conv_id"], "path": self.path,
                    "tokens": [i for part in ids for i in part], "n_tokens": sum(map(len, ids)),
                    "loss_from": len(ids[0]) if counts else 0, "loss_to": len(ids[0]) + len(ids[1]) if counts else 0}

        def end(self) -> None:
            return None

    return Writer


class _Attention:
    """Position of each node in its conversation, and the emitted ranges of its ancestors, joined where they touch."""

    def __init__(self):
        self.position, self.ranges = 0, []

    def add(self, row: dict) -> dict | None:
        out = None
        if row["stands"]:
            out = {"node": row["node"], "position_start": self.position,
                   "attend_from": [a for a, _ in self.ranges], "attend_to": [b for _, b in self.ranges]}
        begin, end = row["emit_start"], row["emit_start"] + row["n_tokens"]
        if self.ranges and self.ranges[-1][1] == begin:
            self.ranges[-1] = (self.ranges[-1][0], end)
        else:
            self.ranges.append((begin, end))
        self.position += row["n_tokens"]
        return out

    def end(self) -> None:
        return None


def prefix_tree(turns: DataFrame, tokenizer_path: str) -> tuple[DataFrame, DataFrame]:
    """The forest of all conversations: (index of turns: conv_id, depth, node), (nodes).

    Nodes: node, parent (empty for a first turn), depth, tokens, loss_from/loss_to (range of its
    tokens under the loss mask: an assistant's text), emit_start (place of its first token in the emission),
    position_ids (of its tokens in each conversation that holds it), attend_from/attend_to (emitted ranges of its
    ancestors). Turns go by ``turn`` (NULL first), then role and text; NULL role and text are empty; rows that repeat are turns
    of their own; NULL conv_id is one conversation. An empty table gives empty tables.

    A conversation is streamed in order through one task and never held; a turn that many
    share is one node, and its joins meet one row on the node's side, so they can be split.
    """
    small_batches(turns.sparkSession)
    rows = keep(turn_chains(turns), "turns")
    nodes = rows.groupBy("node", "parent").agg(F.min("conv_id").alias("rep"))
    forks = nodes.groupBy("parent").agg((F.count("*") > 1).alias("fork"))
    nodes = keep(nodes.join(forks, "parent").select("node", "rep", "fork"), "nodes")
    stands = F.col("conv_id").eqNullSafe(F.col("rep"))
    marked = rows.join(nodes, "node").withColumn("stands", stands)
    marked = marked.select("conv_id", "depth", "node", "parent", "fork", "stands",
                           F.when(F.col("stands"), F.col("role")).alias("role"), F.when(F.col("stands"), F.col("text")).alias("text"))
    written = _by_conversation(
        marked, _node_writer(tokenizer_path),
        "node binary, parent binary, depth bigint, conv_id bigint, path binary, tokens array<int>, n_tokens bigint, loss_from int, loss_to int")
    emitted = keep(running_total(keep(written, "segments"), [F.col("path"), F.col("depth")], "n_tokens", "emit_start"), "emitted")
    index = rows.select("conv_id", "depth", "node")
    places = index.join(emitted.select("node", F.col("conv_id").alias("rep"), "emit_start", "n_tokens"), "node")
    attention = _by_conversation(
        places.withColumn("stands", stands).drop("rep"), _Attention,
        "node binary, position_start bigint, attend_from array<bigint>, attend_to array<bigint>")
    tree = emitted.join(attention, "node").select(
        "node", "parent", "depth", "tokens", "loss_from", "loss_to", "emit_start",
        F.sequence("position_start", F.col("position_start") + F.col("n_tokens") - 1).alias("position_ids"), "attend_from", "attend_to")
    return index, keep(tree, "tree")


def _reader(tokenizer_path: str):
    class Reader:
        """Reads a conversation back from the tokens on its way through the tree."""

        tokenizer = None

        def __init__(self):
            if Reader.tokenizer is None:
                Reader.tokenizer = load_tokenizer(tokenizer_path)
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
            self.n_turns = self.loss_chars = self.chars = 0

        def add(self, row: dict) -> None:
            decode = lambda ids: Reader.tokenizer.decode(ids, skip_special_tokens=False)
            segment = decode(row["tokens"])
            role, text = parse(segment)
            said = unescape(decode(row["tokens"][row["loss_from"]:row["loss_to"]]))
            self.turns.update(f"{role}\n{text}\n".encode())
            self.loss.update(said.encode())
            self.n_turns += 1
            self.loss_chars += len(said)
            self.chars += len(segment)
            self.conversation = row["conv_id"]

        def end(self) -> dict:
            return {"conv_id": self.conversation, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(),
                    "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}

    return Reader


def read_conversations(index: DataFrame, tree: DataFrame, tokenizer_path: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) as the tree's tokens have them."""
    small_batches(tree.sparkSession)
    rows = index.join(tree.select("node", "tokens", "loss_from", "loss_to"), "node").drop("node")
    return _by_conversation(
        rows, _reader(tokenizer_path),
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")

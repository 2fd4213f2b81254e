"""Structured Streaming forms of the per-session operators.

Batch and stream share the same column logic; state is per session and holds counters,
never rows. Watermarks bound the state of the event-time operators.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnloom.functions import text as X
from turnloom.operators import extraction
from turnloom.operators.retrieval import SAME_SUBJECT
from turnloom.sources.stored import StoredTable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEDGER_KEEPS = 50


def extract_stream(turns: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Memory candidates of a stream of turns; stateless, so it streams as it batches."""
    spoken = turns.where("role <> 'assistant'")
    found = extraction.candidates(spoken)
    return found.where(f"confidence >= {extraction.MIN_CONFIDENCE}").select(
        *keys, order, "sentence_pos", "sentence", "memory_type", "confidence")


def observe_into(turns: DataFrame, keys: list[str], order: str, path: str, checkpoint: str):
    """Append extracted memories per micro-batch; a repeated batch overwrites its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        first = extraction.select_candidates(batch, [*keys, order])
        first.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return extract_stream(turns, keys, order).writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observe_into_table(turns: DataFrame, keys: list[str], order: str, stored: StoredTable, checkpoint: str):
    """Memories of a stream of turns, upserted by session and memory id; a micro-batch that is run again changes nothing.

    ``stored`` has the columns of ``MEMORY_SCHEMA`` after the keys, with keys (keys, memory_id), order ``source_turn``, ``first_turn`` as first written and
    ``mentions`` as counter. What it holds at the end is what ``extraction.observe`` makes of all turns, in whatever order files arrive.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        taken = extraction.select_candidates(batch, [*keys, order])
        rows = taken.select(
            *keys, X.stable_id("sentence").alias("memory_id"), F.col("sentence").alias("text"), "memory_type", "confidence",
            F.col(order).cast("long").alias("source_turn"), F.col(order).cast("long").alias("first_turn"), F.lit(1).cast("long").alias("mentions"))
        stored.upsert(rows, f"{checkpoint}:{batch_id}")

    return extract_stream(turns, keys, order).writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


MEMORY_SCHEMA = "memory_id string, text string, memory_type string, confidence double, source_turn bigint, first_turn bigint, mentions bigint"


class Supersession(StatefulProcessor):
    """Claims of a session by subject token; a row for each memory that another one is found to supersede, whichever arrives first."""

    def __init__(self, same_subject: float, keep_ms: int | None):
        self.same_subject, self.keep_ms = same_subject, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        more = {"ttlDurationMs": self.keep_ms} if self.keep_ms else {}
        self.claims = handle.getMapState("claims", "token string", "said string", **more)
        self.known = handle.getMapState("known", "memory_id string", "seen bigint", **more)

    def _pairs(self, new: dict, token: str) -> Iterator[tuple]:
        for old in json.loads(self.claims.getValue((token,))[0]) if self.claims.containsKey((token,)) else []:
            if old["id"] == new["id"] or old["seen"] == new["seen"]:
                continue
            older, newer = (old, new) if old["seen"] < new["seen"] else (new, old)
            one, two = set(older["subjects"]), set(newer["subjects"])
            if (newer["replaces"] and set(older["kinds"]) & set(newer["kinds"]) and len(one & two) / len(one | two) >= self.same_subject
                    and not set(older["values"]) & set(newer["values"])):
                yield (older["claim"], newer["claim"]), older["id"], newer["id"], older["subject"]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            found: dict[tuple[str, str], tuple] = {}
            for row in batch.itertuples(index=False):
                if self.known.containsKey((row.memory_id,)):
                    continue  # delivered before
                self.known.updateValue((row.memory_id,), (int(row.seen),))
                for claim in json.loads(row.claims):
                    new = {"id": row.memory_id, "seen": int(row.seen), "replaces": bool(row.replaces), "claim": claim["claim"], "subject": claim["subject"],
                           "kinds": claim["kinds"], "subjects": claim["subject_tokens"], "values": claim["value_tokens"]}
                    for token in set(new["subjects"]):
                        for place, older, newer, subject in self._pairs(new, token):
                            found[older, newer] = min(found.get((older, newer), (place, subject)), (place, subject))
                        held = json.loads(self.claims.getValue((token,))[0]) if self.claims.containsKey((token,)) else []
                        self.claims.updateValue((token,), (json.dumps([*held, new]),))
            yield pd.DataFrame([(key[0], *pair, subject) for pair, (_, subject) in found.items()], columns=["session", "older_id", "newer_id", "subject"])

    def close(self) -> None:
        pass


def supersession(memories: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """``memories`` streams (session, memory_id, seen, replaces, claims) as ``memory_features`` makes them; the rows of ``supersession.superseded``, each once.

    State is a session's claims under each of their subject tokens; a claim is compared only with those that share one. ``keep_ms``: how
    long a claim is remembered (for ever, if None). Rows without a memory id or ``seen`` are left out.
    """
    rows = memories.where("memory_id IS NOT NULL AND seen IS NOT NULL").select(
        "session", "memory_id", "seen", F.coalesce("replaces", F.lit(False)).alias("replaces"), F.coalesce(F.to_json("claims"), F.lit("[]")).alias("claims"))
    return rows.groupBy("session").transformWithStateInPandas(
        statefulProcessor=Supersession(SAME_SUBJECT, keep_ms), outputStructType="session string, older_id string, newer_id string, subject string",
        outputMode="Append", timeMode="ProcessingTime" if keep_ms else "None")


class SessionBudget(StatefulProcessor):
    """Counters of one session; a turn past a ceiling is refused and only counted."""

    def __init__(self, max_requests: int, max_tokens: int):
        self.max_requests, self.max_tokens = max_requests, max_tokens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("budget", "requests bigint, tokens bigint, refused bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        requests, tokens, refused = self.state.get() if self.state.exists() else (0, 0, 0)
        arrived = pd.concat(list(rows)).sort_values("seq")
        out = []
        for row in arrived.itertuples(index=False):
            if row.reset:
                requests = tokens = refused = 0
            allowed = requests < self.max_requests and tokens + row.charged <= self.max_tokens
            if allowed:
                requests, tokens = requests + 1, tokens + row.charged
            else:
                refused += 1
            out.append((key[0], row.seq, bool(allowed), requests, tokens, refused))
        self.state.update((requests, tokens, refused))
        yield pd.DataFrame(out, columns=["session", "seq", "allowed", "requests", "tokens", "refused"])

    def close(self) -> None:
        pass


def session_budget(requests: DataFrame, max_requests: int, max_tokens: int) -> DataFrame:
    """``requests`` streams (session, seq, charged, reset); rows of a batch apply in ``seq`` order."""
    return requests.groupBy("session").transformWithStateInPandas(
        statefulProcessor=SessionBudget(max_requests, max_tokens),
        outputStructType="session string, seq bigint, allowed boolean, requests bigint, tokens bigint, refused bigint",
        outputMode="Update", timeMode="None")


class SecurityLedger(StatefulProcessor):
    """Exact cumulative counts of a session and its last findings only."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n bigint")
        self.recent = handle.getListState("recent", "category string, seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total = self.total.get()[0] if self.total.exists() else 0
        recent = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        arrived = pd.concat(list(rows)).sort_values("seq")
        total += len(arrived)
        recent = (recent + list(zip(arrived["category"], arrived["seq"].astype(int))))[-LEDGER_KEEPS:]
        self.total.update((total,))
        self.recent.put(recent)
        yield pd.DataFrame([(key[0], total, len(recent), recent[0][1])], columns=["session", "total", "kept", "oldest_kept"])

    def close(self) -> None:
        pass


def security_ledger(findings: DataFrame) -> DataFrame:
    """``findings`` streams (session, seq, category)."""
    return findings.groupBy("session").transformWithStateInPandas(
        statefulProcessor=SecurityLedger(),
        outputStructType="session string, total bigint, kept bigint, oldest_kept bigint",
        outputMode="Update", timeMode="None")


def idle_sessions(activity: DataFrame, session: str, stamp: str, gap: str, late: str) -> DataFrame:
    """Sessions of activity that ended: no event for ``gap``, once the watermark has passed."""
    return activity.withWatermark(stamp, late).groupBy(session, F.session_window(stamp, gap).alias("w")).agg(
        F.count("*").alias("events")).select(session, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def without_repeats(turns: DataFrame, keys: list[str], stamp: str, late: str) -> DataFrame:
    """Each turn once within the watermark, however often it is delivered."""
    return turns.withWatermark(stamp, late).dropDuplicatesWithinWatermark(keys)

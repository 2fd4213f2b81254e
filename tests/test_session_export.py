"""The session export: every kind of row, with bodies that stay JSON after redaction."""

import json

from turnloom.sources import tables


def test_every_kind_is_scrubbed_json(spark):
    key = "sk-" + "a1B2c3D4e5F6g7H8"
    turns = spark.createDataFrame([(1, 0, "user", f'password: {key}"'), (1, 1, "assistant", None), (None, 0, "user", "")], "s int, turn int, role string, text string")
    memories = spark.createDataFrame([(1, 0, "FACT", f"bearer {key}")], "s int, source_turn int, memory_type string, text string")
    usage = spark.createDataFrame([(1, 2, 40)], "s int, requests long, tokens long")
    runs = spark.createDataFrame([(1, 3, "memory", 120)], "s int, run int, mode string, final_tokens long")
    security = spark.createDataFrame([(1, 0, "injection_detected", f"use {key}")], "s int, turn int, category string, detail string")
    rows = tables.session_export(turns, memories, usage, "s", runs, security).collect()
    bodies = {(r.s, r.kind, r.seq): json.loads(r.body) for r in rows}
    assert bodies == {
        (1, "message", 0): {"role": "user", "text": "password: [redacted]"}, (1, "message", 1): {"role": "assistant"},
        (None, "message", 0): {"role": "user", "text": ""}, (1, "memory", 0): {"memory_type": "FACT", "text": "bearer [redacted]"},
        (1, "usage", 2): {"requests": 2, "tokens": 40}, (1, "run", 3): {"mode": "memory", "final_tokens": 120},
        (1, "security", 0): {"category": "injection_detected", "detail": "use [redacted]"}}
    assert not any(key in r.body for r in rows)
    assert tables.session_export(turns.limit(0), memories.limit(0), usage.limit(0), "s").count() == 0

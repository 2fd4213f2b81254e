"""Context strategies: five baselines and four single-component removals."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------------
EVIDENCE_BUDGET = 1024
WINDOW_BUDGET = 256
WINDOW_MESSAGES = 2
SLIDING_MESSAGES = 8
EVIDENCE_ITEMS = 6
SESSION_CEILING = 4096
REPLAY_SLACK = 1024
# ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mode:
    mode: str
    letter: str
    uses_memory: bool = False
    uses_chunks: bool = False
    max_recent: int | None = WINDOW_MESSAGES
    recent_budget: int | None = WINDOW_BUDGET
    memory_budget: int = 0
    chunk_budget: int = 0
    max_memories: int = EVIDENCE_ITEMS
    top_k: int = EVIDENCE_ITEMS
    relevance_floor: float = 0.12
    relative_relevance_ratio: float = 0.55
    weight_recency: float = 0.20
    resolve_conflicts: bool = True
    drop_stale_memories: bool = True
    heuristic_conflict_detection: bool = True
    strip_temporal: bool = False
    strip_lifecycle: bool = False
    ignore_reports: bool = False


_memory = dict(uses_memory=True, memory_budget=EVIDENCE_BUDGET)
MODES = [
    Mode("full_context", "A", max_recent=None, recent_budget=None),
    Mode("sliding_window", "B", max_recent=SLIDING_MESSAGES, recent_budget=None),
    Mode("chunks", "C", uses_chunks=True, chunk_budget=EVIDENCE_BUDGET),
    Mode("memory", "D", **_memory),
    Mode("memory_chunks", "E", uses_memory=True, uses_chunks=True,
         memory_budget=EVIDENCE_BUDGET // 2, chunk_budget=EVIDENCE_BUDGET - EVIDENCE_BUDGET // 2),
    Mode("memory_no_temporal", "D1", weight_recency=0.0, strip_temporal=True, **_memory),
    Mode("memory_no_relevance", "D2", relevance_floor=0.0, relative_relevance_ratio=0.0, **_memory),
    Mode("memory_no_conflict", "D3", resolve_conflicts=False, drop_stale_memories=False,
         heuristic_conflict_detection=False, strip_lifecycle=True, ignore_reports=True, **_memory),
    Mode("memory_no_memory", "D4"),
]
BASELINES = [m.mode for m in MODES[:5]]
ABLATIONS = [m.mode for m in MODES[5:]]
ALIASES = {"no_memory": "sliding_window"}


def resolve(name: str) -> str:
    name = ALIASES.get(str(name).strip(), str(name).strip())
    if name not in {m.mode for m in MODES}:
        raise ValueError(f"unknown mode {name!r}")
    return name


def mode_structs(modes: list[Mode] | None = None) -> Column:
    """The modes as one array literal, for fanning rows out without a join."""
    kinds = {"max_recent": "int", "recent_budget": "int"}
    return F.array(*[
        F.struct(*[F.lit(v).cast(kinds[k]).alias(k) if k in kinds else F.lit(v).alias(k)
                   for k, v in asdict(m).items()]) for m in (modes or MODES)])


def fan_out(frame: DataFrame, modes: list[Mode] | None = None, fields: list[str] | None = None) -> DataFrame:
    spread = frame.select("*", F.explode(mode_structs(modes)).alias("_m"))
    wanted = fields or list(asdict(MODES[0]))
    return spread.select(*frame.columns, *[F.col("_m." + f).alias(f) for f in wanted])

"""Every threshold of the engine in one place; all are plain keyword arguments."""

from __future__ import annotations

from dataclasses import dataclass

# Wipe relevance, mode -> text a station key must contain.
WIPE_PATTERNS = {"bus": "490", "tube": "940", "dlr": "940GZZD"}


@dataclass(frozen=True)
class Settings:
    top_k: int = 10
    departed_minutes: int = 2
    unassigned_horizon_minutes: int = 20
    heartbeat_cycles: int = 5
    wipe_guard_arrivals: int = 50
    # Whole cycles of a mode that may come before one that is not is given up.
    cycle_patience: int = 3
    payload_bytes: int = 4000
    push_batch: int = 500
    station_batch: int = 250
    line_batch: int = 100
    # Ticks of half a second between two micro-batches of a 30-second poll; each sends one capped batch.
    ticks_per_batch: int = 60
    upsert_chunk: int = 100
    board_budget: int = 60
    push_ttl_ms: int = 90_000
    geohash_precision: int = 9
    # Length of one history block in cycles. It bounds the rows that one task
    # has to hold for one key, however long the history is.
    block_cycles: int = 1024
    # Blocks that are chained as one.
    group_blocks: int = 1024


DEFAULTS = Settings()

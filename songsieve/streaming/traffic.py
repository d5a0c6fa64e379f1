"""Structured Streaming jobs over a request log; each equals its batch form on closed input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_windows(log: DataFrame, client: str, ts: str, window: str, limit: int, late: str = "10 minutes") -> DataFrame:
    """Requests and rejections per client and window, final once the watermark has passed."""
    counts = log.withWatermark(ts, late).groupBy(F.window(ts, window), client).agg(F.count("*").alias("requests"))
    return counts.select(client, F.col("window.start").alias("window_start"), "requests", F.greatest(F.lit(0), F.col("requests") - limit).alias("rejected"))


def cache_sessions(log: DataFrame, key: str, ts: str, ttl: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a cache key whose lookups follow each other within the time to live."""
    grouped = log.withWatermark(ts, late).groupBy(F.session_window(ts, ttl), key).agg(F.count("*").alias("lookups"))
    return grouped.select(key, F.col("session_window.start").alias("session_start"), "lookups")


def unanswered(starts: DataFrame, completions: DataFrame, wait: str, late: str = "10 minutes") -> DataFrame:
    """Starts (request_id, started) without a completion (done_id, done) within ``wait``."""
    s, c = starts.withWatermark("started", late), completions.withWatermark("done", late)
    near = (F.col("request_id") == F.col("done_id")) & (F.col("done") >= F.col("started")) & (F.col("done") <= F.col("started") + F.expr(f"interval {wait}"))
    return s.join(c, near, "left_outer").where("done_id is null").select("request_id", "started")


def breaker_states(log: DataFrame, provider: str, ts: str, failed: str) -> DataFrame:
    """Running failures and block of each source, one row per attempt (arrival order within a batch is by time)."""
    schema = f"{provider} string, {ts} timestamp, failures long, block_ms long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(ts)
        out = []
        for at, bad in zip(rows[ts], rows[failed], strict=True):
            failures = failures + 1 if bad else 0
            out.append((key[0], at, failures, 0 if failures < 2 else min(45_000, (failures - 1) ** 2 * 2200)))
        state.update((failures,))
        yield pd.DataFrame(out, columns=[provider, ts, "failures", "block_ms"])

    return log.select(provider, ts, failed).groupBy(provider).applyInPandasWithState(step, schema, "failures long", "append", GroupStateTimeout.NoTimeout)

"""Request logs: rate limits, cache hits, failing sources and unanswered requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Microseconds of a timestamp with or without a zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def rate_limit(log: DataFrame, client: str, ts: str, window: str = "1 minute", limit: int = 90, order: str = "event_id") -> DataFrame:
    """Per request of a fixed window: its number, whether it is allowed, what remains."""
    start = F.window(ts, window)["start"]
    n = F.row_number().over(Window.partitionBy(client, "window_start").orderBy(ts, order))
    most = F.lit(max(10, limit) if window == "1 minute" else limit)
    return log.withColumn("window_start", start).withColumn("request_no", n).withColumn("allowed", F.col("request_no") <= most).withColumn("remaining", F.greatest(F.lit(0), most - F.col("request_no")))


def cache_hits(log: DataFrame, key: list[str], ts: str, cacheable: Column, ttl_seconds: int, order: str = "event_id") -> DataFrame:
    """Whether each lookup would be answered from a cache whose entries live on when read.

    Lookups of a key that follow each other within the time to live form a session; one is a
    hit if an earlier one of its session could be stored.
    """
    w = Window.partitionBy(*key).orderBy(ts, order)
    gap = micros(ts) - F.lag(micros(ts)).over(w)
    session = F.sum(F.when(gap.isNull() | (gap > max(30, ttl_seconds) * 1_000_000), 1).otherwise(0)).over(w)
    marked = log.withColumn("cacheable", cacheable).withColumn("session", session)
    before = Window.partitionBy(*key, "session").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumn("hit", F.coalesce(F.max("cacheable").over(before), F.lit(False)))


def circuit_breaker(log: DataFrame, provider: str, ts: str, failed: Column, order: str = "event_id") -> DataFrame:
    """Consecutive failures of a source and how long it is blocked after each attempt.

    One failure alone does not block; further ones do for growing times up to 45 seconds.
    """
    w = Window.partitionBy(provider).orderBy(ts, order)
    marked = log.withColumn("failed", failed).withColumn("run", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w))
    in_run = Window.partitionBy(provider, "run").orderBy(ts, order)
    failures = F.sum(F.col("failed").cast("int")).over(in_run)
    out = marked.withColumn("failures", F.when(F.col("failed"), failures).otherwise(0))
    block = F.when(F.col("failures") < 2, 0).otherwise(F.least(F.lit(45_000), (F.col("failures") - 1) * (F.col("failures") - 1) * 2200))
    until = micros(ts) + F.col("block_ms") * 1000
    out = out.withColumn("block_ms", block.cast("long")).withColumn("until", until)
    return out.withColumn("blocked_attempt", F.coalesce(F.lag("until").over(w) > micros(ts), F.lit(False)))


def orphans(starts: DataFrame, completions: DataFrame, on: list[str]) -> DataFrame:
    """Requests that were begun and never answered."""
    return starts.join(completions, on, "left_anti")

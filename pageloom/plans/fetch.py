"""Fetch schedule: when each URL may be requested under a rate limit and a delay."""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.operators.ranking import ordered_rank, paced

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def fetch_schedule(
    urls: DataFrame, order: list[str], rate_limit: float, delay_ms: int
) -> DataFrame:
    """Adds ``rank`` and ``start_seconds`` to ``urls(host, ...)``.

    Each host has a token bucket that starts full with ``max(1, floor(rate))``
    tokens and refills at ``rate`` per second; the delay comes on top.  No rate
    limit means only the delay.  ``order`` must be unique within a host; one
    large host spreads over many tasks.
    """
    ranked = ordered_rank(urls, ["host"], order)
    wait = F.lit(0.0)
    if rate_limit > 0:
        burst = max(1, floor(rate_limit))
        wait = F.greatest(F.lit(0.0), (F.col("rank") - burst) / F.lit(float(rate_limit)))
    return ranked.withColumn("start_seconds", wait + F.lit(delay_ms / 1000.0))


def arrival_schedule(requests: DataFrame, order: list[str], rate_limit: float, delay_ms: int) -> DataFrame:
    """Adds ``start_at`` to ``requests(host, arrived_at TIMESTAMP_NTZ, ...)`` that come over time.

    The same token bucket: a request takes a token when it arrives, or as soon
    as one is there, in the order of ``(arrived_at, *order)``, which must be
    unique within a host.  After a request the bucket is empty at
    ``max(arrived_at - (burst - 1) / rate, that of the request before + 1 / rate)``,
    and the request starts then or on arrival, whichever is later, plus the
    delay.  Times are whole microseconds, and so is ``1 / rate``.
    """
    delayed = F.expr(f"{delay_ms * 1000}L")
    timed = requests.withColumn("_at", F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, arrived_at)"))
    start = F.col("_at")
    if rate_limit > 0:
        step = round(1_000_000 / rate_limit)
        spare = (max(1, floor(rate_limit)) - 1) * step
        timed = paced(timed.withColumn("_floor", F.col("_at") - F.lit(spare)), ["host"], ["_at", *order], "_floor", step, "_empty")
        start = F.greatest("_at", "_empty")
    return timed.withColumn("_start", start + delayed).select(
        *requests.columns, F.expr(f"timestampadd(MICROSECOND, _start, {_EPOCH})").alias("start_at")
    )

"""Retry plan over a table of attempts, instead of sleeping and retrying in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.plans.config import RetryConfig

# Parts of error messages that mean "try again".
RETRYABLE = ["timeout", "connection", "network", "temporary", "temporarily unavailable"]
# How a passed deadline and a cancelled call describe themselves.
CANCELLED = ["context deadline exceeded", "context canceled"]


def is_retryable(message: Column) -> Column:
    """True for errors worth another attempt; NULL (no error) is not one."""
    text = F.lower(message)
    hits = [F.contains(text, F.lit(word)) for word in RETRYABLE]
    hits += [text == word for word in CANCELLED]
    any_hit = hits[0]
    for hit in hits[1:]:
        any_hit = any_hit | hit
    return F.coalesce(any_hit, F.lit(False))


def retry_plan(attempts: DataFrame, config: RetryConfig = RetryConfig()) -> DataFrame:
    """``(key, attempt, ts, status, retry_at)`` for ``attempts(key, ts, seq, error)``.

    Attempts count by ``(ts, seq)`` up to the first one that settles the key:
    success (``done``), an error not worth retrying (``fatal``), or the last
    allowed attempt (``exhausted``).  Others get ``retry_at``.  Only the first
    few attempts of a key matter, and that limit is applied before the shuffle,
    so a key with very many attempts does no harm.
    """
    order = Window.partitionBy("key").orderBy("ts", "seq")
    wait = F.least(
        F.lit(config.initial_delay_s) * F.pow(F.lit(config.multiplier), F.col("attempt") - 1),
        F.lit(config.max_delay_s),
    )
    status = (
        F.when(F.col("error").isNull(), "done")
        .when(~is_retryable(F.col("error")), "fatal")
        .when(F.col("attempt") > config.max_retries, "exhausted")
        .otherwise("retry")
    )
    settled = F.max((F.col("status") != "retry").cast("int")).over(
        Window.partitionBy("key").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    )
    delay = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait.cast("decimal(18, 6)"))
    retry_at = F.when(F.col("status") == "retry", F.col("ts") + delay)
    return (
        attempts.withColumn("attempt", F.row_number().over(order))
        .where(F.col("attempt") <= config.max_retries + 1)
        .withColumn("status", status)
        .withColumn("_settled", settled)
        .where("coalesce(_settled, 0) = 0")
        .withColumn("retry_at", retry_at)
        .select("key", "attempt", "ts", "status", "retry_at")
    )

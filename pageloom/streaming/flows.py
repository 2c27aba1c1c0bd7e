"""Continuous runs: pages as they arrive, a visited set over a flow of URLs, a fed store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pageloom.functions.urls import normalize_url
from pageloom.operators.links import extract_links
from pageloom.operators.store import STORE_COLUMNS
from pageloom.plans.config import RESULT_TTL_HOURS
from pageloom.plans.convert import pages_to_markdown


def run_batches(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    """Apply a batch transformation to everything that has arrived, then stop.

    Each micro-batch overwrites its own folder, so a batch that is repeated
    after a failure leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def convert_stream(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Markdown of pages as they arrive; the batch code runs unchanged per micro-batch."""
    return run_batches(pages, pages_to_markdown, out, checkpoint)


def markdown_stream(pages: DataFrame) -> DataFrame:
    """Markdown of arriving pages as a plan of its own: stateless, and no micro-batch stores anything."""
    return pages_to_markdown(pages)


def link_stream(pages: DataFrame) -> DataFrame:
    """Links of arriving pages; stateless, so it needs no micro-batch function."""
    return extract_links(pages)


def visited_stream(urls: DataFrame, ttl_hours: int = RESULT_TTL_HOURS) -> DataFrame:
    """First sighting of every normalised URL in a flow ``(ts TIMESTAMP, url)``.

    State is kept as long as results are: after that a URL may pass again.
    """
    return (
        urls.selectExpr("ts", f"{normalize_url('url')} AS url")
        .where("url IS NOT NULL")
        .withWatermark("ts", f"{ttl_hours} hours")
        .dropDuplicatesWithinWatermark(["url"])
    )


def store_stream(entries: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a flow of store entries to the store table."""
    return run_batches(entries, lambda batch: batch.select(STORE_COLUMNS), out, checkpoint)


def append_stream(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append-only rows to Parquet by the file sink, then stop."""
    return (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )



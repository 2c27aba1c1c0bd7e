"""Inputs of the registered queries: the given tables, and tables Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.sources.pages import read_pages


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with extra anchors to other captured pages, so that a crawl gets anywhere.

    Page ``i`` links to pages ``8i+1 .. 8i+8``, to ``3i+2`` and back to its
    parent ``(i-1) div 8``: at most ten per page.
    """
    source = pages(spark, sf_dir)
    ids = "concat(transform(sequence(1, 8), k -> 8 * page_id + k), array(3 * page_id + 2, greatest(page_id - 1, 0) div 8))"
    wanted = source.selectExpr("page_id AS src", f"posexplode({ids}) AS (at, page_id)")
    anchors = (
        wanted.join(source.select("page_id", "url"), "page_id")
        .groupBy("src")
        .agg(F.array_sort(F.collect_list(F.struct("at", "url"))).alias("_to"))
        .selectExpr(
            "src AS page_id",
            "array_join(transform(_to, t -> concat('<a href=\"', replace(t.url, '&', '&amp;'), '\">go</a>')), '') AS _extra",
        )
    )
    return source.join(anchors, "page_id", "left").selectExpr(
        "page_id", "url", "concat(html, coalesce(_extra, '')) AS html"
    )


def escaped(text: str) -> str:
    return f"replace(replace({text}, '&', '&amp;'), '<', '&lt;')"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(key, ts, seq, error)``: events read as fetch attempts."""
    error = """CASE event_type WHEN 'error' THEN 'i/o Timeout' WHEN 'view' THEN 'Connection reset'
        WHEN 'click' THEN 'Temporarily unavailable' WHEN 'signup' THEN 'HTTP 404 not found' END"""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('u', user_id) AS key", "ts", "event_id AS seq", f"{error} AS error"
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(key, value, ts)``: events read as crawl results to store."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('u', user_id) AS key", "event_type AS value", "ts"
    )

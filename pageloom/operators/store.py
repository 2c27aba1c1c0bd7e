"""Keyed result store with expiry: an append-only table ``(key, value, written_at, expires_at)``.

Of several writes of a key the newest counts, so putting is appending.  Picking
the newest is an aggregate with map-side combine, not a window: a key written
very often costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.plans.config import RESULT_TTL_HOURS
from pageloom.session import KeyedLog, shuffle_partitions

STORE_COLUMNS = ["key", "value", "written_at", "expires_at"]
STORE_SCHEMA = "key STRING, value STRING, written_at {0}, expires_at {0}"


def entries(results: DataFrame, written_at: Column, ttl_hours: float = RESULT_TTL_HOURS) -> DataFrame:
    """Store rows from results ``(key, value, ...)``."""
    ttl = F.expr(f"INTERVAL '{int(ttl_hours * 3600)}' SECOND")
    return results.select(
        "key",
        "value",
        written_at.alias("written_at"),
        (written_at + ttl).alias("expires_at"),
    )


def newest(store: DataFrame) -> DataFrame:
    """The entry that counts for each key; equal times are settled by value."""
    last = F.max(F.struct("written_at", "value", "expires_at")).alias("_last")
    return (
        store.groupBy("key")
        .agg(last)
        .select("key", "_last.value", "_last.written_at", "_last.expires_at")
    )


def live(store: DataFrame, as_of: Column) -> DataFrame:
    """Unexpired newest entries.  An expired newest write hides older ones."""
    return newest(store).where(F.col("expires_at") > as_of)


def lookup(keys: DataFrame, store: DataFrame, as_of: Column) -> DataFrame:
    """``(key, value, found)`` for ``keys(key)``; a miss or an expired entry has no value.

    The store side has each key once; a key asked for very often is split by the
    adaptive skew join.
    """
    hits = live(store, as_of).select("key", "value", F.lit(True).alias("_found"))
    return keys.join(hits, "key", "left").select(
        "key", "value", F.coalesce("_found", F.lit(False)).alias("found")
    )


def delete(store: DataFrame, keys: DataFrame) -> DataFrame:
    """The store without ``keys(key)``."""
    return store.join(keys.select("key").distinct(), "key", "left_anti")


def clear(store: DataFrame) -> DataFrame:
    return store.limit(0)


def item_count(store: DataFrame, as_of: Column) -> DataFrame:
    """One row ``(n_items, n_expired)``: live entries, and entries only waiting for removal."""
    current = newest(store)
    alive = F.col("expires_at") > as_of
    return current.agg(F.count_if(alive).alias("n_items"), F.count_if(~alive).alias("n_expired"))


def append(store_rows: DataFrame, path: str) -> None:
    store_rows.select(STORE_COLUMNS).write.mode("append").parquet(path)


def compact(store: DataFrame, as_of: Column, path: str) -> None:
    """Write a fresh copy with only live entries (the periodic clean-up)."""
    live(store, as_of).select(STORE_COLUMNS).write.mode("errorifexists").parquet(path)


class RunStore:
    """A store in a folder of its own, written as runs that are bucketed and sorted by key.

    A put moves the rows put and nothing that is stored: first they are reduced
    to the newest entry of each key, with map-side combine, so a key written very
    often is one row by the time it reaches its bucket.  Readers find all runs
    laid out by key alike, so neither picking the newest entry nor looking up
    keys moves a stored value.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, time_type: str = "TIMESTAMP_NTZ"):
        self.spark, self.path, self.buckets, self.time_type = spark, path, buckets, time_type
        self._log = KeyedLog(spark, "key", buckets, f"{path}/runs", STORE_SCHEMA.format(time_type))

    @staticmethod
    def create(spark: SparkSession, path: str, buckets: int, time_type: str = "TIMESTAMP_NTZ") -> RunStore:
        """A new empty store; the number of buckets stays as it is for good."""
        layout = spark.range(1).selectExpr(f"{buckets} AS buckets", f"'{time_type}' AS time_type")
        layout.coalesce(1).write.mode("errorifexists").json(f"{path}/layout")
        return RunStore(spark, path, buckets, time_type)

    @staticmethod
    def open(spark: SparkSession, path: str) -> RunStore:
        layout = spark.read.schema("buckets INT, time_type STRING").json(f"{path}/layout").first()
        return RunStore(spark, path, layout["buckets"], layout["time_type"])

    def put(self, rows: DataFrame) -> None:
        """Append a run of store rows; of one key the newest is kept."""
        with shuffle_partitions(self.spark, self.buckets):
            self._log.append(newest(rows.select(STORE_COLUMNS).where("key IS NOT NULL")).select(STORE_COLUMNS))

    def rows(self) -> DataFrame:
        return self._log.rows()

    def newest(self) -> DataFrame:
        return newest(self.rows())

    def get(self, keys: DataFrame, as_of: Column) -> DataFrame:
        """``(key, value, found)`` for each distinct key of ``keys(key)``; only these keys are moved."""
        asked = keys.select("key").distinct().repartition(self.buckets, "key")
        return lookup(asked, self.rows(), as_of)

    def delete(self, keys: DataFrame, at: Column) -> None:
        """Append entries without value that are expired from the start; they hide older ones of their keys."""
        self.put(keys.select("key", F.lit(None).cast("string").alias("value"), at.alias("written_at"), at.alias("expires_at")))

    def item_count(self, as_of: Column) -> DataFrame:
        return item_count(self.rows(), as_of)

    def compact(self, as_of: Column, path: str) -> RunStore:
        """A fresh store at ``path`` with one run of the live entries; buckets are copied where they lie."""
        fresh = RunStore.create(self.spark, path, self.buckets, self.time_type)
        fresh.put(live(self.rows(), as_of))
        return fresh

"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import posixpath
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.session import new_folder


def texts_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text)`` and nothing else, so that extra columns cannot clash; NULL text is empty."""
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Later stages read only the columns they need, and a lost executor costs no
    more than a read.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Empties written tables that no later step reads, by writing no rows over them.

    Whatever was made from them has to be written by now.
    """
    for table in tables:
        spark = table.sparkSession
        for path in {posixpath.dirname(file) for file in table.inputFiles()}:
            spark.createDataFrame([], table.schema).coalesce(1).write.mode("overwrite").parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps that nothing refers to any more.

    Spark does so when the driver collects its garbage, which may be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def collect_garbage(spark: SparkSession) -> None:
    """Has executors collect their garbage, and so give heap that earlier steps have filled back to the system.

    They would keep it otherwise, and the next step's Python workers would come
    on top.  One task a core reaches all of them.  Where explicit collections are
    turned off, nothing happens; results do not depend on it.
    """
    cores = spark.sparkContext.defaultParallelism
    collected = spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc') AS done")
    collected.write.format("noop").mode("overwrite").save()


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Keeps Arrow batches of what runs inside to ``size`` bytes; then the session's own setting holds again."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, f"{size}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)

"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BYTES_PER_BUCKET = 256 * 1024 * 1024


_local_folders: dict[str, str] = {}  # application id -> folder, local mode only


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; in local mode a temporary one if it names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is not None:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="pageloom-")
    return _local_folders[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh place for a table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and go on from there.

    Loops use it once per round, so a lost executor costs one round of work at
    most.  Partitioning is kept.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def written(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` as a Parquet table in the shared folder, which is emptied afterwards.

    What reads it several times, or some of its columns, does not make ``df`` again.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        spark.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Size of the files ``df`` is made from; nothing is run.

    The estimate of the whole plan is no use here: it multiplies the sizes of
    joined tables, and a checkpointed table keeps such an estimate.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    each = (leaves.apply(i) for i in range(leaves.size()))
    return sum(int(leaf.stats().sizeInBytes()) for leaf in each if leaf.nodeName() != "LogicalRDD")


def buckets_for(size: int, least: int, most: int) -> int:
    """Buckets for ``size`` bytes; beyond ``most`` of them, which Spark allows, they only get larger."""
    return min(max(least, -(-size // BYTES_PER_BUCKET)), most)


def bucket_count(source: DataFrame) -> int:
    """Buckets for tables made from ``source``: by the size of its files, at least one per core."""
    spark = source.sparkSession
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    size = estimated_bytes(source)
    # Without files the size is unknown, and the session's own setting has to do.
    least = spark.sparkContext.defaultParallelism if size else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return buckets_for(size, least, most)


def store_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as Parquet bucketed by ``key`` in the shared folder, and read it back.

    Cuts lineage like a checkpoint does, but readers get only the columns they
    need, and joins, groupings and windows on the key need no further shuffle.
    ``df`` must be repartitioned by ``key`` into ``buckets``, so that every task
    writes one file.  The table leaves no name behind.
    """
    spark = df.sparkSession
    name = f"pageloom_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(buckets, key).option("path", new_folder(spark, name))
    writer.saveAsTable(name)
    stored = spark.table(name)
    stored.schema  # resolved before the name goes away
    spark.sql(f"DROP TABLE {name}")
    return stored


class KeyedLog:
    """An append-only table bucketed by a key and sorted by it within a file, in the shared folder.

    Each append adds files of its own and leaves the others alone.  All rows
    appended so far are one table, and joins and groupings by the key need no
    shuffle of it.  Rows partitioned by the key into as many parts are written
    as one file a bucket.  ``path`` and ``schema`` take up a log written before.
    """

    def __init__(self, spark: SparkSession, key: str, buckets: int, path: str | None = None, schema: str | None = None):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.name = f"pageloom_{uuid.uuid4().hex}"
        self.path = path or new_folder(spark, self.name)
        if schema is not None:
            layout = f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS"
            spark.sql(f"CREATE TABLE {self.name} ({schema}) USING parquet {layout} LOCATION '{self.path}'")

    def append(self, df: DataFrame) -> None:
        writer = df.write.format("parquet").mode("append").bucketBy(self.buckets, self.key).sortBy(self.key)
        writer.option("path", self.path).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def close(self) -> DataFrame:
        """All rows; the table leaves no name behind."""
        rows = self.rows()
        rows.schema  # resolved before the name goes away
        self.spark.sql(f"DROP TABLE {self.name}")
        return rows


@contextmanager
def shuffle_partitions(spark: SparkSession, number: int) -> Iterator[None]:
    """Shuffles planned inside make ``number`` parts; then the session's own setting holds again."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(number))
    try:
        yield
    finally:
        spark.conf.set(key, before)

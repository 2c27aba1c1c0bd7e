"""Sources of captured pages: ``pages(page_id BIGINT, url STRING, html STRING)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captured pages from Parquet, ORC or JSON Lines files."""
    return spark.read.format(fmt).schema(PAGE_SCHEMA).load(path)


def read_page_files(spark: SparkSession, path: str, url_prefix: str) -> DataFrame:
    """One HTML document per file; the URL is ``url_prefix`` plus the path below ``path``.

    File contents are read as whole values, one row per file.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.substring_index(F.input_file_name(), path.rstrip("/"), -1)
    return files.select(
        F.xxhash64(name).alias("page_id"),
        F.concat(F.lit(url_prefix.rstrip("/")), name).alias("url"),
        F.col("value").alias("html"),
    )


def stream_pages(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Pages that arrive as new files below ``path``."""
    return (
        spark.readStream.format(fmt)
        .schema(PAGE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )

"""Exact ranks within groups of any size.

A window over one group runs in one task, which fails when a group holds a
third of all rows.  Here rows are range-partitioned by group and order, so a
large group spreads over many tasks; a row's rank is its place within its
partition plus the group's rows in the partitions before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import cut_lineage

SMALL_LIMIT = 100


def ordered_rank(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rank"
) -> DataFrame:
    """Adds ``name``: 1, 2, 3 ... within ``group`` by ``order``, which must have no ties.

    The ranged rows are stored first, so that both passes see the same
    partitions even if executors are lost in between.
    """
    keys = [*group, *order]
    ranged = df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    stored = cut_lineage(ranged)
    local = Window.partitionBy("_part", *group).orderBy(*order)
    counts = stored.groupBy("_part", *group).agg(F.count("*").alias("_n"))
    # One row per group and partition it touches: partitions plus groups, not rows.
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # Null-safe, so that rows without a group keep their ranks as a group of their own.
    ranked, same = stored.withColumn("_local", F.row_number().over(local)), F.lit(True)
    offsets = offsets.drop("_n").withColumnsRenamed({key: f"_of_{key}" for key in ["_part", *group]})
    for key in ["_part", *group]:
        same &= ranked[key].eqNullSafe(offsets[f"_of_{key}"])
    return (
        ranked.join(offsets, same)
        .drop(*(f"_of_{key}" for key in ["_part", *group]))
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop("_part", "_local", "_before")
    )


def first_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[str], size: int
) -> DataFrame:
    """The first ``size`` rows of every group by ``order``.

    A small ``size`` is a window limit, which Spark applies before the shuffle
    as well, so a task gets at most ``size`` rows of a group per input partition.
    A larger one would let a hot group fill one task, so it goes by exact ranks.
    """
    return first_ranks(df, group, order, size, "_rank").drop("_rank")


def first_ranks(
    df: DataFrame, group: Sequence[str], order: Sequence[str], size: int, name: str = "rank"
) -> DataFrame:
    """Like ``first_per_group``, with the rows' ranks as ``name``."""
    if size > SMALL_LIMIT:
        return ordered_rank(df, group, order, name).where(F.col(name) <= size)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, place).where(F.col(name) <= size)


def paced(
    df: DataFrame, group: Sequence[str], order: Sequence[str], at: str, step: int, name: str = "paced"
) -> DataFrame:
    """Adds ``name``: within ``group`` by ``order``, the least numbers not below ``at`` that grow by ``step`` or more.

    That is ``max(at, the one before + step)``, a recurrence in which row ``i``
    takes ``i * step`` plus the largest ``at - j * step`` of the rows up to it.
    Maxima and counts of range partitions combine in any grouping, so a group of
    any size spreads over tasks.  ``order`` must have no ties.
    """
    keys = [*group, *order]
    stored = cut_lineage(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part", *group).orderBy(*order)
    ahead = F.col(at) - F.col("_local") * F.lit(step)
    ranked = stored.withColumn("_local", F.row_number().over(local).cast("bigint")).withColumn("_ahead", ahead)
    parts = ranked.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.max("_ahead").alias("_most"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    parts = parts.withColumn("_top", F.max(F.col("_most") - F.col("_before") * F.lit(step)).over(before))
    parts = parts.drop("_n", "_most").withColumnsRenamed({key: f"_of_{key}" for key in ["_part", *group]})
    running = ranked.withColumn("_run", F.max("_ahead").over(local))
    same = F.lit(True)
    for key in ["_part", *group]:
        same &= running[key].eqNullSafe(parts[f"_of_{key}"])
    place = F.col("_local") + F.col("_before")
    most = F.greatest(F.col("_run") - F.col("_before") * F.lit(step), F.col("_top"))
    return (
        running.join(parts, same)
        .withColumn(name, most + place * F.lit(step))
        .select(*df.columns, name)
    )

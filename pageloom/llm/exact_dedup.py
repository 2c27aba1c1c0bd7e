"""Exact dedup by an extendible-hash index kept in shared files.

Every text has a key, a 64-bit hash.  The index is a directory over the leading
bits of the key: it starts with one bucket, and while a bucket holds more keys
than ``capacity`` the directory doubles and the overfull buckets split.  Buckets
are ranges of the key, so the range partitions of the index file have owner
tasks, each with whole buckets.  In a bucket, texts with one key form a chain:
the chain is found by comparing the bytes of the texts themselves, as the
grouping key of an aggregate.  Only texts whose key occurs twice are compared;
all other texts stay where they are.

Copies are combined before each shuffle, so a group may hold any share of the
rows.  Everything is DataFrame operations.

Defined results: NULL text equals the empty text; of equal texts the row with
the largest ``doc_id`` stays (NULL is smaller than any id); rows repeated with
one ``doc_id`` count in ``group_size`` and are all kept or all dropped; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.tables import stored, texts_of

CAPACITY = 200_000
SPARE_BITS = 3


def text_key(text: str = "text", key_bits: int = 64) -> Column:
    """The hash of a text; fewer bits make keys collide, for tests."""
    key = F.xxhash64(text)
    return key if key_bits >= 64 else F.shiftleft(key, 64 - key_bits)


def _leading(bits: int) -> Column:
    """The leading bits of ``key`` in the order of signed numbers, so that slots are key ranges."""
    return F.shiftright("key", 64 - bits) + F.lit(1 << (bits - 1)) if bits else F.lit(0).cast("bigint")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(slot, depth, bucket)`` for all slots that hold keys: the directory after its last doubling.

    A slot is the leading ``global depth`` bits of a key.  The keys are counted
    once by a few more bits than the buckets are expected to need; doubling
    works on these counts, whose number is bound by keys / capacity.
    """
    expected = max(1, -(-keys.count() // capacity))
    bits = min(40, (expected - 1).bit_length() + SPARE_BITS)
    cells = stored(keys.groupBy(_leading(bits).alias("cell")).agg(F.count("*").alias("n")), "cells")
    depths = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")
    prefix = F.expr(f"shiftright(cell, {bits} - depth)")
    loads = (
        cells.select("cell", "n", depths)
        .groupBy("depth", prefix.alias("prefix"))
        .agg(F.sum("n").alias("load"))
    )
    # A bucket stops splitting at the first depth at which it is not overfull.
    fits = loads.where((F.col("load") <= capacity) | (F.col("depth") == bits))
    return (
        cells.select("cell", depths)
        .withColumn("prefix", prefix)
        .join(fits, ["depth", "prefix"])
        .groupBy(F.col("cell").alias("slot"))
        .agg(F.min("depth").alias("depth"))
        .withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {bits} - depth), {bits} - depth)"))
        .withColumn("bits", F.lit(bits))
    )


def build_index(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """``entries`` (one row per document) and ``chains`` (one row per different text)."""
    texts = texts_of(docs).withColumn("key", text_key("text", key_bits))
    entries = stored(
        texts.select("doc_id", "key", F.unhex(F.sha2("text", 256)).alias("digest")), "entries"
    )
    heads = stored(
        entries.groupBy("key").agg(
            F.count("*").alias("n"), F.max("doc_id").alias("keep_id"), F.max("digest").alias("digest")
        ),
        "heads",
    )
    repeated = heads.where("n > 1").select("key")
    # Chains by comparing bytes: the text is a grouping key, and copies meet before the shuffle.
    compared = (
        texts.join(_sized(repeated), "key", "left_semi")
        .groupBy("key", "text")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))
        .select("key", "n", "keep_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    )
    chains = heads.where("n = 1").select(compared.columns).unionByName(compared)
    slots = directory(heads, capacity)
    bits = slots.agg(F.max("bits")).first()[0] or 1
    placed = (
        chains.withColumn("slot", _leading(bits))
        .join(_sized(slots.select("slot", "depth", "bucket")), "slot")
        .drop("slot")
    )
    # Owner tasks: whole key ranges, and with them whole buckets, in order of the key.
    owned = placed.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "keep_id")
    return entries, stored(owned, "index")


MAX_BROADCAST_ROWS = 500_000


def _sized(narrow: DataFrame) -> DataFrame:
    """Marks a table of a few numbers a row for broadcast if its counted size allows it."""
    small = narrow.count() <= MAX_BROADCAST_ROWS
    return F.broadcast(narrow) if small else narrow.hint("merge")


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``."""
    entries, chains = build_index(docs, capacity, key_bits)
    chain = chains.select("key", "digest", "keep_id", F.col("n").alias("group_size"))
    return entries.hint("merge").join(chain, ["key", "digest"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The rows that go are the smaller set, so the texts of the others do not move
    while the list of these is small.
    """
    gone = exact_groups(docs, **settings).where("NOT kept")
    listed = stored(gone.select("doc_id", F.unhex("text_sha256").alias("digest")), "dropped")
    same_id = docs["doc_id"].eqNullSafe(listed["doc_id"])
    same_text = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256)) == listed["digest"]
    return docs.join(_sized(listed), same_id & same_text, "left_anti")

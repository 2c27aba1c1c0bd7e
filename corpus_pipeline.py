"""From raw documents to packed training sequences, a stage at a time.

Each stage takes what its predecessor kept, as a table that was written and read
again, and has the executors give back first what memory their heaps have free.
All stages but the last return the columns of ``documents``, other
columns of any name included.

Defined results: an empty table stays empty; NULL text is empty text, and stays
NULL in what is kept.  A row that repeats another as it is shares its fate.  If
texts share an id and one of them is rejected, all rows with that id go.  Rows
without an id stay, unless a row with an id has the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import exact_dedup, ngram_join, packing, quality, secret_scan
from pageloom.llm.queries import BYTE_BPE
from pageloom.llm.tables import arrow_batches, collect_garbage, stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    The rejected ones are the smaller set, so only their ids are joined.
    """
    collect_garbage(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    with arrow_batches(spark, BATCH_BYTES):
        judged = quality.classify(docs, labels)
        rejected = stored(judged.where("predicted = 0").selectExpr("doc_id AS _rejected").distinct(), "rejected")
    return docs.join(exact_dedup._sized(rejected), docs["doc_id"] == rejected["_rejected"], "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    collect_garbage(spark)
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar word shingles the one with the least id."""
    collect_garbage(spark)
    return ngram_join.keep_one(docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; written here, while the size of batches holds."""
    collect_garbage(spark)
    with arrow_batches(spark, BATCH_BYTES):
        return stored(secret_scan.blank_out(docs), "blanked")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    collect_garbage(spark)
    with arrow_batches(spark, BATCH_BYTES):
        return packing.pack(docs, BYTE_BPE, remembered=REMEMBERED_BYTES)


#: Workers and their executor hold a batch of texts several times over, and what they allocate for it stays with them
#: in later stages.  So stages that hand whole texts to Python bound their batches themselves.
BATCH_BYTES = 4 << 20
#: Chunks a worker remembers when it packs: less than a job that packs alone, as the earlier stages' heap is still there.
REMEMBERED_BYTES = 32 << 20
STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_copies", drop_near_copies),
    ("secrets", blank_secrets),
    ("packing", pack_sequences),
]

#: Trained weights and a tokenizer are no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

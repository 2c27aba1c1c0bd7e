"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal.

A text is cut at white space, and a word of more than 64 characters (or a text
without white space) into consecutive pieces of 64 that count as words.  Each word has two codes: a hash of its lower-case
form and a hash of its shape (letter case, digits and punctuation, runs
collapsed); a word equal to the one before it gets a code of its own for both.
Features are the hashed 1- and 2-grams of words and the 1- to 3-grams of shapes,
valued by their counts and scaled to length one.

Training takes at most ``max_rows`` labelled rows (the bound; a hash of the id
chooses them), deals them into ``shards`` tasks that each run
follow-the-regularised-leader over their rows, and averages the weights by the
rows that made them.  A score is a sparse dot product with those weights, which
are ``2 ** bits`` numbers at most, whatever the corpus holds.

Defined results: NULL and empty texts have the bias alone; without any label
all scores are 0.5; rows with NULL labels or ids do not train; a document
labelled both ways counts by the majority, a draw as 1; repeated rows are each
scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.memory import Remembered, give_back
from pageloom.llm.tables import texts_of

BITS = 18
MAX_ROWS = 12_000
SHARDS = 4
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05
PIECE = 64
_SAME = np.uint64(0x5A5A5A5A3C3C3C3C)
_RUN = re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    """``Ab12!!`` gives ``Xx9!``: upper, lower, digits, and runs of other characters."""
    marks = "".join(
        "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word
    )
    return _RUN.sub(r"\1", marks)


class WordCodes(Remembered):
    """Codes of words met lately in this Python worker."""

    def __missing__(self, word: str) -> int:
        code = self.earlier.get(word)
        if code is None:
            lower = zlib.crc32(word.lower().encode("utf-8", "replace"))
            code = lower << 32 | zlib.crc32(shape(word).encode("utf-8", "replace"))
        if len(word) <= PIECE:
            self.keep(word, code, 200 + len(word))
        return code


_codes = WordCodes(48 << 20)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt * 0x9E3779B9 + 1)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature indices and their values; index 0 is the bias."""
    words = text.split()
    if max(map(len, words), default=0) > PIECE:
        words = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    codes = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    if len(codes) > 1:
        same = codes[1:] == codes[:-1]
        codes[1:][same] = _SAME
    word, form = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
    step = np.uint64(0x100000001B3)
    grams = [_mix(word, 1), _mix(form, 2)]
    if len(codes) > 1:
        pairs = form[:-1] * step + form[1:]
        grams += [_mix(word[:-1] * step + word[1:], 3), _mix(pairs, 4)]
        if len(codes) > 2:
            grams.append(_mix(pairs[:-1] * step + form[2:], 5))
    index = (np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64)
    index, counts = np.unique(index[index > 0], return_counts=True)
    value = np.sqrt(counts.astype(np.float64))
    value /= max(1.0, float(np.sqrt((value * value).sum())))
    return np.append(index, 0), np.append(value, 1.0)


def ftrl(rows: list[tuple[str, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes of follow-the-regularised-leader over ``rows``."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def leader(i: np.ndarray) -> np.ndarray:
        pull = np.maximum(np.abs(z[i]) - L1, 0) * -np.sign(z[i])
        return pull / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    sparse = [(*features(text, bits), label) for text, label in rows]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(sparse)):
            i, x, label = sparse[k]
            w = leader(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return leader(np.arange(1 << bits))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS,
          shards: int = SHARDS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights learned from ``labels`` ``(doc_id, quality)``; the caller leaves held-out rows away."""
    sample = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.when(F.avg("quality") >= 0.5, 1).otherwise(0).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The shard holds max_rows / shards labelled rows, whatever the corpus holds.
        rows = [r for b in batches for r in zip(b["text"].to_pylist(), b["label"].to_pylist(), b["doc_id"].to_pylist())]
        rows.sort(key=lambda r: (r[2], r[0]))
        if rows:
            w = ftrl([r[:2] for r in rows], bits, epochs)
            i = np.flatnonzero(w)
            yield pa.RecordBatch.from_pydict(
                {"i": pa.array(i, pa.int32()), "w": pa.array(w[i] * len(rows), pa.float64()),
                 "n": pa.array(np.full(len(i), len(rows)), pa.int64())})
        del rows
        give_back()

    # max_rows pairs of numbers at most: a proven bound for the broadcast.
    known = texts_of(docs).join(F.broadcast(sample), "doc_id")
    shard = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards))
    learned = known.repartition(shards, shard).mapInArrow(learn, "i int, w double, n bigint")
    # At most 2 ** bits rows: the size of the model, not of the corpus. The bias has every shard's rows.
    parts = learned.groupBy("i").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).toPandas()
    weights = np.zeros(1 << bits)
    weights[parts["i"].to_numpy(np.int64)] = parts["w"].to_numpy() / max(1, parts["n"].max() if len(parts) else 1)
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(doc_id, score)`` of every whole text."""
    bits = len(weights).bit_length() - 1
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            sums = np.zeros(batch.num_rows)
            for k, text in enumerate(batch["text"]):
                i, x = features(text.as_py(), bits)
                sums[k] = w[i] @ x
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch["doc_id"], "score": pa.array(1 / (1 + np.exp(-np.clip(sums, -30, 30))))}
            )
        give_back()

    return texts_of(docs).mapInArrow(dot, "doc_id bigint, score double")


def held_out(doc_id: str = "doc_id"):
    """The fold that never trains."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def classify(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    weights = train(docs, labels.where(~held_out()), **settings)
    return score(docs, weights).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

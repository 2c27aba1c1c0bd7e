"""Importance resampling towards a target: draw the documents that look most like another table's texts.

Features are runs of words, hashed into buckets.  A bucket's gain is the
logarithm of how much likelier it is in the target than in the corpus; a
document's weight adds up the gains of its features, looked up in one array.
Gumbel noise, fixed by the document's id, turns "the highest scores" into a draw
without replacement by weight.

The draw sorts nothing but the drawn.  Scored rows are stored with a row number,
so that the key (score, id, row) has no ties.  The k-th key is found by
quickselect: random keys are pivots, a count of the rows below, at and above
each of them tells where the k-th is, and only the rows between two neighbours
go into the next round.  Rows up to that key are then range-partitioned and
ranked.

The driver holds one number a bucket, a few pivots and their counts.

Defined results: texts that are NULL or empty have no features, weight 0 and are
never drawn if a least number of words is asked for; a NULL id counts as an
empty one for the noise and comes last in ties; repeated rows take part each;
with an empty target or corpus its counts are 0; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import let
from pageloom.llm.tables import stored, texts_of
from pageloom.llm.words import words
from pageloom.operators.ranking import ordered_rank

BUCKETS, RUN, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024
PIVOTS = 24


def buckets_of(text: str, buckets: int = BUCKETS, run: int = RUN) -> str:
    """``struct<n_words, b>``: the number of words and the bucket of every feature, as an SQL expression."""
    def hashed(found: str) -> str:
        def runs(n: int) -> str:
            if n == 1:
                return f"transform({found}, w -> crc32(w) % {buckets})"
            ends = f"sequence(1, size({found}) - {n - 1})"
            each = f"transform({ends}, i -> crc32(array_join(slice({found}, i, {n}), ' ')) % {buckets})"
            return f"if(size({found}) < {n}, CAST(array() AS array<bigint>), {each})"

        parts = ", ".join(runs(n) for n in range(1, run + 1))
        return f"named_struct('n_words', size({found}), 'b', {f'concat({parts})' if run > 1 else parts})"

    return let(words(text), hashed)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> list[int]:
    """How many features of all ``texts(text)`` fall into each bucket; added up within tasks first."""
    each = texts.select(F.explode(F.expr(f"{buckets_of('text', buckets, run)}.b")).alias("b"))
    counts = [0] * buckets
    for row in each.groupBy("b").count().collect():  # at most ``buckets`` rows
        counts[row["b"]] = row["count"]
    return counts


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Gain of each bucket, in thousandths."""
    n, all_corpus, all_target = len(corpus), sum(corpus), sum(target)
    return [
        math.floor(1000 * math.log(float((t + 1) * (all_corpus + n)) / float((s + 1) * (all_target + n))))
        for s, t in zip(corpus, target)
    ]


def scores(docs: DataFrame, gain: list[int], run: int = RUN, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` of every whole text."""
    table = f"CAST(split('{','.join(map(str, gain))}', ',') AS array<bigint>)"
    sums = let(table, lambda g: f"aggregate(f.b, 0L, (s, b) -> s + {g}[CAST(b AS INT)])")
    name = f"concat('{seed}:', coalesce(CAST(doc_id AS string), ''))"
    uniform = f"(CAST(conv(substring(sha2({name}, 256), 1, 8), 16, 10) AS bigint) + 0.5D) / 4294967296D"
    return (
        texts_of(docs)
        .selectExpr("doc_id", f"{buckets_of('text', len(gain), run)} AS f")
        .selectExpr(
            "doc_id", "CAST(f.n_words AS bigint) AS n_words", "CAST(size(f.b) AS bigint) AS n_features",
            f"{sums} AS weight", f"floor(-1000 * ln(-ln({uniform}))) AS noise",
        )
        .selectExpr("doc_id", "n_words", "n_features", "weight", "weight + noise AS score")
    )


# -- quickselect ----------------------------------------------------------------------------

#: Ascending from the best: highest score, then smallest id, then first row.
KEY = ("-score", "doc_id IS NULL", "coalesce(doc_id, 0)", "row")
_KEY = f"named_struct('s', {KEY[0]}, 'n', {KEY[1]}, 'd', {KEY[2]}, 'r', {KEY[3]})"
Key = tuple[int, bool, int, int]


def _literal(key: Key) -> str:
    score, null, doc_id, row = key
    return f"named_struct('s', {score}L, 'n', {str(null).lower()}, 'd', {doc_id}L, 'r', {row}L)"


def _between(low: Key | None, high: Key | None) -> str:
    """Condition on rows strictly between two keys; scores alone reach the files."""
    tests = ["true"]
    if low is not None:
        tests += [f"score <= {-low[0]}L", f"{_KEY} > {_literal(low)}"]
    if high is not None:
        tests += [f"score >= {-high[0]}L", f"{_KEY} < {_literal(high)}"]
    return " AND ".join(tests)


def kth_key(scored: DataFrame, k: int, pivots: int = PIVOTS) -> Key:
    """The ``k``-th key (from 1) of ``scored(doc_id, score, row)``, which has at least ``k`` rows.

    A round leaves about 2 in ``pivots`` of its rows; it ends for sure when all
    that are left are pivots themselves.
    """
    low = high = None
    before = turn = 0
    while True:
        inside = scored.where(_between(low, high))
        dealt = inside.selectExpr(*(f"{e} AS k{i}" for i, e in enumerate(KEY)), f"xxhash64(row, {turn}) AS h")
        chosen = dealt.orderBy("h", "k3").limit(pivots).collect()
        keys = sorted(tuple(r[f"k{i}"] for i in range(4)) for r in chosen)
        table = f"array({', '.join(map(_literal, keys))})"
        parts = inside.groupBy(
            F.expr(let(table, lambda t: f"size(filter({t}, p -> p < {_KEY}))")).alias("below"),
            F.expr(f"array_contains({table}, {_KEY})").alias("at"),
        ).count()
        counts = {(r["below"], r["at"]): r["count"] for r in parts.collect()}  # two rows a pivot at most
        for i in range(len(keys) + 1):
            between = counts.get((i, False), 0)
            if k <= before + between:
                low, high = keys[i - 1] if i else low, keys[i] if i < len(keys) else high
                break
            before += between
            same = counts.get((i, True), 0)
            if k <= before + same:
                return keys[i]
            before += same
        else:
            raise ValueError("fewer rows than asked for")
        turn += 1


def resample(
    docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS, run: int = RUN, seed: int = SEED,
) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every document; ``rank`` is NULL for those not drawn.

    Of the documents with ``least_words`` words or more, ``percent`` in a
    hundred (rounded down) are drawn.  ``target`` has a column ``text``.
    """
    corpus = bucket_counts(texts_of(docs), buckets, run)
    wanted = bucket_counts(target.selectExpr("coalesce(text, '') AS text"), buckets, run)
    found = scores(docs, gains(corpus, wanted), run, seed)
    # Numbers of the rows are fixed once they are written.
    scored = stored(found.withColumn("row", F.monotonically_increasing_id()), "scored")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    drawable = f"n_words >= {least_words}"
    k = scored.where(drawable).count() * percent // 100
    if k == 0:
        return scored.selectExpr(*columns, "CAST(NULL AS bigint) AS rank")
    last = _literal(kth_key(scored.where(drawable), k))
    drawn = f"({drawable} AND {_KEY} <= {last})"
    keyed = scored.where(drawn).selectExpr(*columns, *(f"{e} AS k{i}" for i, e in enumerate(KEY)))
    ranked = ordered_rank(keyed, [], ["k0", "k1", "k2", "k3"])
    return ranked.selectExpr(*columns, "CAST(rank AS bigint) AS rank").unionByName(
        scored.where(f"NOT {drawn}").selectExpr(*columns, "CAST(NULL AS bigint) AS rank")
    )

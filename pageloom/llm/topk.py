"""Exact top-k search by columnar branch and bound.

Vectors are whole numbers, ``floor(1024 * x)`` of each component.  A block of
candidates is laid out by dimension.  For one query, products are added a block
of dimensions at a time; what the dimensions still to come can add is bound by
the product of the remaining lengths (Cauchy-Schwarz).  A candidate whose bound
lies under the query's tenth best so far goes, and the survivors are compacted,
so that later dimensions are read for few candidates.

Queries are dealt in blocks of ``query_rows``, the proven bound of what is
broadcast; every task searches its own rows for a block, and only its k best per
query are shuffled.  A block's results are written before the next block is
read, so the driver and the executors hold one block at a time.

Defined results: vectors that are NULL, empty, or hold NULL or non-finite
components take no part; a query meets candidates of its own length only; rows
that share a ``vec_id`` count as one candidate by its best score, and a query
never meets its own ``vec_id``; ties go to the smaller ``vec_id``.  Components
so large that sums could leave 53 bits are added with whole numbers of any size;
a score beyond 64 bits is an error, never a wrong number.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import new_folder

SCALE = 1024
K = 10
QUERY_ROWS = 16_384
CANDIDATE_ROWS = 8_192
DIMENSIONS = 8
_SAFE = 2.0**52


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of the rows that take part; components scaled, not yet floored."""
    v = f"transform(embedding, x -> CAST(x AS DOUBLE) * {SCALE})"
    fine = "embedding IS NOT NULL AND size(embedding) > 0 AND vec_id IS NOT NULL AND forall(embedding, x ->" \
        " x IS NOT NULL AND NOT isnan(x) AND abs(CAST(x AS DOUBLE)) < double('infinity'))"  # fmt: skip
    return embeddings.where(fine).selectExpr("vec_id", f"{v} AS v")


def _matrices(ids: list, rows: list[list[float]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and dimension-by-row matrices, one for each length of vector."""
    by_size = defaultdict(list)
    for i, row in zip(ids, rows):
        by_size[len(row)].append((i, row))
    for group in by_size.values():
        yield (
            np.array([i for i, _ in group], np.int64),
            np.floor(np.ascontiguousarray(np.array([r for _, r in group], np.float64).T)),
        )


def _rest(matrix: np.ndarray, edges: list[int]) -> np.ndarray:
    """Length of what each column holds from every edge on."""
    square = matrix * matrix
    return np.array([np.sqrt(square[e:].sum(axis=0)) for e in edges])


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, then id; an id counts once."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first], scores[first]


def search_block(query_id: int, q: np.ndarray, q_rest: np.ndarray, edges: list[int], ids: np.ndarray,
                 columns: np.ndarray, rest: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """The candidates of one block that may be among the query's k best.

    ``floor`` is the k-th best score so far, or minus infinity.
    """
    at = np.flatnonzero(ids != query_id)
    sums = np.zeros(len(at))
    for b, start in enumerate(edges):
        end = edges[b + 1] if b + 1 < len(edges) else len(q)
        sums = sums + q[start:end] @ (columns[start:end] if len(at) == len(ids) else columns[start:end, at])
        if end < len(q) and len(at) > k:
            reach = q_rest[b + 1] * rest[b + 1, at] * (1 + 1e-9) + 1
            low = sums - reach
            bound = max(floor, float(np.partition(low, len(low) - k)[len(low) - k]))
            live = sums + reach >= bound
            if not live.all():
                at, sums = at[live], sums[live]
    return ids[at], sums


def exact_scores(q: np.ndarray, columns: np.ndarray) -> list[int]:
    """Inner products with whole numbers of any size, for components too large for doubles."""
    whole = [int(x) for x in q]
    return [sum(a * int(b) for a, b in zip(whole, column)) for column in columns.T]


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = K, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: exact results for every row of ``queries``."""
    spark = embeddings.sparkSession
    schema, path = "query_id bigint, vec_id bigint, score bigint", new_folder(spark, "top_k")
    candidates, asked = whole_vectors(embeddings), whole_vectors(queries)
    blocks = max(1, math.ceil(asked.count() / query_rows))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    for b in range(blocks):
        # About query_rows queries: the bound of the broadcast.
        rows = asked.where(block == b).collect()
        prepared = []
        for ids, columns in _matrices([r[0] for r in rows], [r[1] for r in rows]):
            edges = list(range(0, len(columns), DIMENSIONS))
            prepared.append((ids, columns.T.copy(), _rest(columns, edges), edges))
        sent = spark.sparkContext.broadcast(prepared)
        candidates.mapInArrow(_searcher(sent, k), schema).write.mode("append").parquet(path)
        sent.destroy()
    found = spark.read.schema(schema).parquet(path)
    # An id may come from several tasks and a query's id from several rows: the best score counts.
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _searcher(sent, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, CANDIDATE_ROWS):
                part = batch.slice(start, CANDIDATE_ROWS)
                for ids, columns in _matrices(part["vec_id"].to_pylist(), part["v"].to_pylist()):
                    for g, (query_ids, queries, q_rests, edges) in enumerate(sent.value):
                        if queries.shape[1] != len(columns):
                            continue
                        rest = _rest(columns, edges)
                        large = rest[0].max() * q_rests[0].max() >= _SAFE
                        unique = len(np.unique(ids)) == len(ids)
                        for j, query_id in enumerate(query_ids):
                            old = best.get((g, j))
                            if large:
                                other = ids != query_id
                                new = ids[other], np.array(exact_scores(queries[j], columns[:, other]), object)
                            else:
                                floor = float(old[1][-1]) if old is not None and len(old[1]) == k else -np.inf
                                # Equal ids in a block would take several of the k places a bound counts.
                                need = k if unique else len(ids)
                                new = search_block(query_id, queries[j], q_rests[:, j], edges, ids, columns, rest, need, floor)
                            if old is not None:
                                new = np.concatenate([old[0], new[0]]), np.concatenate([old[1], new[1]])
                            best[g, j] = _best(*new, k)
        if best:
            keys = [(sent.value[g][0][j], v) for (g, j), v in best.items()]
            yield pa.RecordBatch.from_pydict(
                {
                    "query_id": pa.array(np.concatenate([np.full(len(v[0]), q) for q, v in keys]), pa.int64()),
                    "vec_id": pa.array(np.concatenate([v[0] for _, v in keys]), pa.int64()),
                    "score": pa.array([int(s) for _, v in keys for s in v[1]], pa.int64()),
                }
            )

    return search

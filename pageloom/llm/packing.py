"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens; full pieces are
sequences already.  How to pack the others depends on their lengths alone, so
the problem is the count of pieces by length: at most ``capacity`` numbers for
any corpus.  A solution is a list of groups: a bin's lengths, and how many bins
look like that.

Islands (Spark tasks) evolve solutions of that problem from perturbed best-fit
decreasing.  A crossover injects whole well-filled bins of one parent into the
other, takes what would then be there twice out of the other's bins (a bin that
loses a piece is dissolved), and best-fits the displaced pieces.  After each
epoch the elite of every island moves on to the next one.

Then the pieces take the places of the best solution: pieces of one length are
numbered, by hashed groups so that no length is one task's work, and a number
stands for a place in a bin.

Defined results: NULL text is empty and has the end token alone; repeated rows
are packed each; with an empty table the result is empty.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.llm.chunks import REMEMBERED_BYTES, ChunkEncoder
from pageloom.llm.tables import stored, texts_of

CAPACITY = 2048
END_ID = 0
ISLANDS, POPULATION, GENERATIONS, EPOCHS = 4, 4, 4, 2
#: More groups than this make a solution too large to hand on; best-fit itself stays far below.
MAX_GROUPS = 60_000
_encoders: dict[tuple[str, int], ChunkEncoder] = {}

#: A bin is the tuple of its lengths, longest first; a solution counts equal bins.
Solution = Counter


# -- pieces ---------------------------------------------------------------------------------


def document_ids(texts: list[str], path: str, remembered: int = REMEMBERED_BYTES) -> Iterator[np.ndarray]:
    """Token ids of each whole text and the end token; a worker remembers chunks of ``remembered`` bytes."""
    if (path, remembered) not in _encoders:
        _encoders[path, remembered] = ChunkEncoder(path, False, remembered)
    for _, packed in _encoders[path, remembered].batch(texts):
        yield np.frombuffer(b"".join([*packed, END_ID.to_bytes(4, "little")]), "<u4")


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces; only the first may be shorter than ``capacity``."""
    first = total % capacity or capacity
    starts = [0, *range(first, total, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], total])]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, remembered: int = REMEMBERED_BYTES) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every whole text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            encoded = document_ids(batch["text"].to_pylist(), path, remembered)
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoded):
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length])))
            columns = zip(*rows) if rows else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts_of(docs).mapInArrow(
        split, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


# -- the grouping genetic algorithm, on counts by length ------------------------------------


class _Spare:
    """Open bins by their spare room."""

    def __init__(self, capacity: int):
        self.rooms: list[Counter] = [Counter() for _ in range(capacity + 1)]

    def best_fit(self, need: int) -> int:
        """The least room of an open bin that holds ``need``, or 0."""
        for room in range(need, len(self.rooms)):
            if self.rooms[room]:
                return room
        return 0


def best_fit(counts: Counter, capacity: int, order: list[int], opened: Solution | None = None) -> Solution:
    """Puts ``counts`` pieces by length into bins, best fit first, lengths in ``order``.

    Equal pieces and equal bins are handled together, so the work follows the
    number of different lengths, not of pieces.  ``opened`` bins are filled up.
    """
    spare, full = _Spare(capacity), Solution()
    for shape, many in (opened or {}).items():
        spare.rooms[capacity - sum(shape)][shape] += many
    full.update(spare.rooms[0])
    for size in order:
        left = counts[size]
        while left:
            room = spare.best_fit(size)
            if not room:
                per = capacity // size
                # New bins get as many of these as fit: that is what best fit would do.
                bins, rest = divmod(left, per)
                for many, each in ((bins, per), (1, rest)):
                    if many and each:
                        shape = (size,) * each
                        target = full if each * size == capacity else spare.rooms[capacity - each * size]
                        target[shape] += many
                break
            shape, many = next(iter(spare.rooms[room].items()))
            per = min(room // size, left)
            bins = min(many, left // per)
            spare.rooms[room][shape] -= bins
            if not spare.rooms[room][shape]:
                del spare.rooms[room][shape]
            grown = tuple(sorted((*shape, *(size,) * per), reverse=True))
            (full if room == per * size else spare.rooms[room - per * size])[grown] += bins
            left -= bins * per
    for room in spare.rooms[1:]:
        full.update(room)
    return full


def fitness(solution: Solution, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (mean square of the fill); larger is better."""
    fill = sum(many * (sum(shape) / capacity) ** 2 for shape, many in solution.items())
    return -sum(solution.values()), fill


def contents(solution: Solution) -> Counter:
    held: Counter = Counter()
    for shape, many in solution.items():
        for size in shape:
            held[size] += many
    return held


def crossover(ours: Solution, theirs: Solution, counts: Counter, capacity: int, rng) -> Solution:
    """Whole well-filled bins of ``theirs`` injected into ``ours``."""
    shapes = sorted(theirs)
    fill = np.array([sum(s) for s in shapes]) / capacity
    chosen = np.flatnonzero((fill >= 0.995) & (rng.random(len(shapes)) < 0.5))
    child = Solution({shapes[k]: theirs[shapes[k]] for k in chosen})
    free = Counter(counts)
    free.subtract(contents(child))
    # What is there twice goes: a bin of ours stays as often as its pieces are still free.
    for shape in sorted(ours, key=lambda s: (-sum(s), s)):
        own = Counter(shape)
        many = min(ours[shape], min(free[size] // n for size, n in own.items()))
        if many > 0:
            child[shape] += many
            for size, n in own.items():
                free[size] -= n * many
    displaced = +free
    order = sorted(displaced, reverse=True)
    return best_fit(displaced, capacity, order, child)


def mutate(solution: Solution, capacity: int, rng) -> Solution:
    """Dissolves a part of the worst filled bins and best-fits their pieces."""
    shapes = sorted(solution, key=lambda s: (sum(s), s))
    gone = {s for s in shapes[: max(1, len(shapes) // 10)] if rng.random() < 0.7}
    kept = Solution({s: n for s, n in solution.items() if s not in gone})
    displaced = contents(Solution({s: solution[s] for s in gone}))
    return best_fit(displaced, capacity, _perturbed(displaced, rng, 0.05), kept)


def _perturbed(counts: Counter, rng, noise: float) -> list[int]:
    return sorted(counts, key=lambda s: -s * (1 + noise * rng.standard_normal()))


def evolve(counts: Counter, capacity: int, seed: int, elite: list[Solution], population: int,
           generations: int) -> Solution:
    """The best solution of one island after some generations."""
    rng = np.random.default_rng(seed)
    bound = -(-sum(s * n for s, n in counts.items()) // capacity)
    people = [*elite, best_fit(counts, capacity, sorted(counts, reverse=True))]
    while len(people) < population:
        people.append(best_fit(counts, capacity, _perturbed(counts, rng, 0.02)))
    rank = lambda s: fitness(s, capacity)
    for _ in range(generations):
        people = sorted((p for p in people if len(p) <= MAX_GROUPS or p is people[0]), key=rank, reverse=True)[:population]
        if sum(people[0].values()) <= bound:
            break
        ours, theirs = people[0], people[int(rng.integers(1, len(people)))] if len(people) > 1 else people[0]
        people.append(crossover(ours, theirs, counts, capacity, rng))
        people.append(mutate(people[-1], capacity, rng))
    return max(people, key=rank)


def _rows_of(solution: Solution, island: int) -> dict:
    return {
        "island": [island] * len(solution),
        "shape": [list(s) for s in solution],
        "many": list(solution.values()),
    }


def solve(spark: SparkSession, counts: Counter, capacity: int = CAPACITY, islands: int = ISLANDS,
          population: int = POPULATION, generations: int = GENERATIONS, epochs: int = EPOCHS) -> Solution:
    """Islands evolve side by side; after an epoch each one's elite moves to the next island.

    ``counts`` has at most ``capacity`` entries, and so have the tasks' inputs.
    """
    if not counts:
        return Solution()
    schema = "island int, shape array<int>, many bigint"
    elite: list[Solution] = []
    for epoch in range(epochs):
        sent = spark.sparkContext.broadcast((counts, elite))

        def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            problem, elites = sent.value
            for batch in batches:
                for island in batch["id"].to_pylist():
                    arrived = [elites[island - 1], elites[island]] if elites else []
                    best = evolve(problem, capacity, 1000 * epoch + island, arrived, population, generations)
                    rows = _rows_of(best, island)
                    yield pa.RecordBatch.from_pydict(
                        {"island": pa.array(rows["island"], pa.int32()),
                         "shape": pa.array(rows["shape"], pa.list_(pa.int32())),
                         "many": pa.array(rows["many"], pa.int64())})

        found = spark.range(0, islands, 1, islands).mapInArrow(live, schema).collect()
        elite = [Solution() for _ in range(islands)]
        for row in found:
            elite[row["island"]][tuple(row["shape"])] = row["many"]
    return max(elite, key=lambda s: fitness(s, capacity))


# -- places ---------------------------------------------------------------------------------


def places(solution: Solution) -> dict[int, np.ndarray]:
    """By length, rows ``(first number, bins, first bin, each, offset)``, ordered by first number.

    Piece number ``n`` of a length stands in the row with the last first number
    up to ``n``; ``each`` pieces of that length share a bin.
    """
    rows: dict[int, list] = {}
    taken: Counter = Counter()
    first_bin = 0
    for shape in sorted(solution, reverse=True):
        many, offset = solution[shape], 0
        for size, each in sorted(Counter(shape).items(), reverse=True):
            rows.setdefault(size, []).append((taken[size], many, first_bin, each, offset))
            taken[size] += many * each
            offset += each * size
        first_bin += many
    return {size: np.array(r, np.int64) for size, r in rows.items()}


def place(numbered: DataFrame, solution: Solution) -> DataFrame:
    """``sequence_id`` and ``offset`` for pieces with ``length`` and ``number``."""
    # Groups of a solution times lengths of a bin: bound by the lengths there are, not by the pieces.
    layout = numbered.sparkSession.sparkContext.broadcast(places(solution))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = layout.value
        for batch in batches:
            length = batch["length"].to_numpy(zero_copy_only=False)
            number = batch["number"].to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                rows = by_length[int(size)]
                row = rows[np.searchsorted(rows[:, 0], number[at], "right") - 1]
                k = number[at] - row[:, 0]
                sequence[at] = row[:, 2] + k // row[:, 3]
                offset[at] = row[:, 4] + k % row[:, 3] * size
            arrays = [*(batch[n] for n in names), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset"])

    return numbered.select(*names, "number").mapInArrow(
        put,
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint,"
        " sequence_id bigint, offset bigint",
    )


def numbered(parts: DataFrame, groups: int) -> DataFrame:
    """``number``: 0, 1, 2 ... within a length.

    Pieces of one length are dealt into hashed groups; a piece's number is its
    place in its group plus the sizes of the groups before.
    """
    dealt = parts.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    sizes = dealt.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "group").orderBy("doc_id", "piece")
    return (
        dealt.withColumn("place", F.row_number().over(within) - 1)
        .join(offsets, ["length", "group"])
        .withColumn("number", F.col("place") + F.col("before"))
    )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, remembered: int = REMEMBERED_BYTES,
         **settings) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row a piece."""
    spark = docs.sparkSession
    parts = stored(pieces(docs, path, capacity, remembered), "pieces")
    # At most ``capacity`` rows.
    counts = Counter({r["length"]: r["count"] for r in parts.groupBy("length").count().collect()})
    total = sum(counts.values())
    full = counts.pop(capacity, 0)
    solution = solve(spark, counts, capacity, **settings)
    if full:
        solution[(capacity,)] += full
    return place(numbered(parts, max(8, -(-total // 20_000))), solution)

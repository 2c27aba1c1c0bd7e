"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word n-grams, as 64-bit hashes.  Equal sets are one
node.  Grams have one order for all documents, rare before frequent.  With
similarity ``t`` and ``n`` grams, two similar documents share at least ``l`` of
their first ``n - ceil(t * n) + l`` grams, for any ``l``.  Each document chooses
its ``l`` by the estimated cost of its candidates: a longer prefix reads more
lists but asks for ``l`` shared grams before the sets are compared.  For a pair
the smaller ``l`` of the two holds, and as both sizes are known then, so does
the shorter prefix that follows from the overlap the two need.

Groups of near copies may be of any size, so pairs are not listed within them:

1. in each gram's list, all documents are compared with one pivot; links join
   them to components;
2. this is repeated in long lists that hold several components, while pivots
   still find links: documents outside the list's largest component are
   compared with some of it, the more of it the fewer they are;
3. what is left are pairs of different components: each of them that shares
   enough prefix grams is compared.

A pair that is never compared is in one component already, so components are
exact, and so is every link reported between different texts of two components.

How often grams occur is counted over the sets of all documents, on each set's
lowest hashes (a little more than its prefix).  Frequent grams go last; a
document left with too few rare ones has its prefix taken from the whole text
again.  As that has grams the counts have not met, which would look rare
however frequent they are, the whole sets of these documents are counted
before.  Grams of one list only, by these counts and by the prefixes taken
again, are left out of the lists.

Defined results: without words the set is empty and links with nothing; with
fewer words than ``n`` the whole sequence is the only gram; NULL text is empty;
rows repeated with one ``doc_id`` are one node, and each gets its row in the
result; if their sets differ, the set with the least hash stands for the node; a NULL ``doc_id`` has a NULL component; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.components import components
from pageloom.llm.memory import Remembered, give_back
from pageloom.llm.tables import arrow_batches, discard, release, stored, texts_of

WORDS, PERCENT = 5, 80
MOST_MATCHES = 4
#: Places of the table of frequent grams, and from which power of two on a gram is in it.
POWER_BITS, LEAST_POWER = 22, 3
#: Bits of the map of repeated grams: eight for each of them, within these bounds (128 MB at most).
LEAST_MAP_BITS, MOST_MAP_BITS = 20, 30
BLOCK_BITS = 12
PIVOT_ROUNDS = 12
#: Longer lists get further pivots before their pairs are listed.
LONG_LIST = 256
#: Comparisons with pivots in a round, for each row of a long list; a list with no more pairs than that needs no pivots.
PIVOTED = 8
#: Rows of a block of a list, where all its pairs are listed.
BLOCK_ROWS = 2_000
#: Documents of one component that are kept together in a long list.
CHUNK_ROWS = 64
MAX_BROADCAST_ROWS = 500_000
#: A batch of sets is copied a few times in a worker and in its executor, and each core has one.
BATCH_BYTES = 2 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FACTORS = np.array([0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                     0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class _Words(Remembered):
    """Hashes of words a worker has met lately."""

    def __missing__(self, word: bytes) -> int:
        value = self.earlier.get(word)
        if value is None:
            value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            self.keep(word, value, 200 + len(word))
        return value


_words = _Words(24 << 20)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams of a whole text."""
    parts = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), seed=1)], np.uint64)
    codes = np.fromiter(map(_words.__getitem__, parts), np.uint64, len(parts))
    size = len(codes) - words + 1
    total = codes[:size] * _FACTORS[0]
    for k in range(1, words):
        total += _mixed(codes[k : k + size]) * _FACTORS[k % 8] if k >= 8 else codes[k : k + size] * _FACTORS[k]
    return np.unique(_mixed(total))


def signature_of(grams: np.ndarray) -> bytes:
    return blake2b(grams.tobytes(), digest_size=16).digest()


def _node_sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Ids and sets of rows ``(doc_id, text, signature)`` whose text has that signature."""
    for doc_id, text, signature in zip(batch["doc_id"], batch["text"], batch["signature"]):
        grams = gram_set(text.as_py(), words)
        if signature_of(grams) == signature.as_py():
            yield doc_id.as_py(), grams


def least_overlap(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def prefix_length(n: int, matches: int, percent: int = PERCENT) -> int:
    return min(n, n - least_overlap(n, percent) + matches)


def strong_places(n: int, matches: int, percent: int = PERCENT) -> int:
    """Places of a set's order where it can meet sets that are not smaller; behind them it meets smaller ones only."""
    return n - -(-2 * n * percent // (100 + percent)) + matches


def _kept(n: int, percent: int) -> int:
    """Lowest hashes kept of a document: its longest prefix and something for frequent grams."""
    return min(n, prefix_length(n, MOST_MATCHES, percent) + 4 + n // 12)


def _marked(marks: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which grams a map of bits has; some that it was not made from, too."""
    place = grams & np.uint64(8 * len(marks) - 1)
    bit = np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)
    return (marks[(place >> np.uint64(3)).astype(np.int64)] & bit) != 0


class Frequencies:
    """How often grams occur: a map of those that occur twice, and a table of powers of two.

    Both are hashed, so a gram may look more frequent than it is.  That costs
    time at most: they only put grams in order.
    """

    def __init__(self, repeated: np.ndarray, powers: np.ndarray):
        self.repeated, self.powers = repeated, powers

    def power(self, grams: np.ndarray) -> np.ndarray:
        """0 for grams that occur once, 1 for a few times, then the power of two."""
        seen = _marked(self.repeated, grams)
        often = self.powers[(grams & np.uint64(len(self.powers) - 1)).astype(np.int64)].astype(np.int64)
        return np.where(seen, np.maximum(often, 1), 0)


def adaptive_prefix(grams: np.ndarray, n: int, table: Frequencies, percent: int) -> tuple[np.ndarray, int] | None:
    """The chosen prefix and its number of matches.

    ``grams`` are the lowest of the document's ``n`` hashes, sorted.  None if
    grams that are not among them might belong to the prefix.
    """
    power = table.power(grams)
    most = min(MOST_MATCHES, least_overlap(n, percent))
    longest = prefix_length(n, most, percent)
    rank = power
    if len(grams) < n and np.count_nonzero(rank == 0) < longest:
        return None
    order = np.argsort(rank, kind="stable")[:longest]
    often = np.where(power[order] == 1, 3.0, np.exp2(power[order]))
    reads = np.cumsum(often)
    best, chosen = np.inf, 1
    for matches in range(1, most + 1):
        # The lists are as many as the prefix, but most partners are of a size that asks for less of it.
        read = reads[prefix_length(n, matches, percent) - 1]
        near = min(n, strong_places(n, matches, percent))
        others = reads[near - 1] - near
        cost = read + others / matches * (1 + n / 16)
        if cost < best:
            best, chosen = cost, matches
    return grams[order[: prefix_length(n, chosen, percent)]], chosen


# A posting's meta is its set's size, its place in the set's order and the set's matches, in this many bits.
PLACE_BITS, MATCH_BITS = 31, 3


def _postings_batch(ids: list, sizes: list, prefixes: list) -> pa.RecordBatch:
    """``prefixes`` are ``(prefix, matches, wanted)``; grams that are not wanted are left out, places are kept."""
    tokens, docs, metas = [], [], []
    for doc_id, n, (prefix, matches, wanted) in zip(ids, sizes, prefixes):
        place = np.flatnonzero(wanted)
        tokens.append(prefix[place].view(np.int64))
        docs.append(np.full(len(place), doc_id, np.int64))
        metas.append((((n << PLACE_BITS) + place.astype(np.int64)) << MATCH_BITS) + matches)
    empty = [np.zeros(0, np.int64)]
    arrays = [pa.array(np.concatenate(x or empty)) for x in (tokens, docs, metas)]
    return pa.RecordBatch.from_arrays(arrays, ["token", "doc", "meta"])


def _counted(tokens: np.ndarray) -> pa.RecordBatch:
    tokens, counts = np.unique(tokens, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(counts)], ["token", "n"])


def _size(meta: str) -> Column:
    return F.shiftright(meta, PLACE_BITS + MATCH_BITS)


def _place(meta: str) -> Column:
    return F.shiftright(meta, MATCH_BITS).bitwiseAND((1 << PLACE_BITS) - 1)


def _need() -> Column:
    """Shared grams asked for of a pair: the smaller choice of the two."""
    return F.least(*(F.col(c).bitwiseAND((1 << MATCH_BITS) - 1) for c in ("a_meta", "b_meta")))


def _sized(narrow: DataFrame) -> DataFrame:
    """Marks a table of a few numbers a row for broadcast if its counted size allows it."""
    return F.broadcast(narrow) if narrow.count() <= MAX_BROADCAST_ROWS else narrow.hint("merge")


def _bytes(cells: DataFrame, size: int) -> np.ndarray:
    """``size`` bytes from ``cells (place, value)``, sent to the driver in packed blocks."""
    width = 1 << BLOCK_BITS

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for filled in batch["filled"]:
                part = np.zeros(width, np.uint8)
                for entry in filled.as_py():
                    part[entry["place"] & (width - 1)] = entry["value"]
                parts.append(part.tobytes())
            yield pa.RecordBatch.from_pydict({"block": batch["block"], "part": pa.array(parts, pa.binary())})

    block = F.shiftright("place", BLOCK_BITS).alias("block")
    blocks = cells.groupBy(block).agg(F.collect_list(F.struct("place", "value")).alias("filled"))
    table = np.zeros((size // width, width), np.uint8)
    for row in blocks.mapInArrow(packed, "block int, part binary").toLocalIterator():
        table[row["block"]] = np.frombuffer(row["part"], np.uint8)
    return table.reshape(-1)


def _bit_map(grams: DataFrame) -> np.ndarray:
    """A bit for the hash of each ``token``, eight places for each, within bounds."""
    wanted = max(1, 8 * grams.count() - 1).bit_length()
    bits = min(max(wanted, LEAST_MAP_BITS), MOST_MAP_BITS)
    byte = F.shiftright(F.col("token").bitwiseAND((1 << bits) - 1), 3).cast("int")
    bit = F.expr("shiftleft(1, CAST(token & 7 AS INT))")
    seen = grams.groupBy(byte.alias("place")).agg(F.bit_or(bit).cast("int").alias("value"))
    return _bytes(seen, 1 << (bits - 3))


class NgramJoin:
    """One run of the join over one table of documents."""

    def __init__(self, docs: DataFrame, words: int = WORDS, percent: int = PERCENT):
        self.texts = texts_of(docs)
        self.spark = docs.sparkSession
        self.words, self.percent = words, percent
        self.scratch: list[DataFrame] = []
        signed = stored(self._sign(), "grams")
        filled = signed.where("n > 0 AND doc_id IS NOT NULL")
        self.classes = stored(filled.groupBy("signature").agg(F.min("doc_id").alias("node")), "classes")
        named = self.classes.groupBy(F.col("node").alias("doc_id")).agg(F.min("signature").alias("signature"))
        # Rows repeated as they are stay repeated here; their postings do not.
        nodes = filled.join(_sized(named), ["doc_id", "signature"], "left_semi")
        self.nodes = stored(nodes.select("doc_id", "n", "signature", "low"), "nodes")
        self.signed = stored(signed.drop("low"), "signed")
        discard(signed)
        release(self.spark)

    # -- sets --------------------------------------------------------------------------------

    def _sign(self) -> DataFrame:
        words, percent = self.words, self.percent

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, signatures, low = [], [], []
                for text in batch["text"]:
                    grams = gram_set(text.as_py(), words)
                    sizes.append(len(grams))
                    signatures.append(signature_of(grams))
                    low.append(grams[: _kept(len(grams), percent)].tobytes())
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch["doc_id"], "n": pa.array(sizes, pa.int64()),
                     "signature": pa.array(signatures, pa.binary()), "low": pa.array(low, pa.binary())})
            give_back()

        return self.texts.mapInArrow(sign, "doc_id bigint, n bigint, signature binary, low binary")

    def _whole(self, wanted: DataFrame) -> DataFrame:
        """``(doc_id, text, signature)`` of the nodes named in ``wanted (doc)``; the signature is the node's."""
        named = self.nodes.select("doc_id", "signature").distinct()
        named = named.join(_sized(wanted.select(F.col("doc").alias("doc_id"))), "doc_id", "left_semi")
        return self.texts.join(_sized(named), "doc_id")

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """``(doc, n, brief, grams)`` of the documents named in ``wanted (doc)``; ``brief`` has each gram's last 16 bits."""
        words = self.words

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, sizes, brief, grams = [], [], [], []
                for doc_id, found in _node_sets(batch, words):
                    ids.append(doc_id)
                    sizes.append(len(found))
                    brief.append(np.unique(found.astype(np.uint16)).tobytes())
                    grams.append(found.tobytes())
                yield pa.RecordBatch.from_pydict(
                    {"doc": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()),
                     "brief": pa.array(brief, pa.binary()), "grams": pa.array(grams, pa.binary())})
            give_back()

        return self._whole(wanted).mapInArrow(whole, "doc bigint, n bigint, brief binary, grams binary")

    # -- prefixes ----------------------------------------------------------------------------

    def _repeated(self, counted: DataFrame) -> DataFrame:
        """``(token, n)`` of grams that occur more than once in ``counted (token, n)``."""
        repeated = stored(counted.groupBy("token").agg(F.sum("n").alias("n")).where("n > 1"), "repeated")
        release(self.spark)
        return repeated

    @staticmethod
    def _table(repeated: DataFrame) -> Frequencies:
        place = F.col("token").bitwiseAND((1 << POWER_BITS) - 1).cast("int").alias("place")
        often = repeated.where(f"n >= {1 << LEAST_POWER}").groupBy(place)
        powers = often.agg(F.max(F.floor(F.log2("n"))).cast("int").alias("value"))
        return Frequencies(_bit_map(repeated), _bytes(powers, 1 << POWER_BITS))

    def _short_prefixes(self, table: Broadcast) -> DataFrame:
        """``(doc)``: nodes whose prefix their lowest hashes do not tell, by these frequencies."""
        percent = self.percent

        def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = [
                    doc_id
                    for doc_id, n, low in zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "low")))
                    if adaptive_prefix(np.frombuffer(low, np.uint64), n, table.value, percent) is None
                ]
                yield pa.RecordBatch.from_pydict({"doc": pa.array(ids, pa.int64())})

        return stored(self.nodes.select("doc_id", "n", "low").mapInArrow(short, "doc bigint"), "short_prefixes")

    def frequencies(self) -> Frequencies:
        """Counts hashed into tables of bound size: over all lowest hashes, and over whole sets where those do not do.

        Documents whose lowest hashes are too frequent take their prefix from all
        their grams, most of which nobody's lowest hashes have.
        """
        words = self.words

        def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _counted(np.frombuffer(b"".join(batch["low"].to_pylist()), np.int64))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [grams.view(np.int64) for _, grams in _node_sets(batch, words)]
                yield _counted(np.concatenate([*sets, np.zeros(0, np.int64)]))

        repeated = self._repeated(self.nodes.select("low").mapInArrow(low, "token bigint, n bigint"))
        table = self.spark.sparkContext.broadcast(self._table(repeated))
        lacking = self._short_prefixes(table)
        table.unpersist()
        late = self._repeated(self._whole(lacking).mapInArrow(whole, "token bigint, n bigint"))
        both = stored(repeated.unionByName(late).groupBy("token").agg(F.max("n").alias("n")), "repeated")
        discard(lacking, repeated, late)
        release(self.spark)
        found = self._table(both)
        discard(both)
        return found

    def postings(self) -> DataFrame:
        """``(token, doc, meta)``: the adaptive prefix of every node, without grams that no other prefix has.

        A gram the counts know once is in one known prefix at most.  So it can
        meet another only in a prefix that was taken from a whole text, and
        those prefixes' own rare grams are known by then.
        """
        percent, words = self.percent, self.words
        table = self.spark.sparkContext.broadcast(self.frequencies())

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, sizes, prefixes = [], [], []
                for doc_id, grams in _node_sets(batch, words):
                    prefix, matches = adaptive_prefix(grams, len(grams), table.value, percent)
                    ids.append(doc_id)
                    sizes.append(len(grams))
                    prefixes.append((prefix, matches, np.ones(len(prefix), bool)))
                yield _postings_batch(ids, sizes, prefixes)

        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tokens = np.unique(batch["token"].to_numpy())
                tokens = tokens[table.value.power(tokens.view(np.uint64)) == 0]
                yield pa.RecordBatch.from_arrays([pa.array(tokens)], ["token"])

        nodes = self.nodes.select("doc_id", "n", "low")
        lacking = self._short_prefixes(table)
        schema = "token bigint, doc bigint, meta bigint"
        # A row may be there twice.
        late = stored(self._whole(lacking).mapInArrow(again, schema).distinct(), "late_prefixes")
        discard(lacking)
        met = self.spark.sparkContext.broadcast(_bit_map(late.select("token").mapInArrow(rare, "token bigint")))

        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, sizes, prefixes = [], [], []
                for doc_id, n, low in zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "low"))):
                    found = adaptive_prefix(np.frombuffer(low, np.uint64), n, table.value, percent)
                    if found is not None:
                        prefix, matches = found
                        wanted = (table.value.power(prefix) > 0) | _marked(met.value, prefix)
                        ids.append(doc_id)
                        sizes.append(n)
                        prefixes.append((prefix, matches, wanted))
                yield _postings_batch(ids, sizes, prefixes)

        early = stored(nodes.mapInArrow(known, schema).distinct(), "prefixes")
        return early.unionByName(late)

    # -- candidates and links ----------------------------------------------------------------

    def _alike(self) -> Column:
        """Whether ``a_meta`` and ``b_meta`` allow a link, and their common gram counts for it.

        Sets of these sizes are linked if they share ``overlap`` grams or more.
        Then ``need`` of them are among the first ``size - overlap + need`` of
        each set.
        """
        size_a, size_b = _size("a_meta"), _size("b_meta")
        overlap = F.ceil((size_a + size_b) * self.percent / (100 + self.percent))
        near = [_place(f"{side}_meta") < size - overlap + _need() for side, size in (("a", size_a), ("b", size_b))]
        return (F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * self.percent) & near[0] & near[1]

    def _matching(self, rows: DataFrame) -> DataFrame:
        """``(a, b)`` of rows ``(a, b, need)`` that share enough prefix grams."""
        shared = rows.groupBy("a", "b", "need").agg(F.count("*").alias("shared"))
        return shared.where("shared >= need").select("a", "b")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets are similar; sets are made for documents in pairs only.

        Most pairs fail by far, and the last 16 bits of the grams show it: sets
        share no more grams than different endings, and than the endings that
        come again in the set with fewer of those.  Whole grams travel only for
        the pairs that are left.
        """
        percent = self.percent

        def compare(batches: Iterator[pa.RecordBatch], grams: str, kind: type) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                columns = ("a_n", "b_n", f"a_{grams}", f"b_{grams}")
                for size_a, size_b, one, other in zip(*(batch[c] for c in columns)):
                    x, y = np.frombuffer(one.as_buffer(), kind), np.frombuffer(other.as_buffer(), kind)
                    size_a, size_b = size_a.as_py(), size_b.as_py()
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    shared = int(np.count_nonzero(both[1:] == both[:-1])) + min(size_a - len(x), size_b - len(y))
                    good.append((100 + percent) * shared >= percent * (size_a + size_b))
                keep = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], ["a", "b"])
            give_back()

        def alike(pairs: DataFrame, grams: str, kind: type) -> DataFrame:
            joined = pairs
            for side in ("a", "b"):
                wanted = pairs.select(F.col(side).alias("doc")).distinct()
                named = [F.col(c).alias(f"{side}_{c}") for c in ("n", grams)]
                half = sets.join(_sized(wanted), "doc", "left_semi").select(F.col("doc").alias(side), *named)
                joined = joined.join(half, side)
            return joined.mapInArrow(lambda batches: compare(batches, grams, kind), "a bigint, b bigint")

        pairs = stored(pairs, "pairs")
        release(self.spark)
        ones, others = (pairs.select(F.col(c).alias("doc")).distinct() for c in ("a", "b"))
        sets = stored(self.sets_of(ones.union(others).distinct()), "sets")
        likely = stored(alike(pairs, "brief", np.uint16), "likely")
        discard(pairs)
        # A row may be there twice.
        found = stored(alike(likely, "grams", np.uint64).distinct(), "links")
        discard(likely, sets)
        return found

    def _open_lists(self, long: DataFrame, salt: int) -> DataFrame:
        """``(token, b_component, share)``: long lists with many pairs of different components, and where their pivots are.

        ``b_component`` is the largest component there, and ``share`` the part of
        it that others are compared with: a link to any of it will do, so there
        are the more pivots the fewer others there are.
        """
        parts = long.groupBy("token", "component", "length").agg(F.count("*").alias("n"))
        largest = F.max(F.struct("n", F.xxhash64("component", F.lit(salt)).alias("h"), "component"))
        tops = parts.groupBy("token", "length").agg(largest.alias("most"), F.sum(F.expr("n * n")).alias("within"))
        return tops.where(f"length * length - within > 2 * {PIVOTED} * length").selectExpr(
            "token", "most.component AS b_component", f"{PIVOTED} * length / ((length - most.n) * most.n) AS share"
        )

    def _pivoted(self, rows: DataFrame, lists: DataFrame, salt: int) -> DataFrame:
        """Rows outside the largest component of one of these ``lists``, each with all pivots of its list.

        A document's hash tells whether it is a pivot, so that the lists of a
        group have the same ones.
        """
        rows = rows.join(lists, "token")
        drawn = (F.xxhash64("doc", F.lit(salt)).bitwiseAND((1 << 32) - 1) / (1 << 32)) < F.col("share")
        pivots = rows.where((F.col("component") == F.col("b_component")) & drawn)
        pivots = pivots.select("token", F.col("doc").alias("b"), F.col("meta").alias("b_meta"))
        return rows.where("component <> b_component").join(pivots, "token")

    def _stars(self, rows: DataFrame) -> DataFrame:
        """``(a, b)``: documents and those of their pivots that may be linked with them."""
        pairs = rows.select(F.col("doc").alias("a"), "b", F.col("meta").alias("a_meta"), "b_meta")
        return self._matching(pairs.where(self._alike()).select("a", "b", _need().alias("need")))

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Links found between nodes, and ``(doc, component)`` of all nodes that share a gram."""
        postings = self.postings()
        heads = postings.groupBy("token").agg(F.min(F.struct("doc", "meta")).alias("head"), F.max("doc").alias("high"))
        heads = heads.where("head.doc <> high").selectExpr("token", "head.doc AS b", "head.meta AS b_meta")
        lists = stored(postings.join(heads, "token"), "lists")
        discard(postings)
        del postings, heads
        release(self.spark)
        labels = lists.select("doc", F.col("doc").alias("component")).distinct()
        new = self._verified(self._stars(lists.where("doc <> b")))
        found, salt = [new], 1
        labels = stored(self._relabelled(labels, new), "labels")
        rows = self._next_lists(lists, labels)
        # Only long lists are worth further pivots; the others' pairs are few.
        short = stored(rows.where(f"length <= {LONG_LIST}"), "lists")
        long = stored(rows.where(f"length > {LONG_LIST}"), "long_lists")
        discard(rows)
        while salt < PIVOT_ROUNDS:
            wanting = stored(self._open_lists(long, salt), "open_lists")
            self.scratch.append(wanting)
            if wanting.isEmpty():
                break
            new = self._verified(self._stars(self._pivoted(long, wanting, salt)))
            if new.isEmpty():
                break
            salt += 1
            found.append(new)
            labels = self._next_labels(labels, new)
            long = self._next_lists(long, labels)
        if salt > 1:
            short = self._next_lists(short, labels)
        rows = short.unionByName(long)
        if not rows.isEmpty():
            new = self._verified(self._matching(self._crossing(rows)))
            found.append(new)
            if not new.isEmpty():
                labels = self._next_labels(labels, new)
        discard(short, long, *self.scratch)
        links = found[0]
        for more in found[1:]:
            links = links.unionByName(more)
        return links, labels

    def _next_labels(self, labels: DataFrame, new: DataFrame) -> DataFrame:
        made = stored(self._relabelled(labels, new), "labels")
        discard(labels)
        return made

    def _next_lists(self, lists: DataFrame, labels: DataFrame) -> DataFrame:
        """The lists that still hold several components, and their lengths; ``lists`` are gone after this."""
        labelled = stored(lists.select("token", "doc", "meta").join(labels, "doc"), "labelled")
        discard(lists)
        spans = labelled.groupBy("token").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("length")
        )
        rows = stored(labelled.join(spans.where("low <> high").select("token", "length"), "token"), "lists")
        discard(labelled)
        release(self.spark)
        return rows

    def all_links(self) -> DataFrame:
        """``(a, b)`` with ``a < b``: every pair of linked nodes, also within one component.

        A list is dealt into blocks, and each pair of its blocks is joined apart, so
        that a long list is the work of many tasks.
        """
        postings = self.postings()
        lengths = postings.groupBy("token").agg(F.count("*").alias("length")).where("length > 1")
        dealt = postings.join(lengths, "token").withColumn("blocks", F.expr(f"(length - 1) div {BLOCK_ROWS} + 1"))
        dealt = stored(dealt.withColumn("block", F.expr("pmod(xxhash64(doc, 7), blocks)")), "blocks")
        discard(postings)
        one = dealt.select("token", F.col("block").alias("i"), F.expr("explode(sequence(block, blocks - 1)) AS j"),
                           F.col("doc").alias("a_doc"), F.col("meta").alias("a_meta"))
        other = dealt.select("token", F.expr("explode(sequence(0L, block)) AS i"), F.col("block").alias("j"),
                             F.col("doc").alias("b_doc"), F.col("meta").alias("b_meta"))
        pairs = one.join(other, ["token", "i", "j"]).where("i < j OR a_doc < b_doc").where(self._alike())
        found = pairs.select(F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b"), _need().alias("need"))
        links = self._verified(self._matching(found))
        discard(dealt)
        return links

    def counts(self) -> DataFrame:
        """``(doc_id, class_id, n_links)`` for every row; documents with the same set are linked, too."""
        filled = self.signed.where("n > 0 AND doc_id IS NOT NULL")
        sizes = filled.groupBy("signature").agg(F.min("doc_id").alias("node"), F.countDistinct("doc_id").alias("size"))
        sizes = stored(sizes, "sizes")
        links = self.all_links()
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = both.join(sizes.select(F.col("node").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("others"))
        named = sizes.join(others.withColumnRenamed("a", "node"), "node", "left").select(
            "signature", "node", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links")
        )
        rows = self.signed.select("doc_id", F.when(F.col("n") > 0, F.col("signature")).alias("signature"))
        known = F.col("doc_id").isNotNull()
        return rows.join(named.hint("merge"), "signature", "left").select(
            "doc_id",
            F.when(known, F.coalesce("node", "doc_id")).alias("class_id"),
            F.when(known, F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links"),
        )

    def _relabelled(self, labels: DataFrame, new: DataFrame) -> DataFrame:
        """Components after ``new`` links, which connect components."""
        a = labels.select(F.col("doc").alias("a"), F.col("component").alias("ca"))
        b = labels.select(F.col("doc").alias("b"), F.col("component").alias("cb"))
        joined = components(new.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        renamed = joined.select(F.col("node").alias("component"), F.col("component").alias("renamed"))
        return labels.join(renamed, "component", "left").select(
            "doc", F.coalesce("renamed", "component").alias("component")
        )

    def _crossing(self, rows: DataFrame) -> DataFrame:
        """``(a, b, need)`` for all pairs of different components in a list.

        Short lists are joined with themselves.  In a long one, the documents of
        a component are put into chunks and chunks are paired, so that pairs
        within a component cost next to nothing.  Chunks are dealt into blocks,
        and each pair of blocks is joined apart.  Pairs that cannot be linked go
        before anything is shuffled: of a pair the smaller set has its gram at a
        strong place, so strong places meet all, and others only strong ones of
        smaller sets.
        """
        named = [F.col(c).alias(f"{side}{c}") for side in ("a_", "b_") for c in ("component", "doc", "meta")]
        short, long = (rows.where(f"length {sign} {LONG_LIST}") for sign in ("<=", ">"))
        one, other = short.select("token", *named[:3]), short.select("token", *named[3:])
        pairs = one.join(other, "token").where("a_component < b_component").drop("token", "a_component", "b_component")

        # ``reach`` is the largest set that one may meet there; at strong places that is its own size or more.
        size, place, matches = _size("meta"), _place("meta"), F.col("meta").bitwiseAND((1 << MATCH_BITS) - 1)
        reach = F.floor((100 + self.percent) * (size + matches - place - 1) / self.percent) - size
        long = long.withColumn("size", size).withColumn("reach", reach).withColumn("strong", F.expr("reach >= size"))
        sizes = long.groupBy("token", "component", "strong").agg(F.expr(f"(count(*) - 1) div {CHUNK_ROWS} + 1").alias("chunks"))
        dealt = sizes.groupBy("token").agg(F.expr(f"(sum(chunks) - 1) div {BLOCK_ROWS} + 1").alias("blocks"))
        chunked = (
            long.join(sizes, ["token", "component", "strong"])
            .groupBy("token", "component", "strong", F.expr("pmod(xxhash64(doc, 11), chunks)").alias("chunk"))
            .agg(F.collect_list(F.struct("doc", "meta")).alias("docs"), F.min("size").alias("size"), F.max("reach").alias("reach"))
            .join(dealt, "token")
            .withColumn("block", F.expr("pmod(xxhash64(component, strong, chunk, 7), blocks)"))
        )
        chunked = stored(chunked, "chunks")
        self.scratch.append(chunked)
        named = [[F.col(c).alias(f"{side}_{c}") for c in ("component", "docs", "size", "reach")] for side in ("a", "b")]
        first = chunked.select("token", F.col("block").alias("i"), F.expr("explode(sequence(block, blocks - 1)) AS j"), *named[0])
        second = chunked.select("token", F.expr("explode(sequence(0L, block)) AS i"), F.col("block").alias("j"), *named[1])
        crossing = (
            first.join(second, ["token", "i", "j"])
            .where("a_component <> b_component AND (i < j OR a_component < b_component)")
            .where("a_size <= b_reach AND b_size <= a_reach")
            .selectExpr("b_docs", "inline(a_docs) AS (a_doc, a_meta)")
            .selectExpr("a_doc", "a_meta", "inline(b_docs) AS (b_doc, b_meta)")
        )
        both = pairs.unionByName(crossing).where(self._alike())
        return both.select(F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b"), _need().alias("need"))

    def result(self) -> DataFrame:
        """``(doc_id, n_shingles, class_id, component_id)`` for every row.

        ``class_id`` is the least id with the same set.
        """
        _, labels = self.links()
        named = self.classes.join(labels.withColumnRenamed("doc", "node"), "node", "left").select(
            "signature", "node", F.coalesce("component", "node").alias("component")
        )
        rows = self.signed.select("doc_id", "n", F.when(F.col("n") > 0, F.col("signature")).alias("signature"))
        return rows.join(named.hint("merge"), "signature", "left").select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("class_id"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )


def near_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, class_id, component_id)`` for every row of ``docs``."""
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return NgramJoin(docs, words, percent).result()


def near_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(a, b)`` with ``a < b``: all linked pairs of different sets, each named by its least id."""
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return NgramJoin(docs, words, percent).all_links()


def link_counts(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, class_id, n_links)`` for every row of ``docs``: its set's least id, and its linked documents."""
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return NgramJoin(docs, words, percent).counts()


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the near copies: of each component the row with the least id stays."""
    gone = near_components(docs, words, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone"))
    listed = stored(gone.distinct(), "near_copies")
    return docs.join(_sized(listed), docs["doc_id"] == listed["_gone"], "left_anti")

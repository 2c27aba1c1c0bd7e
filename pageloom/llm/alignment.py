"""Alignment of two tokenizers of one text: where a byte-level BPE (A) and a sentencepiece model (B) both end a token.

The libraries' own spans are the coarse cuts: character offsets of the
tokenizers library and byte spans of sentencepiece (its immutable proto is gone
from the library; the offset mapping holds the same spans).  They cannot tell
the tokens of one multibyte character, or the byte-fallback tokens of one
character, apart; there a token's end is the last sure end plus the lengths of
the tokens' decoded bytes.

Neither tokenizer joins what a single space between two visible characters
separates, and both put the space first in the next token.  So a text is cut
there into chunks that are aligned alone; chunks come back often and are
remembered, up to a bound in bytes.

Tokens that end together have byte strings of which one is the end of the
other.  So linked pairs of ids are bound by the bytes of both vocabularies, for
any corpus; their counts are the only thing that is broadcast.

Defined results: texts that are NULL, empty, or not reproduced by the bytes of A
or B have no tokens (zeros, empty groups).  Repeated rows are aligned each and
count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pageloom.llm.bpe import byte_symbols
from pageloom.llm.memory import Remembered
from pageloom.llm.tables import arrow_batches, stored, texts_of

#: A chunk ends before a plain space between visible characters. U+180E was white space once.
_VISIBLE = r"[^\s᠎]"
_CUT = re.compile(rf" (?<={_VISIBLE} )(?={_VISIBLE})")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
_BETWEEN = re.compile(rf"{_VISIBLE}(?:.*{_VISIBLE})?", re.DOTALL)
JOINED, LONGEST = 400, 64
GROUP = 200
#: What a worker remembers of chunks, and what a batch of texts may take.
MEMORY_BYTES, BATCH_BYTES = 224 << 20, 8 << 20
ENTRY_BYTES = 450  # of Python's objects for one chunk
SCHEMA = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string,"
    " cuts array<bigint>, pairs array<bigint>, times array<int>"
)
B_BITS = 20  # ids of B take fewer bits; a pair is A's id and B's id in one number


def refine(begins: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Exact byte ends of tokens from coarse byte spans and the lengths of the decoded tokens.

    A coarse end is sure where its span is not empty (byte-fallback tokens but
    the last of a character have empty ones) and the next token neither begins
    before it nor ends with it.  Between sure ends the bytes decide.
    """
    if not len(ends):
        return ends
    after = np.append(begins[1:], ends[-1])
    own = np.append(ends[1:] > ends[:-1], True)
    sure = (ends > begins) & (after >= ends) & own
    run = np.cumsum(lengths)
    index = np.arange(len(ends))
    last = np.maximum.accumulate(np.where(sure, index, -1))
    base = np.where(last >= 0, ends[last] - run[last], 0)
    return base + run


def _spans(offsets: list[tuple[int, int]]) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(offsets), np.int64, 2 * len(offsets)).reshape(-1, 2)


class Aligner:
    """Aligns whole texts; remembers chunks."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in byte_of for c in token)
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        self.b_bytes = [self._piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_length = np.array(list(map(len, self.a_bytes)))
        self.b_length = np.array(list(map(len, self.b_bytes)))
        # What follows an id: "," in its group, "|" behind A's, ";" behind B's, a line end behind a chunk.
        self.a_names = self._names(len(self.a_bytes), ",|")
        self.b_names = self._names(len(self.b_bytes), ",;\n")
        self.memory = Remembered(MEMORY_BYTES)

    @staticmethod
    def _piece_bytes(piece: str) -> bytes:
        byte = _BYTE_PIECE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    @staticmethod
    def _names(n: int, marks: str) -> np.ndarray:
        return np.array([[f"{i}{mark}" for i in range(n)] for mark in marks], object)

    def _encode(self, text: str):
        """Ids and exact byte ends of both tokenizers in space + ``text``; None if bytes differ."""
        whole = " " + text
        data = whole.encode()
        encoding = self.a.encode(whole, add_special_tokens=False)
        ids = encoding.ids
        if b"".join(map(self.a_bytes.__getitem__, ids)) != data:
            return None
        pieces = self.b.encode(text, return_type="offset_mapping", return_bytes=True)
        if b"".join(map(self.b_bytes.__getitem__, pieces["ids"])) != data:
            return None
        a, b = np.array(ids, np.int64), np.array(pieces["ids"], np.int64)
        spans = _spans(encoding.offsets)
        if len(data) > len(whole):
            width = np.frombuffer(whole.encode("utf-32-le"), "<u4")
            width = 1 + (width >= 0x80) + (width >= 0x800) + (width >= 0x10000)
            spans = np.concatenate([[0], np.cumsum(width)])[spans]  # characters -> bytes
        a_ends = refine(spans[:, 0], spans[:, 1], self.a_length[a])
        # These are bytes of the text without the space that B adds.
        spans = _spans(pieces["offsets"]) + 1
        return a, a_ends, b, refine(spans[:, 0], spans[:, 1], self.b_length[b])

    def _aligned(self, chunks: list[str]) -> list[tuple] | None:
        """What is kept of ``chunks``, encoded as one text; None if the whole text has no tokens."""
        encoded = self._encode(" ".join(chunks))
        if encoded is None:
            return None
        a, a_ends, b, b_ends = encoded
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        sizes = np.cumsum([len(c.encode()) + 1 for c in chunks])
        last = np.searchsorted(common, sizes)
        if last[-1] >= len(common) or not np.array_equal(common[last], sizes):
            return None
        a_at, b_at = np.searchsorted(a_ends, common), np.searchsorted(b_ends, common)
        pairs = (a[a_at] << B_BITS) | b[b_at]
        # Decimal ids, each with what follows it: A's of a group, then B's of the group.
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[a_at], end_b[b_at] = 1, 1
        end_b[b_at[last]] = 2
        group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b > 0) - (end_b > 0)
        names = np.empty(len(a) + len(b), object)
        names[np.arange(len(a)) + np.concatenate([[0], b_at + 1])[group_a]] = self.a_names[end_a, a]
        names[np.arange(len(b)) + (a_at + 1)[group_b]] = self.b_names[end_b, b]
        texts = "".join(names.tolist()).split("\n")
        n = last + 1
        first = np.concatenate([[0], n[:-1]])
        n_a, n_b = np.diff(a_at[last] + 1, prepend=0), np.diff(b_at[last] + 1, prepend=0)
        size = np.diff(sizes, prepend=0)
        packed = pairs.tobytes()
        cuts = (common - np.repeat(sizes - size, n - first)).tobytes()
        return [
            (i, j, m - k, t, packed[8 * k : 8 * m], cuts[8 * k : 8 * m], z)
            for i, j, k, m, t, z in zip(n_a.tolist(), n_b.tolist(), first.tolist(), n.tolist(), texts, size.tolist())
        ]

    def learn(self, chunks: list[str]) -> dict[str, tuple]:
        """What is kept of each of the different ``chunks``; empty for one without tokens."""
        found = {}
        # Between these, joined by spaces, a text is cut again.
        plain = [c for c in chunks if len(c) < LONGEST and _BETWEEN.fullmatch(c)]
        alone = list(set(chunks).difference(plain))
        for k in range(0, len(plain), JOINED):
            some = plain[k : k + JOINED]
            kept = self._aligned(some)
            if kept is None:
                alone += some
            else:
                found.update(zip(some, kept))
        for chunk in alone:
            kept = self._aligned([chunk])
            found[chunk] = kept[0] if kept else ()
        return found

    def batch(self, texts: list[str]) -> Iterator[list[tuple] | None]:
        """What is kept of the chunks of each text, in order; None for a text without tokens."""
        for k in range(0, len(texts), GROUP):
            group = [_CUT.split(t) if t else [] for t in texts[k : k + GROUP]]
            rows = [list(map(self.memory.get, chunks)) for chunks in group]
            holes = [[i for i, kept in enumerate(row) if kept is None] if None in row else () for row in rows]
            made = {chunks[i]: None for chunks, hole in zip(group, holes) for i in hole}
            made = dict(zip(made, map(self.memory.earlier.get, made)))
            made |= self.learn([c for c, kept in made.items() if kept is None])
            for chunks, row, hole in zip(group, rows, holes):
                for i in hole:
                    row[i] = made[chunks[i]]
                yield row if row and () not in row else None
            short = {c: kept for c, kept in made.items() if len(c) < LONGEST}
            size = sum([len(kept[3]) + 2 * len(kept[4]) for kept in short.values() if kept])
            self.memory.keep_all(short, size + ENTRY_BYTES * len(short))


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner_of(byte_path: str, piece_path: str) -> Aligner:
    """One a worker, since reading the vocabularies takes a while."""
    if (byte_path, piece_path) not in _aligners:
        _aligners[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _aligners[byte_path, piece_path]


def _align(byte_path: str, piece_path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(byte_path, piece_path)
        for batch in batches:
            for start in range(0, len(batch), GROUP):
                part = batch.slice(start, GROUP)
                yield _to_batch(part["doc_id"], aligner.batch(part["text"].to_pylist()), digest)

    return run


def _to_batch(doc_ids: pa.Array, results: Iterator[list[tuple] | None], digest: bool) -> pa.RecordBatch:
    counts: list[tuple] = []
    groups, cuts, pairs, times = [], [], [], []
    for kept in results:
        if kept is None:
            counts.append((0, 0, 0))
            groups.append("")
            pairs.append(None)
            times.append(None)
            cuts.append(None)
            continue
        n_a, n_b, n_groups, names, packed, ends, sizes = zip(*kept)
        counts.append((sum(n_a), sum(n_b), sum(n_groups)))
        text = ";".join(names)
        groups.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
        ids, many = np.unique(np.frombuffer(b"".join(packed), np.int64), return_counts=True)
        pairs.append(ids)
        times.append(many.astype(np.int32))
        if digest:
            cuts.append(None)
        else:
            before = np.repeat(np.cumsum((0, *sizes[:-1])), n_groups)
            cuts.append(np.frombuffer(b"".join(ends), np.int64) + before)
    columns = list(zip(*counts))
    return pa.RecordBatch.from_arrays(
        [doc_ids, *(pa.array(c, pa.int64()) for c in columns), pa.array(groups, pa.string()),
         *(_lists(values, kind) for values, kind in ((cuts, pa.int64()), (pairs, pa.int64()), (times, pa.int32())))],
        ["doc_id", "n_a", "n_b", "n_groups", "groups", "cuts", "pairs", "times"],
    )


def _lists(values: list[np.ndarray | None], kind: pa.DataType) -> pa.ListArray:
    """One list a row; empty where there is none."""
    lengths = [0 if v is None else len(v) for v in values]
    flat = np.concatenate([v for v in values if v is not None] or [np.zeros(0, np.int64)])
    offsets = np.fromiter(itertools.accumulate(lengths, initial=0), np.int32, len(lengths) + 1)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def align(docs: DataFrame, byte_path: str, piece_path: str, *, digest: bool = False) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, groups, cuts, pairs, times)`` of every whole text.

    ``groups`` are the ids between common ends, as ``a1,a2|b1;a3|b2``, and
    ``cuts`` the byte offsets of these ends in space + text.  With ``digest``
    ``groups`` is the SHA-256 of that (empty without tokens) and ``cuts`` is
    empty.  ``pairs`` are the different linked pairs (see :func:`pair_ids`) and
    ``times`` how often each is linked.
    """
    return texts_of(docs).mapInArrow(_align(byte_path, piece_path, digest), SCHEMA)


def pair_ids(pair: str) -> tuple[str, str]:
    """SQL expressions for the ids of A and B in a pair."""
    return f"shiftright({pair}, {B_BITS})", f"{pair} & {2**B_BITS - 1}"


def link_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, n)``: how many links of the whole corpus hold each pair of ids.

    Added up within tasks first; rows are bound by the vocabularies.
    """
    each = aligned.selectExpr("inline(arrays_zip(pairs, times))")
    return each.groupBy("pairs").agg(F.sum("times").alias("n")).withColumnRenamed("pairs", "pair")


def alignment(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every text.

    ``n_best`` counts links whose pair is linked as often as any with its id of
    B, ``count_sum`` adds up the counts of the pairs of all links.
    """
    spark = docs.sparkSession
    with arrow_batches(spark, BATCH_BYTES):
        aligned = stored(align(docs, byte_path, piece_path, digest=True).drop("cuts"), "aligned")
    # Bound by the vocabularies: one token of a pair ends with the other.
    counted = link_counts(aligned).orderBy("pair").toArrow()
    pair, n = counted["pair"].to_numpy(), counted["n"].to_numpy()
    highest = np.zeros(2**B_BITS, np.int64)
    other = pair & (2**B_BITS - 1)
    np.maximum.at(highest, other, n)
    sent = spark.sparkContext.broadcast((pair, n, n == highest[other]))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            lists = batch["pairs"]
            bounds = lists.offsets.to_numpy()
            at = np.searchsorted(pair, lists.values.to_numpy())
            times = batch["times"].values.to_numpy().astype(np.int64)
            sums = []
            for value in (times * best[at], times * n[at]) if len(pair) else (times, times):
                total = np.concatenate([[0], np.cumsum(value)])
                sums.append(pa.array(total[bounds[1:]] - total[bounds[:-1]]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_a"], batch["n_b"], batch["n_groups"], batch["n_groups"], *sums, batch["groups"]],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    return aligned.mapInArrow(
        rate,
        "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint,"
        " count_sum bigint, groups_sha256 string",
    )

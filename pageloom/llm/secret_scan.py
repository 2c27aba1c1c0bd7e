"""Secret scans: fixed patterns, and novelty measured by a dictionary-primed zstandard.

``assign``, ``access`` and ``hex`` are the base kinds: leftmost, non-overlapping
matches that meet a kind's least length; they always stay.  The method adds
``novel`` spans: each run of key-like characters that no base span touches is a
candidate if it is within reach of a word such as "secret" or "token", before or
behind it, or of a reported span of any kind.  So a key of many lines is followed
from its first line to its last.  A candidate's novelty is the number of bytes by
which it lengthens the compressed text around it, other candidates left out (the
lines of one key make each other cheap); the compressor is primed with a dictionary
of identifiers.  Words and identifiers are cheap there; a candidate that stays
as incompressible as keys of its alphabet are is reported.

Defined results: NULL text is empty; places are code points; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate
from math import log2

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.memory import give_back
from pageloom.llm.tables import texts_of

# The base kinds in their order, with pattern, group and least length.
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_NEAR_WORDS = ("secret", "token", "passw", "credential", "bearer", "api_key", "apikey", "api-key", "private", "auth")
_NEAR = re.compile("(?ai:" + "|".join(_NEAR_WORDS) + ")")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
REACH = 96
AROUND = 512
#: Bytes a character that a key costs at least, and the share of them that is asked for of numbers and single-case keys.
LEAST_NOVELTY = 0.75
ALPHABET_SHARE = 0.9
LEAST_DIGITS = 0.1

# What identifiers in code and configuration are made of.
IDENTIFIERS = (
    "accessKeyId secretAccessKey apiKey api_key api_secret authToken auth_token authorization bearer"
    " client_id clientSecret client_secret config configuration connectionString credentials database"
    " default encoding endpoint environment export header hostname https://www.example.com/index.html"
    " import password passwd private_key privateKey public_key refreshToken refresh_token request"
    " response return secret self.session sessionToken session_token string token username user_name"
    " value version 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)


class Novelty:
    """Bytes that a candidate adds to the compressed text around it."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False)

    def marginal(self, before: str, own: str, after: str) -> int:
        # The text around comes first, so that the candidate can be copied from either side.
        around, own = (after + before).encode("utf-8", "replace"), own.encode("utf-8", "replace")
        return len(self.compressor.compress(around + own)) - len(self.compressor.compress(around))


_novelty: list[Novelty] = []


def least_novelty(own: str) -> float:
    """Bytes a character that ``own`` has to add to be reported.

    A random key costs what its alphabet allows: a digit less than half a byte.
    So what is asked for is a share of that, where digits are mixed in; words of
    one case without them, and names joined from words, would pass as keys and
    have to add the full amount.
    """
    digits = sum(map(own.count, "0123456789"))
    lower, upper = own.upper() != own, own.lower() != own
    if lower and upper or not own.isalnum() or digits < LEAST_DIGITS * len(own):
        return LEAST_NOVELTY
    return min(LEAST_NOVELTY, ALPHABET_SHARE * log2(36 if lower or upper else 10) / 8)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` of the base kinds."""
    spans = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def _around(text: str, runs: list[tuple[int, int]], k: int) -> tuple[str, str]:
    """``AROUND`` characters before and behind candidate ``k``, other candidates left out."""
    before, after = [], []
    need, at, j = AROUND, runs[k][0], k - 1
    while need and at:
        low = max(at - need, runs[j][1] if j >= 0 else 0)
        before.append(text[low:at])
        need -= at - low
        at, j = (runs[j][0], j - 1) if j >= 0 else (0, j)
    need, at, j = AROUND, runs[k][1], k + 1
    while need and at < len(text):
        high = min(at + need, runs[j][0] if j < len(runs) else len(text))
        after.append(text[at:high])
        need -= high - at
        at, j = (runs[j][1], j + 1) if j < len(runs) else (len(text), j)
    return "".join(reversed(before)), "".join(after)


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Incompressible candidates within reach of sensitive words or reported spans, untouched by base spans."""
    low = text.lower()
    sensitive = [(start, end) for start, _, end in base]
    if any(w in low for w in _NEAR_WORDS):
        sensitive = sorted(sensitive + [m.span() for m in _NEAR.finditer(text)])
    if not sensitive:
        return []
    runs = [m.span() for m in _CANDIDATE.finditer(text)]
    behind, touching = _furthest(sensitive), _furthest([(start, end) for start, _, end in base])
    todo = [k for k, (start, end) in enumerate(runs) if behind(end + REACH + 1) >= start - REACH]
    met, spans = set(todo), []
    while todo:
        k = todo.pop()
        start, end = runs[k]
        if touching(end) > start:
            continue
        if not _novelty:
            _novelty.append(Novelty())
        before, after = _around(text, runs, k)
        if _novelty[0].marginal(before, text[start:end], after) < least_novelty(text[start:end]) * (end - start):
            continue
        spans.append((start, 3, end))
        for step in (-1, 1):
            j = k + step
            while 0 <= j < len(runs) and max(start - runs[j][1], runs[j][0] - end) <= REACH:
                if j not in met:
                    met.add(j)
                    todo.append(j)
                j += step
    return sorted(spans)


def _furthest(spans: list[tuple[int, int]]) -> Callable[[int], int]:
    """The furthest end of sorted ``spans`` that start before a place; -REACH - 1 without any."""
    starts, ends = [start for start, _ in spans], list(accumulate((end for _, end in spans), max))

    def before(place: int) -> int:
        k = bisect_left(starts, place)
        return ends[k - 1] if k else -REACH - 1

    return before


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """All spans of a whole text by start, then kind."""
    base = base_spans(text)
    return sorted(base + novel_spans(text, base))


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, found)`` with ``found array<struct<kind, start, end>>`` of every whole text."""
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_spans(text.as_py())]
                for text in batch["text"]
            ]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "found": pa.array(found, found_type)})

    return texts_of(docs).mapInArrow(
        find, "doc_id bigint, found array<struct<kind:string,start:bigint,end:bigint>>"
    )


def summary(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, and the base and all spans written as text."""
    def joined(spans: str) -> str:
        return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"

    base = "filter(found, s -> s.kind <> 'novel')"
    counts = [f"CAST(size(filter(found, s -> s.kind = '{k}')) AS BIGINT) AS n_{k}" for k in KINDS]
    return found.selectExpr(
        "doc_id", *counts, f"sha2({joined(base)}, 256) AS base_sha256", f"{joined('found')} AS spans"
    )


def blank_out(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; all rows and columns stay.

    Spans that overlap are replaced as one.  ``n_chars``, where there is one,
    follows the new text.
    """

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for start, _, end in find_spans(text):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]]) if at else text

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(t.as_py()) for t in batch["text"]], pa.string())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", texts)
        give_back()

    cleaned = docs.mapInArrow(rewrite, docs.schema)
    if "n_chars" in docs.columns:
        changed = F.length("text")
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(changed).cast("bigint"))
    return cleaned

"""Token counts by section: whole documents are encoded once, tokens are dealt by their places.

A section is a line with its line break, so sections cover a text.  Every token
has a span of characters; it is joined to the sections that its span meets.  A
token that crosses a boundary is allocated by ``rule``:

* ``start``: the section that holds its first character has it;
* ``most``: the section that holds most of its characters, the earlier of equals;
* ``share``: each section gets its share of the token's characters.

Each rule keeps the total: the sections' counts sum up to the document's.

Defined results: a NULL or empty text is one empty section with no tokens; a text
that ends in a line break has no section after it; repeated rows give repeated
results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pageloom.llm.chunks import ChunkEncoder
from pageloom.llm.tables import texts_of

SCHEMA = (
    "doc_id bigint, section int, start bigint, end bigint, n_tokens double, n_crossing bigint,"
    " doc_tokens bigint"
)
_encoders: dict[str, ChunkEncoder] = {}


def token_spans(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """``(start, end)`` of every token of each whole text, in characters."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path, offsets=True)
    for chunks, packed in _encoders[path].batch(texts):
        counts = np.fromiter(map(len, packed), np.int64, len(packed)) // 8
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        spans = np.frombuffer(b"".join(packed), np.int32).reshape(-1, 2).astype(np.int64)
        yield spans + np.repeat(np.cumsum(lengths) - lengths, counts)[:, None]


def section_edges(text: str) -> np.ndarray:
    """Where sections start, and the end of the text."""
    lengths = [len(line) + 1 for line in text.split("\n")]
    edges = np.concatenate([[0], np.cumsum(lengths)])
    edges[-1] = len(text)
    return edges[:-1] if len(edges) > 2 and edges[-1] == edges[-2] else edges


def allocate(spans: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by ``rule``, and how many tokens of each cross its end."""
    n = len(edges) - 1
    last = max(n - 1, 0)
    first = np.clip(np.searchsorted(edges, spans[:, 0], "right") - 1, 0, last)
    final = np.clip(np.searchsorted(edges, np.maximum(spans[:, 1] - 1, spans[:, 0]), "right") - 1, 0, last)
    crossing = np.flatnonzero(final > first)
    crosses = np.bincount(first[crossing], minlength=n)
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float), crosses
    inside = np.ones(len(spans), bool)
    inside[crossing] = False
    counts = np.bincount(first[inside], minlength=n).astype(float)
    for t in crossing:
        start, end = spans[t]
        sections = np.arange(first[t], final[t] + 1)
        part = np.minimum(edges[sections + 1], end) - np.maximum(edges[sections], start)
        if rule == "most":
            counts[sections[np.argmax(part)]] += 1
        else:
            counts[sections] += part / part.sum()
    return counts, crosses


def count_by_section(docs: DataFrame, path: str, rule: str = "most") -> DataFrame:
    """``(doc_id, section, start, end, n_tokens, n_crossing, doc_tokens)``, one row a section."""
    if rule not in ("start", "most", "share"):
        raise ValueError(f"unknown rule {rule!r}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            repeats, ids, totals = [], batch["doc_id"].to_pylist(), []
            texts = batch["text"].to_pylist()
            for text, spans in zip(texts, token_spans(texts, path)):
                edges = section_edges(text)
                counts, crosses = allocate(spans, edges, rule)
                for column, values in zip(columns, (np.arange(len(counts)), edges[:-1], edges[1:], counts, crosses)):
                    column.append(values)
                repeats.append(len(counts))
                totals.append(len(spans))
            if not ids:
                continue
            section, start, end, tokens, crossing = (np.concatenate(c) for c in columns[:5])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([i for i, r in zip(ids, repeats) for _ in range(r)], pa.int64()),
                    "section": pa.array(section, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "end": pa.array(end, pa.int64()),
                    "n_tokens": pa.array(tokens, pa.float64()),
                    "n_crossing": pa.array(crossing, pa.int64()),
                    "doc_tokens": pa.array(np.repeat(totals, repeats), pa.int64()),
                }
            )

    return texts_of(docs).mapInArrow(count, SCHEMA)

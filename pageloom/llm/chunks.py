"""Byte-level BPE of whole texts by the tokenizers library, chunk by chunk.

The pre-tokenizer never joins what a single space between two visible characters
separates, and the space goes with what follows it.  So a text can be cut before
such spaces and each chunk encoded alone; chunks come back often and are
remembered.  For the same reason new chunks are encoded many at a time, as one
text: each starts at the token that starts with its space.  A text in which a
space meets other white space is encoded as one.

A task has one core, so the library's threads are kept off: they would take the
cores of other tasks, and each of them keeps memory of its own.  Encodings are
many times as large as the ids in them; so one is read before the next is made.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer

from pageloom.llm.memory import Remembered, give_back

os.environ["TOKENIZERS_PARALLELISM"] = "false"

REMEMBERED_BYTES = 256 << 20
GROUP = 200
JOINED = 500
LONGEST = 48
#: White space but the plain space.
_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]


def _meets(text: str) -> bool:
    """Whether a space of ``text`` meets other white space or its end."""
    if "  " in text or text.endswith(" "):
        return True
    return any(c in text and (c + " " in text or " " + c in text) for c in _WHITE)


class ChunkEncoder:
    """Encodes whole texts; what is kept of a chunk are its ids or, with ``offsets``, its tokens' places.

    Ids are little-endian 32-bit numbers, places pairs of them, in characters
    from the chunk's start.
    """

    def __init__(self, path: str, offsets: bool, remembered: int = REMEMBERED_BYTES):
        self.memory = Remembered(remembered)
        self.memory.take_over()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.offsets = offsets
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        # The byte-level alphabet writes a space as this letter.
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        give_back()

    def _encode(self, text: str):
        encode = self.tokenizer.encode_batch if self.offsets else self.tokenizer.encode_batch_fast
        return encode([text], add_special_tokens=False)[0]

    def _kept(self, encoding) -> np.ndarray:
        return np.array(encoding.offsets, "<i4").reshape(-1, 2) if self.offsets else np.array(encoding.ids, "<u4")

    def packed(self, chunks: list[str]) -> dict[str, bytes]:
        """What is kept of each of the different ``chunks``."""
        plain = [c for c in chunks if c[0] == " " and c.find(" ", 1) < 0 and c[1:] and c[1:] == c.strip()]
        alone = list(set(chunks).difference(plain))
        parts = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        found = {}
        for part in parts:
            encoding = self._encode("".join(part))
            kept = self._kept(encoding)
            ids = np.array(encoding.ids, "<u4") if self.offsets else kept
            first = np.flatnonzero(self.spaced[ids])
            if len(first) != len(part):
                alone += part
                continue
            if self.offsets:
                lengths = np.fromiter(map(len, part), np.int32, len(part))
                kept -= np.repeat(np.cumsum(lengths) - lengths, np.diff(first, append=len(kept)))[:, None]
            data, width = kept.tobytes(), 8 if self.offsets else 4
            ends = [*(first[1:] * width).tolist(), len(data)]
            start = 0
            for chunk, end in zip(part, ends):
                found[chunk] = data[start:end]
                start = end
        found.update((c, self._kept(self._encode(c)).tobytes()) for c in alone)
        return found

    def batch(self, texts: list[str]) -> Iterator[tuple[list[str], list[bytes]]]:
        """For each text its chunks, each with its space, and what is kept of each of them."""
        for start in range(0, len(texts), GROUP):
            group = [self._cut(t) for t in texts[start : start + GROUP]]
            rows = [list(map(self.memory.get, chunks)) for chunks in group]
            holes = [[k for k, p in enumerate(row) if p is None] if None in row else () for row in rows]
            fresh = {chunks[k]: None for chunks, hole in zip(group, holes) for k in hole}
            fresh = dict(zip(fresh, map(self.memory.earlier.get, fresh)))
            fresh |= self.packed([c for c, kept in fresh.items() if kept is None])
            short = {c: kept for c, kept in fresh.items() if len(c) <= LONGEST}
            self.memory.keep_all(short, 180 * len(short) + sum(map(len, short)) + sum(map(len, short.values())))
            for chunks, row, hole in zip(group, rows, holes):
                for k in hole:
                    row[k] = fresh[chunks[k]]
                yield chunks, row

    @staticmethod
    def _cut(text: str) -> list[str]:
        """The chunks of a text; the whole text where a space meets other white space."""
        if not text:
            return []
        if _meets(text):
            return [text]
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + c for c in rest]

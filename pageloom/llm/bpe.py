"""BPE by a tokenization automaton.

The automaton reads tokens and accepts exactly the sequences that BPE makes.  It
starts with one state in which every base symbol loops.  Each merge rule
``u v -> w``, taken in order, puts in its gadget: where ``u`` and then ``v`` can
be read, ``w`` can be read instead and leads where ``v`` led; arcs of ``u`` now
lead to a copy of their state that has no arc for ``v``.  Every token keeps one
target state, and a state is its parent state, the arc that it lost and when it
lost it; an arc made later than the loss goes the way of the first half of its
token.  So an arc is looked up by walking along the two tokens, and remembered
in a table.

Encoding goes over a word once.  Every prefix of a word has exactly one accepted
sequence; at each place the arcs that leave the state of its last token lead to
the places after.  Decoding emits the labels of the arcs.

Pre-splitting, normalisation and the joining of labels follow the vocabulary
file: NFC, lower case, words by its pattern, an end-of-word mark, no decoder
(labels joined by spaces).
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pageloom.functions.text import WHITE_SPACE
from pageloom.llm.tables import texts_of

END = "</w>"
REMEMBERED = 500_000
LONGEST = 48
_SPACE_CLASS = "".join(regex.escape(c) for c in WHITE_SPACE)
#: Control characters that Python takes for white space and the Unicode property does not.
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_SPACES = regex.compile(f"[{_SPACE_CLASS}]+")


def byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


class Automaton:
    """The tokenization automaton of a list of merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = END):
        self.end = end
        self.label = {i: t for t, i in vocab.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        self.lost: dict[tuple[int, int], int] = {}  # (u, v) -> when u's state lost its arc v
        self.arcs: dict[int, dict[int, bool]] = {}
        for when, (left, right) in enumerate(merges):
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            if (u, v) not in self.lost and w not in self.made and self._open(u, v):
                self.lost[u, v], self.made[w], self.halves[w] = when, when, (u, v)
        # The byte transitions: a tree of tables over the symbols of all tokens that can be read;
        # the entry "" of a node is the token that ends there.
        self.root: dict = {}
        for text, token in vocab.items():
            symbols = self.symbols(text)
            if token in self.made or len(symbols) == 1:
                node = self.root
                for symbol in symbols:
                    node = node.setdefault(symbol, {})
                node[""] = token

    def symbols(self, text: str) -> list[str]:
        """Base symbols of a word or token; the end mark belongs to the last one."""
        if text.endswith(self.end) and len(text) > len(self.end):
            body = text[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(text)

    def _open(self, last: int, token: int) -> bool:
        """Whether the target state of ``last`` has an arc for ``token``.

        The state of ``last`` is that of its second half as it was when ``last``
        was made, and so on; an arc is lost with its first half if it was made
        later than the loss.
        """
        state, until = last, len(self.label) + 1
        while True:
            part, before = token, until
            while True:
                when = self.lost.get((state, part))
                if when is not None and when < until and when <= before:
                    return False
                if part not in self.halves:
                    break
                before = self.made[part]
                part = self.halves[part][0]
            if state not in self.halves:
                return True
            until = min(until, self.made[state])
            state = self.halves[state][1]

    def encode(self, word: str) -> list[int]:
        """Token ids of one word, given in byte symbols without its end mark."""
        symbols = [*word[:-1], word[-1] + self.end]
        n = len(symbols)
        last: list[int | None] = [None] * (n + 1)
        start = [0] * (n + 1)
        root = self.root
        if len(self.arcs) > 40_000:
            self.arcs.clear()
        for i in range(n):
            before = last[i]
            arcs = self.arcs.setdefault(before, {}) if i else None
            node = root
            for j in range(i, n):
                node = node.get(symbols[j])
                if node is None:
                    break
                token = node.get("")
                if token is None or last[j + 1] is not None:
                    continue
                if i:
                    allowed = arcs.get(token)
                    if allowed is None:
                        allowed = arcs[token] = self._open(before, token)
                    if not allowed:
                        continue
                last[j + 1], start[j + 1] = token, i
        ids = []
        while n:
            ids.append(last[n])
            n = start[n]
        return ids[::-1]

    def decode(self, ids: list[int]) -> list[str]:
        """Labels of the arcs that ``ids`` take."""
        return [self.label[i] for i in ids]


class WordBpe:
    """Encodes and decodes whole texts as the vocabulary file at ``path`` says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton.label.update({i: t for t, i in self.special.items()})
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE_CLASS}"))
        self.bytes = byte_symbols()
        self.memory = _Memory(self.chunk)
        self.known = _Memory(self.word)

    def normalise(self, chunk: str) -> str:
        """NFC and lower case, each character alone (a final sigma is no special case)."""
        return unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()

    def word(self, word: str) -> tuple[str, str]:
        """Decimal ids and labels of one normalised word; chunks too long to be remembered are made of few words."""
        ids = self.automaton.encode("".join(self.bytes[b] for b in word.encode("utf-8", "replace")))
        return " ".join(map(str, ids)), " ".join(self.automaton.decode(ids))

    def chunk(self, chunk: str) -> tuple[str, str]:
        pairs: list[tuple[str, str]] = []
        for piece in self.cut.split(chunk):
            if piece in self.special:
                pairs.append((str(self.special[piece]), piece))
            else:
                pairs += map(self.known.__getitem__, self.words.findall(self.normalise(piece)))
        return " ".join([ids for ids, _ in pairs]), " ".join([labels for _, labels in pairs])

    def chunks(self, text: str) -> list[str]:
        if _ODD_SPACE.search(text):
            return [c for c in _SPACES.split(text) if c]
        return text.split()

    def encode_decode(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by spaces, and the decoded text."""
        pairs = list(map(self.memory.__getitem__, self.chunks(text)))
        return " ".join([ids for ids, _ in pairs]), " ".join([labels for _, labels in pairs])


class _Memory(dict):
    """What a worker remembers of chunks; forgets all when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> tuple[str, str]:
        made = self.make(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = made
        return made


_coders: dict[str, WordBpe] = {}


def coder(path: str) -> WordBpe:
    if path not in _coders:
        _coders[path] = WordBpe(path)
    return _coders[path]


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` of every whole text; NULL is empty.

    ``ids`` are decimal numbers joined by spaces.
    """
    return texts_of(docs).mapInArrow(_coded(path, lambda x: x), "doc_id bigint, n_tokens bigint, ids string, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As :func:`encode_texts`, with SHA-256 of ``ids`` and ``decoded`` in their place."""
    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8")).hexdigest()

    coded = texts_of(docs).mapInArrow(_coded(path, digest), "doc_id bigint, n_tokens bigint, ids string, decoded string")
    return coded.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def _coded(path: str, kept):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch["text"]:
                i, d = bpe.encode_decode(text.as_py())
                counts.append(i.count(" ") + 1 if i else 0)
                ids.append(kept(i))
                decoded.append(kept(d))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch["doc_id"], "n_tokens": pa.array(counts, pa.int64()),
                 "ids": pa.array(ids, pa.string()), "decoded": pa.array(decoded, pa.string())})

    return code

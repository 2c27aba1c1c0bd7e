"""Words of texts as SQL expressions: ASCII letters lower-cased, everything else as it is."""

from __future__ import annotations

from pageloom.functions.text import literal

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digits, letters and all that is not ASCII.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z only; texts of ASCII alone take the faster way to the same."""
    return f"if(octet_length({text}) = length({text}), lower({text}), translate({text}, '{UPPER}', '{LOWER}'))"


def words(text: str) -> str:
    return f"regexp_extract_all({ascii_lower(text)}, {literal(_WORD)}, 0)"

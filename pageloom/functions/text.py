"""String helpers, written as SQL expressions.

All functions of this package take SQL expressions as text and return one, so
they combine with ``selectExpr``, ``expr`` and plain SQL, and a long expression
reaches the engine in one call instead of thousands.

Web text is multilingual, so "blank" means Unicode white space and lengths that
feed limits or scores are counted in bytes.
"""

from __future__ import annotations

import html.entities
import itertools
import json
from collections.abc import Callable

# The characters of the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# What the regular expression class \s covers in ASCII.
ASCII_SPACE = "\t\n\x0c\r "

# What HTML reads the references to 128..159 as; five of them stay as they are.
C1_CHARACTERS = "\u20ac\x81\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\x8d\u017d\x8f" \
    "\x90\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\x9d\u017e\u0178"  # fmt: skip

_names = itertools.count()


def literal(value: str) -> str:
    """A string literal; characters outside printable ASCII are written as escapes."""
    out = []
    for char in value:
        if char in "\\'":
            out.append("\\" + char)
        elif " " <= char <= "~":
            out.append(char)
        elif ord(char) < 0x10000:
            out.append(f"\\u{ord(char):04X}")
        else:
            out.append(f"\\U{ord(char):08X}")
    return "'" + "".join(out) + "'"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Works in a projection and inside a higher-order function, where
    common-subexpression elimination does not reach.
    """
    name = f"v{next(_names)}"
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def each(values: str, body: Callable[[str], str]) -> str:
    name = f"v{next(_names)}"
    return f"transform({values}, {name} -> {body(name)})"


def keep(values: str, test: Callable[[str], str]) -> str:
    name = f"v{next(_names)}"
    return f"filter({values}, {name} -> {test(name)})"


def extract(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({text}, {literal(pattern)}, {group})"


def substitute(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {literal(pattern)}, {literal(by)})"


def matches(text: str, pattern: str) -> str:
    return f"({text} rlike {literal(pattern)})"


def squeeze(text: str) -> str:
    """Cut Unicode white space at both ends (plain ``trim`` cuts U+0020 only)."""
    return f"btrim({text}, {literal(WHITE_SPACE)})"


def is_blank(text: str) -> str:
    return f"({squeeze(text)} = '')"


def is_ascii_blank(text: str) -> str:
    return f"(btrim({text}, {literal(ASCII_SPACE)}) = '')"


def cut_bytes(text: str, size: int) -> str:
    """At most ``size`` UTF-8 bytes, never ending inside a character.

    One byte more than asked for is looked at: if it continues a character
    (80..BF), the whole character is left out.
    """
    hexed = f"hex(substring(encode({text}, 'utf-8'), 1, {size + 1}))"
    whole = extract(hexed, rf"^((?:[0-9A-F]{{2}}){{0,{size}}})(?=[0-7C-F]|$)", 1)
    return f"if(octet_length({text}) <= {size}, {text}, decode(unhex({whole}), 'utf-8'))"


def _entity_table() -> str:
    """Named character references as one constant map, taken from the standard library."""
    return f"from_json({literal(json.dumps(html.entities.html5))}, 'map<string,string>')"


_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*+(?:;|(?!=)))"


def _decode_reference(token: str) -> str:
    decimal = extract(token, "^&#([0-9]+)", 1)
    hexadecimal = extract(token, "^&#[xX]0*([0-9a-fA-F]{1,8});?$", 1)
    code = f"try_cast(if({matches(token, '^&#[xX]')}, conv({hexadecimal}, 16, 10), {decimal}) AS BIGINT)"
    character = let(
        code,
        lambda n: f"CASE WHEN {n} BETWEEN 128 AND 159 THEN substring({literal(C1_CHARACTERS)}, int({n}) - 127, 1)"
        f" WHEN {n} BETWEEN 1 AND 1114111 AND {n} NOT BETWEEN 55296 AND 57343"
        f" THEN decode(unhex(lpad(hex({n}), 8, '0')), 'utf-32') ELSE '\\uFFFD' END",
    )
    return (
        f"CASE WHEN NOT startswith({token}, '&') OR length({token}) = 1 THEN {token}"
        f" WHEN {token} = '&amp;' THEN '&'"
        f" WHEN startswith({token}, '&#') THEN {character}"
        f" ELSE coalesce(element_at({_entity_table()}, substring({token}, 2)), {token}) END"
    )


def decode_attribute(value: str) -> str:
    """Decode character references by the rule for attribute values.

    A reference without ``;`` counts only if the whole name is known and no ``=``
    follows, so ``?a=1&copy=2`` stays as it is.
    """
    tokens = f"regexp_extract_all({value}, {literal(_REFERENCE + '|[^&]+|&')}, 0)"
    decoded = f"array_join({each(tokens, _decode_reference)}, '')"
    return f"if(contains({value}, '&'), {decoded}, {value})"

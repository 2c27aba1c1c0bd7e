"""Personal data: patterns propose spans, checksums confirm them, context moves the score.

Everything is SQL expressions.  A kind's pattern cuts a text into gaps and
matches; the places of the matches are running sums of their lengths, in code
points.  Patterns are written so that the regular expression engine neither
recurses nor looks twice at a run of characters, however long a text is: runs
are possessive, and a match may start within a run only where the last match
ended (``\\G``).  That finds the same spans as the plain patterns.

``email``, ``ip``, ``card`` and ``phone`` spans that meet their kind's check all
stay.  The method adds ``iban`` (an international account number, as long as its
country's are, that meets mod-97) and ``local`` (seven or more digits in phone form without a country
code, only where a word such as "phone" stands before).  Every span has a score:
the kind's base, raised by a passed checksum and by context words before it.

Defined results: NULL text is empty; repeated rows give repeated results; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import let, literal
from pageloom.llm.tables import texts_of

# Length of an international account number by country code.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO EG GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(
    rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()
)

# Patterns, in the order of the kinds in a result.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # The match is the head alone, so that no number hides one that starts within it; group 1 is the whole.
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{_IBAN})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}",
    "local": r"(?<![+0-9(.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
}
#: Group of a pattern that is the span, and length of the match, where it is not the span.
AHEAD = {"iban": (1, 4)}
BASE_KINDS = ("email", "ip", "card", "phone")
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.5, "local": 0.2}
CHECKSUM_GAIN, CONTEXT_GAIN = 0.3, 0.2
CONTEXT_CHARS = 40
CONTEXT_WORDS = {
    "email": "mail|contact|write|address|correo|courriel",
    "ip": "ip|host|server|address|login|client",
    "card": "card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|telefon|contact",
    "iban": "iban|account|bank|transfer|konto|compte|cuenta",
    "local": "phone|tel|call|fax|mobile|telefon",
}
_BLOCK = 256


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """Whether a string of digits meets Luhn's checksum."""
    def doubled(d: str) -> str:
        return f"if(2 * {d} > 9, 2 * {d} - 9, 2 * {d})"

    def test(x: str) -> str:
        d = f"CAST(substring({x}, length({x}) - i, 1) AS INT)"
        return (
            f"aggregate(sequence(0, length({x}) - 1), 0,"
            f" (s, i) -> s + if(i % 2 = 1, {doubled(d)}, {d})) % 10 = 0"
        )

    return let(digits, test)


def mod97(account: str) -> str:
    """Whether an account number without spaces meets the mod-97 check (remainder 1)."""
    turned = f"concat(substring({account}, 5), substring({account}, 1, 4))"
    step = "if(c BETWEEN '0' AND '9', s * 10 + CAST(c AS INT), s * 100 + ascii(c) - 55) % 97"
    return f"aggregate(regexp_extract_all({turned}, '.', 0), 0, (s, c) -> CAST({step} AS INT)) = 1"


def _passes(kind: str, m: str, gap: str) -> str:
    """Whether match ``m`` behind the text ``gap`` is a span of ``kind``."""
    n = f"length({_digits(m)})"
    if kind == "ip":
        part = "length(ltrim('0', p)) <= 3 AND CAST(concat('0', right(p, 3)) AS INT) <= 255"
        return f"forall(split({m}, '[.]'), p -> {part})"
    if kind == "card":
        return f"({n} BETWEEN 16 AND 19 AND {luhn(_digits(m))})"
    if kind == "phone":
        return f"({n} BETWEEN 8 AND 15)"
    if kind == "iban":
        return mod97(f"replace({m}, ' ', '')")
    if kind == "local":
        return f"({n} >= 7 AND {_near(kind, gap)})"
    return "true"


def _near(kind: str, gap: str) -> str:
    return f"(right({gap}, {CONTEXT_CHARS}) rlike '(?i)({CONTEXT_WORDS[kind]})')"


def _score(kind: str, gap: str) -> str:
    sure = BASE_SCORE[kind] + (CHECKSUM_GAIN if kind in ("card", "iban") else 0)
    return f"least(1D, {sure}D + if({_near(kind, gap)}, {CONTEXT_GAIN}D, 0D))"


def _spans(kind: str, found: str, gaps: str) -> str:
    """``array<struct<kind, start, end, score>>`` from matches and the gaps around them.

    Running sums go by blocks, so that a text with very many matches costs
    little more than its length.
    """
    def body(x: str) -> str:
        lengths = f"transform({x}, p -> p.n + length(p.g))"

        def summed(n: str) -> str:
            blocks = f"transform(sequence(0, (size({n}) - 1) div {_BLOCK}), b ->"
            blocks += f" aggregate(slice({n}, b * {_BLOCK} + 1, {_BLOCK}), 0, (s, v) -> s + v))"

            def placed(t: str) -> str:
                def started(o: str) -> str:
                    before = (
                        f"{o}[CAST(i div {_BLOCK} AS INT)] + aggregate(slice({n}, CAST(i div {_BLOCK} AS INT) * {_BLOCK} + 1,"
                        f" i % {_BLOCK}), 0, (s, v) -> s + v) + length(p.g)"
                    )
                    span = let(
                        before,
                        lambda at: f"if({_passes(kind, 'p.m', 'p.g')}, named_struct('kind', '{kind}', 'start', {at},"
                        f" 'end', {at} + length(p.m), 'score', {_score(kind, 'p.g')}), NULL)",
                    )
                    return f"filter(transform({x}, (p, i) -> {span}), q -> q IS NOT NULL)"

                offsets = f"transform({t}, (v, b) -> aggregate(slice({t}, 1, b), 0, (s, w) -> s + w))"
                return let(offsets, started)

            return let(blocks, placed)

        return let(lengths, summed)

    n = AHEAD[kind][1] if kind in AHEAD else "length(m)"
    # Both arrays are arguments here: inside the function each of them would be made again for every match.
    paired = f"slice(zip_with({found}, {gaps}, (m, g) -> named_struct('m', m, 'n', {n}, 'g', g)), 1, size({found}))"
    empty = "CAST(array() AS array<struct<kind:string,start:int,end:int,score:double>>)"
    return f"if(size({found}) = 0, {empty}, {let(paired, body)})"


#: A cheap test that a text may hold a kind at all.
_HINT = {"email": "contains(text, '@')", "phone": "contains(text, '+')", "ip": "contains(text, '.')"}


def find_pii(docs: DataFrame) -> DataFrame:
    """``(doc_id, found)``: all spans of every whole text, by kind and start.

    ``found`` is an ``array<struct<kind, start, end, score>>``.
    """
    none = "CAST(array() AS array<string>)"
    df = texts_of(docs)
    for kind, pattern in PATTERNS.items():
        found = f"regexp_extract_all(text, {literal(pattern)}, {AHEAD.get(kind, (0,))[0]})"
        df = df.withColumn(f"m_{kind}", F.expr(f"if({_HINT.get(kind, 'true')}, {found}, {none})"))
    for kind, pattern in PATTERNS.items():
        cut = f"if(size(m_{kind}) = 0, {none}, split(text, {literal(pattern)}, -1))"
        df = df.withColumn(f"g_{kind}", F.expr(cut))
    each = [_spans(kind, f"m_{kind}", f"g_{kind}") for kind in PATTERNS]
    return df.select("doc_id", F.expr(f"concat({', '.join(each)})").alias("found"))


def summary(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, and the base and all spans written as text."""
    def joined(spans: str) -> str:
        return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"

    kinds = ", ".join(f"'{k}'" for k in BASE_KINDS)
    base = f"filter(found, s -> s.kind IN ({kinds}))"
    counts = [f"CAST(size(filter(found, s -> s.kind = '{k}')) AS BIGINT) AS n_{k}" for k in BASE_KINDS]
    return found.selectExpr(
        "doc_id",
        *counts,
        f"sha2({joined(base)}, 256) AS base_sha256",
        f"{joined('found')} AS spans",
        "array_join(transform(found, s -> format_number(s.score, 2)), ',') AS scores",
    )

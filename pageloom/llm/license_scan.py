"""Licences named, granted, tagged or written out in texts: ordered signature rules.

Everything is SQL expressions.  A text becomes its words; the words it holds of
the rules' keywords decide which of several hundred regular expressions are
tried at all.  Expressions see each word with a space of its own on both sides,
so a match is whole words, matches side by side are both found, and the places
of the marked words are those of the match.

Detections are sorted by place; one that lies within another of the same or a
higher priority goes (of equal ones that of the earlier rule stays).  Only what
starts earlier, or with it and ends later, can hold a detection, so running
maxima of ends by priority decide; they go by blocks, so a text with very many
detections costs little more than its length.

Base phrases are found beside the rules and are never suppressed.

Defined results: NULL text is empty and has no words; repeated rows give
repeated results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import let, literal
from pageloom.llm.license_rules import CONFIDENCE, PRIORITY, Rule, rules
from pageloom.llm.tables import texts_of
from pageloom.llm.words import words

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_CONFIDENCE = 0.5
_START, _END = "\x01", "\x02"  # no word holds them
_BLOCK = 256
_SPANS = "array<struct<s:int,e:int>>"
_FOUND = "array<struct<start:int,back:int,rank:int,rule:int,label:string,form:string,end:int,priority:int>>"


def spaced(pattern: str) -> str:
    """A pattern over words as one over the text of :func:`_text`; the match is group 1."""
    return f" ({pattern.replace(' ', '  ')}) "


def _text(found: str) -> str:
    """Every word with a space before and behind it."""
    return f"if(size({found}) = 0, '', concat(' ', array_join({found}, '  '), ' '))"


def _spans(text: str, pattern: str) -> str:
    """``array<struct<s, e>>``: word places of all matches, end exclusive."""
    def marked(pieces: str) -> str:
        def places(test: str, place: str) -> str:
            return f"filter(transform({pieces}, (x, i) -> if({test}, {place}, -1)), p -> p >= 0)"

        starts = places(f"startswith(x, {literal(_START)})", "i")
        ends = places(f"endswith(x, {literal(_END)})", "i + 1")
        return f"zip_with({starts}, {ends}, (s, e) -> named_struct('s', s, 'e', e))"

    by = f"concat(' ', {literal(_START)}, '$1', {literal(_END)}, ' ')"
    found = let(f"split(btrim(regexp_replace({text}, {pattern}, {by})), '  ', -1)", marked)
    return f"if({text} rlike {pattern}, {found}, CAST(array() AS {_SPANS}))"


def _rule_table(table: list[Rule]) -> str:
    rows = (
        f"named_struct('n', {n}, 'label', {literal(r.label)}, 'form', '{r.form}', 'priority', {r.priority},"
        f" 'keys', array({', '.join(map(literal, r.keywords))}), 'p', {literal(spaced(r.pattern))})"
        for n, r in enumerate(table)
    )
    return f"array({', '.join(rows)})"


def _detections(text: str, present: str, table: list[Rule]) -> str:
    """All matches of all rules whose keywords the text holds, sorted so that holders come first."""
    one = (
        "named_struct('start', x.s, 'back', -x.e, 'rank', -r.priority, 'rule', r.n, 'label', r.label, 'form', r.form,"
        " 'end', x.e, 'priority', r.priority)"
    )
    tried = f"filter({_rule_table(table)}, r -> arrays_overlap(r.keys, {present}))"
    each = f"transform({tried}, r -> transform({_spans(text, 'r.p')}, x -> {one}))"
    return f"if(size({present}) = 0, CAST(array() AS {_FOUND}), array_sort(flatten({each})))"


def _unsuppressed(found: str) -> str:
    """Detections without a holder of their own priority or a higher one."""
    levels = sorted(PRIORITY.values())

    def tops(block: str) -> str:
        """For each priority, the largest end in a block among detections of that priority or a higher one."""
        ends = (f"array_max(transform({block}, b -> if(b.priority >= {p}, b.end, -1)))" for p in levels)
        return f"array({', '.join(ends)})"

    blocks = f"sequence(0, (size({found}) - 1) div {_BLOCK})"
    summits = f"transform({blocks}, k -> {let(f'slice({found}, k * {_BLOCK} + 1, {_BLOCK})', tops)})"

    def kept(t: str) -> str:
        zero = f"array({', '.join(['-1'] * len(levels))})"
        merged = "(a, b) -> zip_with(a, b, (x, y) -> greatest(x, y))"
        before = f"transform({blocks}, k -> aggregate(slice({t}, 1, k), {zero}, {merged}))"

        def judged(b: str) -> str:
            earlier = f"slice({found}, CAST(i div {_BLOCK} AS INT) * {_BLOCK} + 1, i % {_BLOCK})"
            held = f"{b}[CAST(i div {_BLOCK} AS INT)][d.priority - 1] >= d.end"
            return (
                f"filter({found}, (d, i) -> NOT ({held}"
                f" OR exists({earlier}, h -> h.end >= d.end AND h.priority >= d.priority)))"
            )

        return let(before, judged)

    return f"if(size({found}) = 0, {found}, {let(summits, kept)})"


def scan(docs: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """``(doc_id, n_words, base, found)`` of every whole text.

    ``base`` is ``array<struct<start, label>>``, all places of the base phrases.
    ``found`` is ``array<struct<label, form, start, end>>``, the detections that
    no other one suppresses; places count words, ends are exclusive.
    """
    table = rules() if table is None else table
    keywords = sorted({k for r in table for k in r.keywords})
    known = f"array({', '.join(map(literal, keywords))})"

    def result(w: str) -> str:
        def scanned(t: str) -> str:
            base = ", ".join(
                f"transform({_spans(t, literal(spaced(phrase)))}, x -> named_struct('start', x.s, 'label', '{label}'))"
                for phrase, label in BASE.items()
            )
            found = let(f"array_intersect({w}, {known})", lambda k: let(_detections(t, k, table), _unsuppressed))
            shown = f"transform({found}, d -> named_struct('label', d.label, 'form', d.form, 'start', d.start, 'end', d.end))"
            return (
                f"named_struct('n_words', CAST(size({w}) AS BIGINT), 'base', concat({base}), 'found', {shown})"
            )

        return let(_text(w), scanned)

    return texts_of(docs).select("doc_id", F.expr(f"inline(array({let(words('text'), result)}))"))


def summary(scanned: DataFrame) -> DataFrame:
    """Counts, labels and a score: the confidence of the surest detection, 0 without any."""
    sure = " ".join(f"WHEN '{form}' THEN {value}D" for form, value in CONFIDENCE.items())
    scores = f"concat(transform(found, d -> CASE d.form {sure} END), transform(base, b -> {BASE_CONFIDENCE}D))"
    labels = "transform({0}, x -> x.label)"
    base, all_labels = labels.format("base"), f"concat({labels.format('base')}, {labels.format('found')})"
    starts = "transform(base, b -> CAST(b.start AS BIGINT))"
    return scanned.selectExpr(
        "doc_id", "n_words", "CAST(size(base) AS BIGINT) AS n_base",
        f"array_min({starts}) AS first_word", f"array_max({starts}) AS last_word",
        f"array_join(array_sort(array_distinct({base})), ',') AS base_labels",
        f"array_join(array_sort(array_distinct({all_labels})), ',') AS labels",
        f"coalesce(array_max({scores}), 0D) AS score",
        "CAST(size(found) AS BIGINT) AS n_found",
    )

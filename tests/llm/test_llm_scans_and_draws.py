"""Licence scan, importance resampling and tokenizer alignment against brute force and on odd inputs."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pageloom.llm import alignment, license_scan, resampling
from pageloom.llm.license_rules import CONFIDENCE, Rule, rules
from pageloom.llm.memory import Remembered
from pageloom.llm.queries import BYTE_BPE, PIECE_BPE

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LICENCE_TEXTS = [
    None, "", " ", "x", "MIT", "Licensed under the MIT License. mit license mit license MIT\nLICENSE",
    "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by"
    " the Free Software Foundation, either version 3 of the License, or later",
    "Apache License, Version 2.0 (the License); released under the Apache 2.0, CC BY-NC-SA 4.0, BSD-3-Clause licence",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files", "ÀPACHE LICENSE apache\x00license ümit license", "mit license " * 700 + "gpl v3 " * 300,
    "der Hund mit dem Ball", "gnu general public license general public license general public",
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def licences(text, table):
    """Plain search of every rule and comparison of every pair of detections."""
    w = words(text)
    base = [
        (i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w))
        if w[i : i + len(phrase.split())] == phrase.split()
    ]
    spaced, place, at = "".join(f" {x} " for x in w), {}, 0
    for i, x in enumerate(w):
        place[at] = i
        at += len(x) + 2
    place[at] = len(w)
    found = [
        (place[m.start()], place[m.end()], r.priority, n)
        for n, r in enumerate(table) if set(w) & set(r.keywords)
        for m in re.finditer(license_scan.spaced(r.pattern), spaced)
    ]
    kept = [
        d for d in found
        if not any(h[0] <= d[0] and h[1] >= d[1] and h[2] >= d[2] and (h[0], -h[1], -h[2], h[3]) < (d[0], -d[1], -d[2], d[3])
                   for h in found)
    ]
    return len(w), sorted(base), sorted((table[n].label, table[n].form, s, e) for s, e, _, n in kept)


def test_licences_equal_brute_force(spark):
    df = spark.createDataFrame(
        [(i, t, i, "x", [1]) for i, t in enumerate(LICENCE_TEXTS)],
        "doc_id bigint, text string, n_words int, found string, base array<int>",
    )
    scanned = license_scan.scan(df)
    found = {r["doc_id"]: r for r in scanned.collect()}
    for i, text in enumerate(LICENCE_TEXTS):
        n, base, kept = licences(text, rules())
        assert found[i]["n_words"] == n
        assert sorted((b["start"], b["label"]) for b in found[i]["base"]) == base
        assert sorted(map(tuple, found[i]["found"])) == kept
    summary = {r["doc_id"]: r for r in license_scan.summary(scanned).collect()}
    assert summary[5]["labels"] == "mit" and summary[5]["n_base"] == 4 and summary[5]["first_word"] == 3
    assert summary[6]["labels"] == "gpl-2.0" and summary[6]["score"] == CONFIDENCE["tag"]
    assert summary[8]["base_labels"] == "gpl" and summary[8]["labels"] == "gpl,gpl-3.0"
    assert summary[9]["labels"] == "apache,apache-2.0,bsd-3-clause,cc-by-nc-sa"
    assert (summary[13]["labels"], summary[13]["score"]) == ("", 0.0)
    assert summary[0]["last_word"] is None
    assert license_scan.scan(df.where("false")).count() == 0


def test_licences_suppress_by_priority_and_place(spark):
    table = [
        Rule("whole", "text", ("a",), "a b c d"), Rule("inner", "grant", ("a",), "b c"),
        Rule("sure", "tag", ("a",), "c"), Rule("first", "name", ("a",), "e f"), Rule("second", "name", ("a",), "e f"),
        Rule("gated", "name", ("z",), "e"), Rule("across", "name", ("a",), "d e"),
    ]
    texts = ["a b c d e f", "b c e f", "a e f b c " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: sorted(map(tuple, r["found"])) for r in license_scan.scan(df, table).collect()}
    assert [f[0] for f in found[0]] == ["across", "first", "sure", "whole"]
    assert found[1] == []  # no keyword
    for i, text in enumerate(texts):
        assert found[i] == licences(text, table)[2]


def test_every_rule_holds_a_keyword_and_is_bounded():
    found = rules()
    assert len(found) > 300
    for r in found:
        assert r.keywords and all(re.fullmatch("[a-z0-9]+", k) for k in r.keywords)
        # No repetition without an upper bound: the engine neither recurses nor runs on.
        assert not re.search(r"\)[+*]", r.pattern)


def draw(docs, target, percent=10, least=20, buckets=10_000, run=1, seed=2024):
    def hashed(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, run + 1) for i in range(len(w) - n + 1)]

    held = [(i, len(words(t)), hashed(t)) for i, t in docs]
    corpus, wanted = collections.Counter(), collections.Counter()
    for _, _, b in held:
        corpus.update(b)
    for t in target:
        wanted.update(hashed(t))
    s_all, t_all = sum(corpus.values()), sum(wanted.values())

    def gain(b):
        return math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((corpus[b] + 1) * (t_all + buckets))))

    found = []
    for i, n, b in held:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, b))
        found.append((i, n, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    drawable = sorted((f for f in found if f[1] >= least), key=lambda f: (-f[4], f[0] is None, f[0] or 0))
    drawn = drawable[: percent * len(drawable) // 100]
    ranked = [(*f, k) for k, f in enumerate(drawn, 1)]
    rest = collections.Counter(found)
    rest.subtract(drawn)
    return sorted([*ranked, *((*f, None) for f in rest.elements())], key=repr)


DOCS = [(i, " ".join(f"w{(i * j) % 97} Ünder" for j in range(i % 40))) for i in range(300)]
DOCS += [(7, DOCS[39][1])] * 60 + [(None, DOCS[38][1]), (-3, None), (-4, ""), (-5, "a " * 9000)]
TARGET = ["w1 w2 w3 ünder", None, "w96 " * 50, ""]


@pytest.mark.parametrize("settings", [{}, {"percent": 50, "run": 2, "buckets": 64}, {"percent": 100, "least": 0}, {"percent": 0}])
def test_resampling_equals_brute_force(spark, settings):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in DOCS], "doc_id bigint, text string, score int, row int")
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, doc_id int")
    names = {"least": "least_words"}
    drawn = resampling.resample(docs, target, **{names.get(k, k): v for k, v in settings.items()})
    assert sorted(map(tuple, drawn.collect()), key=repr) == draw(DOCS, TARGET, **settings)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame(DOCS[:50], "doc_id bigint, text string")
    none = docs.where("false")
    assert resampling.resample(none, docs).count() == 0
    assert sorted(map(tuple, resampling.resample(docs, none).collect()), key=repr) == draw(DOCS[:50], [])


def test_quickselect_finds_every_key(spark):
    scored = spark.range(500).selectExpr("id % 3 AS score", "if(id % 5 = 0, NULL, id % 20) AS doc_id", "id AS row")
    keys = sorted((-r["score"], r["doc_id"] is None, r["doc_id"] or 0, r["row"]) for r in scored.collect())
    for k in (1, 2, 166, 250, 499, 500):
        assert resampling.kth_key(scored, k, pivots=3) == keys[k - 1]
    with pytest.raises(ValueError):
        resampling.kth_key(scored, 501)


ALIGNED = [
    None, "", " ", "a  b\n \n c", "the quick brown fox", "the quick brown fox", "Ça va? ΣΑΣ <|endoftext|>x\x1cq\x85r <s> </s>",
    "漢字漢字 👍🏽👍 é", "\t\t\x00 \xa0x", " leading", "trailing ", "literal ▁ mark", "ﬁ ｆｕｌｌ width", "<0x41> A", "x" * 5000,
    "漢" * 2000, "don't we'll I'M", "a᠎ b 　 c", "﻿bom 1 234 5.6", "rare \U000e0001 tag",
]


def byte_ends(ids, held):
    at, ends = 0, []
    for i in ids:
        at += len(held[i])
        ends.append(at)
    return ends


def aligned_plainly(text, aligner, library, pieces):
    """Groups and byte offsets from whole texts; nothing but decoded bytes."""
    if not text:
        return 0, 0, [], [], []
    a, b = library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    data = (" " + text).encode()
    if b"".join(aligner.a_bytes[i] for i in a) != data or b"".join(aligner.b_bytes[i] for i in b) != data:
        return 0, 0, [], [], []
    a_ends, b_ends = byte_ends(a, aligner.a_bytes), byte_ends(b, aligner.b_bytes)
    cuts = sorted(set(a_ends) & set(b_ends))
    groups, before = [], 0
    for cut in cuts:
        own = [[str(i) for i, e in zip(ids, ends) if before < e <= cut] for ids, ends in ((a, a_ends), (b, b_ends))]
        groups.append("|".join(",".join(o) for o in own))
        before = cut
    links = [(i, j) for i, e in zip(a, a_ends) for j, f in zip(b, b_ends) if e == f]
    return len(a), len(b), groups, cuts, links


def test_alignment_equals_brute_force(spark):
    aligner = alignment.Aligner(BYTE_BPE, PIECE_BPE)
    library = Tokenizer.from_file(BYTE_BPE)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    docs = spark.createDataFrame(
        [(i, t, 1, [2]) for i, t in enumerate(ALIGNED)], "doc_id bigint, text string, groups int, pairs array<int>"
    )
    plain = [aligned_plainly(t, aligner, library, pieces) for t in ALIGNED]
    assert not plain[11][0] and plain[7][0] and plain[14][0]
    found = {r["doc_id"]: r for r in alignment.align(docs, BYTE_BPE, PIECE_BPE).collect()}
    for i, (n_a, n_b, groups, cuts, _) in enumerate(plain):
        r = found[i]
        assert (r["n_a"], r["n_b"], r["n_groups"]) == (n_a, n_b, len(groups)), ALIGNED[i]
        assert r["groups"] == ";".join(groups) and r["cuts"] == cuts
    counts = collections.Counter(link for *_, links in plain for link in links)
    highest = collections.defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    a, b = alignment.pair_ids("pair")
    listed = alignment.link_counts(alignment.align(docs, BYTE_BPE, PIECE_BPE)).selectExpr(f"{a} AS a", f"{b} AS b", "n")
    assert {(r["a"], r["b"]): r["n"] for r in listed.collect()} == counts
    rated = {r["doc_id"]: r for r in alignment.alignment(docs, BYTE_BPE, PIECE_BPE).collect()}
    for i, (_, _, groups, _, links) in enumerate(plain):
        r = rated[i]
        assert r["n_links"] == len(links)
        assert r["n_best"] == sum(counts[x] == highest[x[1]] for x in links)
        assert r["count_sum"] == sum(counts[x] for x in links)
        assert r["groups_sha256"] == (hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
    assert alignment.alignment(docs.where("false"), BYTE_BPE, PIECE_BPE).count() == 0
    no_tokens = alignment.alignment(docs.where("doc_id < 2"), BYTE_BPE, PIECE_BPE).collect()
    assert [(r["n_links"], r["count_sum"], r["groups_sha256"]) for r in no_tokens] == [(0, 0, "")] * 2


def test_linked_pairs_end_with_one_another():
    """The bound of what is broadcast: of two linked tokens one's bytes are the end of the other's."""
    aligner = alignment.Aligner(BYTE_BPE, PIECE_BPE)
    for kept in filter(None, aligner.batch([t or "" for t in ALIGNED])):
        for entry in kept:
            for pair in np.frombuffer(entry[4], np.int64).tolist():
                a, b = aligner.a_bytes[pair >> alignment.B_BITS], aligner.b_bytes[pair & (2**alignment.B_BITS - 1)]
                assert a.endswith(b) or b.endswith(a)


def test_refined_ends_of_shared_characters():
    # Two tokens of one character of three bytes, then byte-fallback tokens with empty spans.
    ends = alignment.refine(np.array([0, 1, 1, 4, 4, 4]), np.array([1, 4, 4, 4, 4, 7]), np.array([1, 1, 2, 1, 1, 1]))
    assert ends.tolist() == [1, 2, 4, 5, 6, 7]


def test_remembered_is_bounded_and_of_one_operator():
    first, second = Remembered(1000), Remembered(1000)
    for i in range(100):
        first.keep(i, -i, 50)
    assert first.held <= 600 and len(first) + len(first.earlier) <= 24 and first[99] == -99
    second.keep_all({1: 2}, 50)
    assert not first and not first.earlier and second[1] == 2

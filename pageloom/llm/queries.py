"""The registered queries over the operators of this package, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import (
    alignment,
    bpe,
    exact_dedup,
    license_scan,
    ngram_join,
    packing,
    pii,
    quality,
    resampling,
    secret_scan,
    token_counts,
    topk,
    wrappers,
)
from pageloom.llm.license_rules import rules

BYTE_BPE, WORD_BPE, PIECE_BPE = map(
    public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = wrappers.main_texts(_table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_by_section(
        _table(spark, sf_dir, "documents"), BYTE_BPE, rule="most"
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), WORD_BPE)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find_pii(_table(spark, sf_dir, "documents")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = _table(spark, sf_dir, "embeddings")
    return topk.top_k(embeddings, embeddings.where("vec_id % 100 = 0"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(_table(spark, sf_dir, "documents")))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.drop("n_words")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(_table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_html,
        op3_token_counts,
        op4_secrets,
        op5_bpe,
        op6_pii,
        op7_exact_dedup,
        op8_ngram_join,
        op9_top_k,
        op10_packing,
        op11_licenses,
        op12_resampling,
        op13_alignment,
    )
}

_WORDS = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _license_sql() -> str:
    """All matches of all rules, and those that no other one holds."""
    table = ", ".join(
        f"({n}, {_sql_text(r.label)}, {license_scan.CONFIDENCE[r.form]}::DOUBLE, {r.priority},"
        f" {list(r.keywords)}, {_sql_text(license_scan.spaced(r.pattern))})"
        for n, r in enumerate(rules())
    )
    phrases = ", ".join(f"({list(p.split())}, '{label}')" for p, label in license_scan.BASE.items())
    return rf"""
        WITH rules(rule, label, sure, priority, keys, p) AS (VALUES {table}),
        phrases(phrase, label) AS (VALUES {phrases}),
        w AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS w FROM documents),
        t AS (SELECT id, w, ' ' || array_to_string(w, '  ') || ' ' AS t FROM w WHERE len(w) > 0),
        base AS (
            SELECT id, i - 1 AS place, label
            FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM w), phrases
            WHERE w[i] = phrase[1] AND w[i:i + len(phrase) - 1] = phrase
        ),
        marked AS (
            SELECT id, rule, label, sure, priority,
                   string_split(trim(regexp_replace(t, p, ' ' || chr(1) || '\1' || chr(2) || ' ', 'g'), ' '), '  ') AS m
            FROM t JOIN rules ON list_has_any(w, keys) WHERE regexp_matches(t, p)
        ),
        spans AS (
            SELECT id, rule, label, sure, priority,
                   unnest(list_filter(range(0, len(m)), lambda i: starts_with(m[i + 1], chr(1)))) AS s,
                   unnest(list_filter(range(1, len(m) + 1), lambda i: ends_with(m[i], chr(2)))) AS e
            FROM marked
        ),
        kept AS (
            SELECT * FROM spans d WHERE NOT EXISTS (
                SELECT 1 FROM spans h
                WHERE h.id = d.id AND h.s <= d.s AND h.e >= d.e AND h.priority >= d.priority
                  AND (h.s < d.s OR h.e > d.e OR h.priority > d.priority OR h.rule < d.rule))
        ),
        bases AS (SELECT id, count(*) AS n, min(place) AS a, max(place) AS z, list(label) AS l FROM base GROUP BY id),
        founds AS (SELECT id, count(*) AS n, max(sure) AS sure, list(label) AS l FROM kept GROUP BY id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base,
               b.a::BIGINT AS first_word, b.z::BIGINT AS last_word,
               array_to_string(list_sort(list_distinct(coalesce(b.l, []))), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(b.l, []), coalesce(f.l, [])))), ',') AS labels,
               greatest(coalesce(f.sure, 0), if(b.n IS NULL, 0, {license_scan.BASE_CONFIDENCE}))::DOUBLE AS score,
               coalesce(f.n, 0)::BIGINT AS n_found
        FROM w LEFT JOIN bases b USING (id) LEFT JOIN founds f USING (id)
    """


#: crc32 of each byte value, from its polynomial; then of words, byte by byte.
_RESAMPLING_SQL = rf"""
    WITH RECURSIVE steps(b, c, k) AS (
        SELECT i, i, 0 FROM range(256) r(i)
        UNION ALL
        SELECT b, if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1), k + 1 FROM steps WHERE k < 8
    ),
    crcs AS (SELECT list(c ORDER BY b) AS crc FROM steps WHERE k = 8),
    docs AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS w FROM documents),
    bench AS (SELECT {_WORDS} AS w FROM benchmark),
    vocabulary AS (
        SELECT DISTINCT unnest(w) AS word FROM (SELECT w FROM docs UNION ALL SELECT w FROM bench)
    ),
    bucket AS (
        SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(
                   range(0, strlen(word)), lambda i: ('0x' || hex(encode(word))[2 * i + 1:2 * i + 2])::BIGINT)),
                   lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) % 10000 AS b
        FROM vocabulary, crcs
    ),
    doc_words AS (SELECT id, unnest(w) AS word FROM docs),
    s AS (SELECT b, count(*) AS s FROM doc_words JOIN bucket USING (word) GROUP BY b),
    t AS (SELECT b, count(*) AS t FROM (SELECT unnest(w) AS word FROM bench) JOIN bucket USING (word) GROUP BY b),
    gain AS (
        SELECT r.b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
               / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS g
        FROM range(10000) r(b) LEFT JOIN s ON s.b = r.b LEFT JOIN t ON t.b = r.b
    ),
    weights AS (
        SELECT id, sum(g)::BIGINT AS weight FROM doc_words JOIN bucket USING (word) JOIN gain USING (b) GROUP BY id
    ),
    scored AS (
        SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
               (coalesce(weight, 0) + floor(-1000 * ln(-ln(
                   (('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
        FROM docs LEFT JOIN weights USING (id)
    ),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
               count(*) FILTER (n_features >= 20) OVER () AS n
        FROM scored
    )
    SELECT doc_id, n_features, weight, score, if(n_features >= 20 AND place <= 10 * n // 100, place, NULL)::BIGINT AS rank
    FROM placed
"""

ORACLES = {
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op8_ngram_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ),
        grams AS (
            SELECT doc_id, unnest(list_distinct(CASE
                WHEN len(w) = 0 THEN []
                WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g
            FROM words
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
            FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY ALL
        ),
        links AS (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * common >= 80 * (x.n + y.n - common)
        ),
        reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM words
            UNION
            SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
        )
        SELECT r.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
        FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id
        GROUP BY r.doc_id
    """,
    "op9_top_k": """
        WITH vectors AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scores AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
            FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank,
               vec_id, score
        FROM scores
        QUALIFY rank <= 10
    """,
    "op11_licenses": _license_sql(),
    "op12_resampling": _RESAMPLING_SQL,
}

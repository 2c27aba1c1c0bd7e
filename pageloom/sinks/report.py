"""Crawl results as tables, as one JSON document in parts, and as a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import literal
from pageloom.operators.ranking import ordered_rank

HEAD, PAGES, FOOT = 0, 1, 2


def write_results(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result rows ``(url, markdown, depth)`` as Parquet, ORC or JSON Lines."""
    results.select("url", "markdown", "depth").write.format(fmt).save(path)


def _json_string(value: str) -> str:
    """A JSON string literal that is also safe inside HTML."""
    quoted = f"substring(to_json(named_struct('v', {value})), 6)"
    out = f"substring({quoted}, 1, length({quoted}) - 1)"
    unsafe = [(c, f"{ord(c):04x}") for c in ("<", ">", "&", chr(0x2028), chr(0x2029))]
    for char, code in unsafe:
        out = f"replace({out}, {literal(char)}, {literal(chr(92) + 'u' + code)})"
    return out


def report_lines(results: DataFrame, start_url: str) -> DataFrame:
    """The JSON report ``{pages, total, url}`` cut into rows ``(section, depth, path, text)``.

    The rows in order, joined by line ends, are one JSON document with two-space
    indent.  No row holds more than one page, so a report of any size can be
    written in parallel.  ``(depth, path)`` must be unique.
    """
    # Exactly one row: the key of the last page, which has no comma after it.
    last = results.agg(F.max(F.struct("depth", "path")).alias("_last")).selectExpr(
        "_last.depth AS depth", "_last.path AS path", "true AS is_last"
    )
    page = f"""concat('    {{\\n      "url": ', {_json_string('url')},
        ',\\n      "markdown": ', {_json_string('markdown')},
        ',\\n      "depth": ', depth, '\\n    }}', if(is_last, '', ','))"""
    body = (
        results.join(F.broadcast(last), ["depth", "path"], "left")
        .withColumn("is_last", F.coalesce("is_last", F.lit(False)))
        .selectExpr(f"{PAGES} AS section", "depth", "path", f"{page} AS text")
    )
    address = _json_string(literal(start_url))
    foot = f"""concat('  ],\\n  "total": ', count(*), ',\\n  "url": ', {address}, '\\n}}')"""
    empty = "cast(array() AS array<int>)"
    ends = results.agg(F.expr(foot).alias("foot")).selectExpr(
        f"""inline(array(
            struct({HEAD} AS section, 0 AS depth, {empty} AS path, '{{\\n  "pages": [' AS text),
            struct({FOOT} AS section, 0 AS depth, {empty} AS path, foot AS text)))"""
    )
    return body.unionByName(ends)


def write_report(lines: DataFrame, path: str) -> None:
    """Write the report as text parts; in name order they are one JSON document."""
    lines.orderBy("section", "depth", "path").select(F.col("text").alias("value")).write.text(path)


def summary_lines(results: DataFrame) -> DataFrame:
    """``(site, number, line)``: ``[number] url (depth: n)`` in order of discovery."""
    ranked = ordered_rank(results.select("site", "url", "depth", "path"), ["site"], ["depth", "path"], "number")
    return ranked.select(
        "site", "number", F.format_string("[%d] %s (depth: %d)", "number", "url", "depth").alias("line")
    )


def summary_counts(results: DataFrame) -> DataFrame:
    """``(depth, n_pages)``."""
    return results.groupBy("depth").agg(F.count("*").alias("n_pages"))

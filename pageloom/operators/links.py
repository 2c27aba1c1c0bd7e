"""Links of captured pages, without building a tree and without a shuffle.

The HTML is cut into tokens by one regular expression that knows comments, raw
text elements and quoted attributes, so an anchor inside a script, a comment or
another tag's attribute is not taken for a link.  All links of a page stay in
one array until they are resolved, normalised, filtered and made distinct; only
then are they exploded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import decode_attribute, each, extract, keep, let, literal
from pageloom.functions.urls import (
    allowlist_host,
    join_url,
    normalize_parts,
    normalize_url,
    normalized_host,
    resolve_parts,
    split_url,
)

_ATTRIBUTE = r"""[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+"""
# Elements whose content is text, never markup.
_RAW = "script|style|title|textarea|noscript|iframe|noembed|noframes|xmp"
# One common "<" up front, so that plain text costs one comparison per character.
_TOKENS = (
    r"(?s)<(?:!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|((?i:{_RAW}))(?=[\s/>])(?:{_ATTRIBUTE})*+[\s/]*+>.*?(?:</(?i:\1)(?=[\s/>])|\z)"
    rf"|[aA](?=[\s/>])((?:{_ATTRIBUTE})*+)[\s/]*+>"
    rf"|/?[a-zA-Z][^\s/>]*+(?:{_ATTRIBUTE})*+[\s/]*+>"
    r"|/?[a-zA-Z].*+)"
)
_HREF = (
    rf"""(?is)^(?:(?![\s/]*+href(?=[\s/=>]|$)){_ATTRIBUTE})*+[\s/]*+href\s*+=\s*+"""
    r"""(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))"""
)
MAX_LITERAL_ALLOWLIST = 10_000


def anchor_hrefs(html: str) -> str:
    """``href`` values of all anchors in document order, empty ones left out."""
    anchors = keep(f"regexp_extract_all({html}, {literal(_TOKENS)}, 2)", lambda a: f"{a} != ''")

    def value(anchor: str) -> str:
        return f"concat({', '.join(extract(anchor, _HREF, group) for group in (1, 2, 3))})"

    return each(keep(each(anchors, value), lambda v: f"{v} != ''"), decode_attribute)


def raw_links(pages: DataFrame, *, base: str = "normalized") -> DataFrame:
    """``(page_id, url, pos, href, abs_url)``: every anchor with its absolute URL, unfiltered.

    ``base="normalized"`` resolves against the normalised page URL, whose
    trailing slash is gone; ``base="raw"`` resolves as a browser would.
    """

    def absolute(href: str) -> str:
        return let(split_url(href), lambda ref: let(resolve_parts("_base", ref), join_url))

    return (
        pages.selectExpr(
            "page_id",
            f"{normalize_url('url')} AS url",
            f"{split_url(_base_url(base))} AS _base",
            f"{anchor_hrefs('html')} AS _hrefs",
        )
        .selectExpr("page_id", "url", "_base", _unnest("_hrefs", "pos", "href"))
        .where("href IS NOT NULL")
        .selectExpr("page_id", "url", "pos", "href", f"{absolute('href')} AS abs_url")
    )


def _base_url(base: str) -> str:
    if base not in ("normalized", "raw"):
        raise ValueError("base must be 'normalized' or 'raw'")
    return normalize_url("url") if base == "normalized" else "url"


def page_links(
    pages: DataFrame, *, same_host: bool = True, base: str = "normalized"
) -> DataFrame:
    """One row per page: ``url`` (normalised) and ``links``, an array of distinct ``(url, host)``.

    ``same_host=True`` keeps links to the page's own host (with port), the rule
    when no allowlist is given.  The order is that of first occurrence.  A page
    whose own URL is malformed has NULL links.
    """
    resolved = each(
        each("array_distinct(_hrefs)", split_url), lambda ref: resolve_parts("_base", ref)
    )

    def with_host(link: str) -> str:
        return f"named_struct('url', {link}, 'host', {normalized_host(link)})"

    found = each(resolved, lambda part: let(normalize_parts(part), with_host))
    test = " AND {0}.host = _host" if same_host else ""
    links = keep(found, lambda link: f"{link}.url IS NOT NULL" + test.format(link))
    return (
        pages.selectExpr(
            "page_id",
            f"{normalize_url('url')} AS url",
            f"{split_url(_base_url(base))} AS _base",
            f"{anchor_hrefs('html')} AS _hrefs",
        )
        .selectExpr("*", f"{normalized_host('url')} AS _host")
        .selectExpr("page_id", "url", f"array_distinct({links}) AS links")
    )


def extract_links(
    pages: DataFrame,
    allowed: Sequence[str] | DataFrame | None = None,
    *,
    lower_allowlist: bool = True,
    base: str = "normalized",
) -> DataFrame:
    """``(page_id, url, pos, link)``: distinct followable links of each page.

    ``allowed`` are domains, as a list or a one-column DataFrame ``domain`` of any
    size, or nothing (links to the page's own host).  ``pos`` counts the kept
    links of a page in order of first occurrence.

    Up to ``MAX_LITERAL_ALLOWLIST`` distinct hosts are tested within the page's
    array, as a hashed list, so that no link is moved; only the hosts of the
    allowlist itself are exchanged.  More of them are joined.
    """
    if allowed is None:
        return _edges(page_links(pages, base=base)).drop("host")
    hosts = allowed_hosts(pages, allowed, lower=lower_allowlist)
    found = page_links(pages, same_host=False, base=base)
    listed = host_list(hosts)
    if listed is None:
        return _filter_by_table(found, hosts)
    kept = keep("links", lambda link: f"{link}.host IN ({listed})")
    return _edges(found.selectExpr("page_id", "url", f"{kept} AS links")).drop("host")


def _unnest(values: str, pos: str, item: str) -> str:
    """Explode with positions; callers drop the NULL row of an empty array.

    The plain form would make the optimizer repeat the whole array expression in
    a filter on its size.
    """
    return f"posexplode_outer({values}) AS ({pos}, {item})"


def _edges(found: DataFrame) -> DataFrame:
    flat = found.selectExpr("page_id", "url", _unnest("links", "pos", "_link"))
    kept = flat.where("_link IS NOT NULL")
    return kept.selectExpr("page_id", "url", "pos", "_link.url AS link", "_link.host AS host")


def allowed_hosts(pages: DataFrame, allowed: Sequence[str] | DataFrame, *, lower: bool = True) -> DataFrame:
    """The distinct hosts ``(host)`` of an allowlist, by one rule for lists and tables."""
    if not isinstance(allowed, DataFrame):
        allowed = pages.sparkSession.createDataFrame([(domain,) for domain in allowed], "domain string")
    return normalize_allowlist(allowed, lower=lower).select("host").where("host IS NOT NULL").distinct()


def host_list(hosts: DataFrame) -> str | None:
    """The hosts as the content of an ``IN`` list, or nothing if they are more than ``MAX_LITERAL_ALLOWLIST``."""
    few = [row.host for row in hosts.limit(MAX_LITERAL_ALLOWLIST + 1).collect()]
    if len(few) > MAX_LITERAL_ALLOWLIST:
        return None
    return ", ".join(map(literal, few)) or "NULL"


def normalize_allowlist(allowed: DataFrame, *, lower: bool = True) -> DataFrame:
    """``(domain, host)``: the host each allowlist entry stands for."""
    return allowed.selectExpr("domain", f"{allowlist_host('domain', lower=lower)} AS host")


def _filter_by_table(found: DataFrame, hosts: DataFrame) -> DataFrame:
    """Allowlist as a table: semi-join on the host.

    No broadcast hint: the list may be large, and Spark broadcasts it by itself
    when its size is known to be small.  Popular hosts are split by the adaptive
    skew join, which covers the left side of a semi-join.  Positions are those
    within the page, so the window is bounded by one page.
    """
    kept = _edges(found).join(hosts, "host", "left_semi")
    order = Window.partitionBy("page_id").orderBy("pos")
    return kept.select(
        "page_id", "url", (F.row_number().over(order) - 1).alias("pos"), "link"
    )


def link_graph(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges ``(src, dst, pos, src_id, dst_id)``; ``dst_id`` is NULL for uncaptured targets.

    Many edges may point at one popular page, which is the streamed side of an
    outer join and so is split by the adaptive skew join.
    """
    captured = captures(pages).select(F.col("url").alias("dst"), F.col("page_id").alias("dst_id"))
    edges = links.select(
        F.col("url").alias("src"), F.col("link").alias("dst"), "pos", F.col("page_id").alias("src_id")
    )
    return edges.join(captured, "dst", "left").select("src", "dst", "pos", "src_id", "dst_id")


def link_degrees(links: DataFrame) -> DataFrame:
    """``(url, n_out, n_in)`` for every page or target.

    One grouping with map-side partial sums; no join back to the edges.
    """
    ends = F.array(
        F.struct(F.col("url").alias("url"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("link").alias("url"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    return (
        links.select(F.inline(ends))
        .groupBy("url")
        .agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    )


def captures(pages: DataFrame) -> DataFrame:
    """Captured pages keyed by normalised URL; of equal URLs the lowest ``page_id`` stays.

    An aggregate with map-side combine over narrow columns; HTML is not shuffled.
    """
    return (
        pages.selectExpr("page_id", f"{normalize_url('url')} AS url")
        .where("url IS NOT NULL")
        .groupBy("url")
        .agg(F.min("page_id").alias("page_id"))
    )

"""Pages as Markdown documents: one file per page, or one single file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.urls import url_filename
from pageloom.operators.ranking import ordered_rank

# Head of a document and the blank line rules around it; two spaces force a line break.
_DOCUMENT = r"""concat('# ', url, '\n\n**Source URL:** ', url, '  \n**Depth:** ', depth, '  \n\n---\n\n',
    markdown, '\n')"""


def page_documents(results: DataFrame) -> DataFrame:
    """Adds ``document`` to result rows ``(url, markdown, depth, ...)``."""
    return results.withColumn("document", F.expr(_DOCUMENT))


def export_layout(results: DataFrame, path: str) -> DataFrame:
    """One row ``(total, mode, target)``: how results would be written to ``path``.

    A path ending in ``.md`` names a file if there is exactly one page; otherwise
    the ending is cut and the rest is a directory.
    """
    is_file_name = path.lower().endswith(".md")
    folder = path[:-3] if is_file_name else path
    single = (F.col("total") == 1) & F.lit(is_file_name)
    return results.agg(F.count("*").alias("total")).select(
        "total",
        F.when(single, "file").otherwise("directory").alias("mode"),
        F.when(single, path).otherwise(folder).alias("target"),
    )


def document_files(results: DataFrame, order: list[str], index: str | None = None) -> DataFrame:
    """Adds ``file``; of pages with the same file name the last by ``order`` stays.

    ``order`` and ``url`` together name a row and must be unique; NULL URLs and
    several captures of one URL are allowed.  ``index`` is the zero-based number
    for URLs no name can be made of, by default a row's place in ``order``.

    URLs that differ only in their query share a name, so one name may be very
    frequent.  The winner is found by an aggregate over narrow columns with
    map-side combine; page texts take part only in the last join.
    """
    keys = list(dict.fromkeys([*order, "url"]))
    if index is None:
        numbered = ordered_rank(results.select(keys), [], keys, "_index").withColumn("_index", F.col("_index") - 1)
    else:
        numbered = results.select(*keys, F.expr(index).alias("_index"))
    named = numbered.select(F.expr(url_filename("url", "_index")).alias("file"), F.struct(*keys).alias("_key"))
    winners = named.groupBy("file").agg(F.max("_key").alias("_key"))
    # Fields of a struct compare NULL with NULL as equal, so no row without a URL is lost.
    return results.withColumn("_key", F.struct(*keys)).join(winners, "_key").drop("_key")


def write_document_table(results: DataFrame, path: str, order: list[str], parts: int) -> None:
    """The page documents as ``(file, document)`` in ``parts`` Parquet files sorted by ``file``.

    The form for any number of pages: few files are listed and committed, and a
    lookup by name reads the one part whose range holds it.
    """
    chosen = page_documents(document_files(results, order)).select("file", "document")
    chosen.repartitionByRange(parts, "file").sortWithinPartitions("file").write.parquet(path)


def write_documents(results: DataFrame, path: str, order: list[str]) -> str:
    """Write result pages below ``path`` and return the target.

    In directory mode every page gets its own folder ``file=<name>``, which suits
    exports of some thousands of pages; ``write_document_table`` takes any number.
    In file mode the target holds one text part.
    """
    layout = export_layout(results, path).first()
    # The text writer ends every value with a line end of its own.
    body = F.expr("substring(document, 1, length(document) - 1)").alias("value")
    if layout["mode"] == "file":
        page_documents(results).select(body).coalesce(1).write.text(layout["target"])
    else:
        chosen = page_documents(document_files(results, order))
        chosen.select("file", body).write.partitionBy("file").text(layout["target"])
    return layout["target"]

"""Trees of captured pages: one row per page with its nodes as an array or with its Markdown, or one row per node.

Python runs here on Arrow batches inside the tasks; outside ``llm`` it is the only
one.  One page is one input row, so a batch never needs more than its pages.
Columns that the caller does not ask for are not built.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.session import estimated_bytes
from pageloom.sources import fold, tree
from pageloom.sources.fold import body_markdown
from pageloom.sources.tree import TreeBuilder, flatten, flatten_into

# Ship this code with the task, so that executors need no installed package.
for _module in (tree, fold, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

NODE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),  # on the first node of a page only
        T.StructField("node_id", T.IntegerType()),  # position in document order
        T.StructField("end_id", T.IntegerType()),  # last descendant
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("sib_no", T.IntegerType()),
        T.StructField("kind", T.StringType()),  # element, text or comment
        T.StructField("tag", T.StringType()),  # for text and comments: the parent's tag
        T.StructField("text", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ancestors", T.ArrayType(T.IntegerType())),  # root first
        T.StructField("ancestor_tags", T.ArrayType(T.StringType())),
    ]
)
_ARROW = {
    "page_id": pa.int64(),
    "url": pa.string(),
    "kind": pa.string(),
    "tag": pa.string(),
    "text": pa.string(),
    "attrs": pa.map_(pa.string(), pa.string()),
    "ancestors": pa.list_(pa.int32()),
    "ancestor_tags": pa.list_(pa.string()),
}
ROWS_PER_BATCH = 20_000
CHARACTERS_PER_BATCH = 16_000_000
SMALL_SPLIT = 16 * 1024 * 1024


def shred(pages: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Tree nodes of ``pages(page_id, url, html)``; pages without HTML give no rows.

    A page whose capture failed (NULL html) has no nodes.  Few input splits are
    spread over the cluster first, since parsing is work per byte.
    """
    names = [f.name for f in NODE_SCHEMA if columns is None or f.name in columns]
    schema = T.StructType([NODE_SCHEMA[name] for name in names])
    source = spread(pages.select("page_id", "url", "html").where("html IS NOT NULL"))
    return source.mapInArrow(lambda batches: _shred_batches(batches, names), schema)


#: Fields of a node in the tree of a page; its place in the array is its number in document order.
TREE_FIELDS = {
    "n": "node_id", "end": "end_id", "parent": "parent_id", "kind": "kind", "tag": "tag", "text": "text",
    "attrs": "attrs", "up": "ancestors",
}


def page_trees(pages: DataFrame, fields: Sequence[str] = tuple(TREE_FIELDS)) -> DataFrame:
    """``(page_id, url, nodes)``: one row per page with HTML, ``nodes`` in document order.

    A node is ``struct<n, end, parent, kind, tag, text, attrs, up>``: its number,
    its last descendant, its parent, and its ancestors from the root down.
    Fields that are not asked for are not built.
    """
    names = [name for name in TREE_FIELDS if name in fields]
    node = T.StructType([T.StructField(name, NODE_SCHEMA[TREE_FIELDS[name]].dataType) for name in names])
    schema = T.StructType([NODE_SCHEMA["page_id"], NODE_SCHEMA["url"], T.StructField("nodes", T.ArrayType(node))])
    source = spread(pages.select("page_id", "url", "html").where("html IS NOT NULL"))
    return source.mapInArrow(lambda batches: _tree_batches(batches, names), schema)


def _tree_batches(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    def fresh() -> dict[str, list]:
        return {name: [] for name in (*TREE_FIELDS, "n_up")}

    def column(flat: dict[str, list], name: str) -> pa.Array:
        if name != "up":
            return pa.array(flat[name], _ARROW.get(TREE_FIELDS[name], pa.int32()))
        offsets = np.concatenate([[0], np.cumsum(flat["n_up"])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat["up"], pa.int32()))

    def packed(pages: list[tuple], flat: dict[str, list], offsets: list[int]) -> pa.RecordBatch:
        nodes = pa.StructArray.from_arrays([column(flat, name) for name in fields], fields)
        ids, urls = zip(*pages)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(urls, pa.string()),
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes)],
            ["page_id", "url", "nodes"],
        )

    pages, flat, offsets = [], fresh(), [0]
    for batch in batches:
        for page_id, url, text in zip(*(values.to_pylist() for values in batch.columns)):
            offsets.append(offsets[-1] + flatten_into(TreeBuilder(text).build(), flat))
            pages.append((page_id, url))
            if offsets[-1] >= ROWS_PER_BATCH:
                yield packed(pages, flat, offsets)
                pages, flat, offsets = [], fresh(), [0]
    if pages:
        yield packed(pages, flat, offsets)


def page_markdown(pages: DataFrame) -> DataFrame:
    """``(page_id, url, markdown)`` of the whole body of every page with HTML, as it is; trees stay in the tasks."""
    schema = T.StructType([NODE_SCHEMA["page_id"], NODE_SCHEMA["url"], T.StructField("markdown", T.StringType())])
    source = spread(pages.select("page_id", "url", "html").where("html IS NOT NULL"))
    return source.mapInArrow(_markdown_batches, schema)


def _markdown_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls = batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string())
        start, made, size = 0, [], 0
        for at, html in enumerate(batch.column(2).to_numpy(zero_copy_only=False), 1):
            made.append(body_markdown(TreeBuilder(html).build()))
            size += len(made[-1])
            if size >= CHARACTERS_PER_BATCH or at == batch.num_rows:
                columns = [ids[start:at], urls[start:at], pa.array(made, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "markdown"])
                start, made, size = at, [], 0


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when the input is too small to fill its splits.

    Only inputs known to be small are shuffled; large ones have splits enough
    and are left alone, so HTML is never shuffled at scale.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < estimated_bytes(df) < cores * SMALL_SPLIT else df


def _shred_batches(
    batches: Iterator[pa.RecordBatch], names: list[str]
) -> Iterator[pa.RecordBatch]:
    out: dict[str, list] = {name: [] for name in names}
    size = 0
    for batch in batches:
        for page_id, url, text in zip(*(column.to_pylist() for column in batch.columns)):
            rows, ends = flatten(TreeBuilder(text).build())
            for start in range(0, len(rows), ROWS_PER_BATCH):
                part = rows[start : start + ROWS_PER_BATCH]
                _add_rows(out, names, page_id, url, part, ends)
                size += len(part)
                if size >= ROWS_PER_BATCH:
                    yield _to_batch(out, names)
                    out, size = {name: [] for name in names}, 0
    if size:
        yield _to_batch(out, names)


def _add_rows(out: dict, names: list[str], page_id: int, url: str, rows: list, ends: list) -> None:
    values = {
        "page_id": lambda r: page_id,
        "url": lambda r: url if r[1] == 0 else None,
        "node_id": lambda r: r[1],
        "end_id": lambda r: ends[r[1]],
        "parent_id": lambda r: r[2],
        "depth": lambda r: r[3],
        "sib_no": lambda r: r[4],
        "kind": lambda r: r[0].kind,
        "tag": lambda r: r[0].tag if r[0].kind == "element" else r[6][-1],
        "text": lambda r: r[0].text,
        "attrs": lambda r: list(r[0].attrs.items()) if r[0].attrs else None,
        "ancestors": lambda r: r[5],
        "ancestor_tags": lambda r: r[6],
    }
    for name in names:
        out[name].extend(map(values[name], rows))


def _to_batch(out: dict, names: list[str]) -> pa.RecordBatch:
    arrays = [pa.array(out[name], _ARROW.get(name, pa.int32())) for name in names]
    return pa.RecordBatch.from_arrays(arrays, names)


def element_counts(nodes: DataFrame) -> DataFrame:
    """``(page_id, n_elements, n_texts, n_comments, max_depth)`` of every page."""
    return nodes.groupBy("page_id").agg(
        F.count_if(F.col("kind") == "element").alias("n_elements"),
        F.count_if(F.col("kind") == "text").alias("n_texts"),
        F.count_if(F.col("kind") == "comment").alias("n_comments"),
        F.max("depth").alias("max_depth"),
    )

"""Scans over arrays, as SQL expressions.

An array that grows by one element at a time is copied each time, so a plain
``aggregate`` over a long array takes its square.  These scans go by blocks:
within a block by copying, across blocks by their last results.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import let

BLOCK = 256
_names = itertools.count()


def running(values: str, op: Callable[[str, str], str]) -> str:
    """For each element ``op`` of all elements up to it; ``op`` must be associative."""
    def plain(array: str) -> str:
        acc, x = f"a{next(_names)}", f"x{next(_names)}"
        following = op(f"element_at({acc}, -1)", x)
        step = f"concat({acc}, array({following}))"
        return f"if(size({array}) = 0, {array}, aggregate(slice({array}, 2, size({array})), slice({array}, 1, 1), ({acc}, {x}) -> {step}))"

    def scanned(v: str) -> str:
        k, b = f"k{next(_names)}", f"b{next(_names)}"
        starts = f"sequence(0, (size({v}) - 1) div {BLOCK})"
        blocks = f"transform({starts}, {k} -> {let(f'slice({v}, {k} * {BLOCK} + 1, {BLOCK})', plain)})"

        def joined(s: str) -> str:
            def carried(c: str) -> str:
                x = f"x{next(_names)}"
                onward = f"transform({b}, {x} -> {op(f'{c}[{k} - 1]', x)})"
                return f"flatten(transform({s}, ({b}, {k}) -> if({k} = 0, {b}, {onward})))"

            return let(let(f"transform({s}, {b} -> element_at({b}, -1))", plain), carried)

        return f"if(size({v}) <= {BLOCK}, {plain(v)}, {let(blocks, joined)})"

    return let(values, scanned)


def running_max(values: str) -> str:
    return running(values, lambda a, b: f"greatest({a}, {b})")


def least_ahead(values: str) -> str:
    """For each element the least of it and all after it."""
    return f"reverse({running(f'reverse({values})', lambda a, b: f'least({a}, {b})')})"


def bind(df: DataFrame, **values: str | Column) -> DataFrame:
    """Adds columns that are evaluated once a row, however often they are used later.

    A plain projection would be merged into the next one, and a column used
    inside a lambda function would be evaluated for every element.
    """
    made = F.struct(*(F.expr(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in values.items()))
    return df.select("*", F.inline(F.array(made)))

"""Exclusive scans over the slices of cut keys, composed in a tree.

A slice of a key is a function from the state that it inherits to the state that it leaves. Such functions are packed into
a few bytes (``summaries``), and composing two of them is associative. Going up, groups of ``ARITY`` neighbours are composed into one
row until one group is left; going down, each group hands its members the state that they inherit. That takes two
jobs a level, so their number grows with the logarithm of the slices. No task sees more than ``ARITY`` summaries at a time, and
nothing comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoscribe.session import stored

ARITY = 16

Combine = Callable[[bytes, bytes], bytes]
Apply = Callable[["bytes | None", bytes], bytes]


def _schema(df: DataFrame, keys: list[str], *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in keys], *[T.StructField(n, t) for n, t in more]])


def carried(summaries: DataFrame, keys: list[str], place: str, slices: int, combine: Combine, apply: Apply) -> DataFrame:
    """``(*keys, place, carry)``: for each slice ``place`` of a key but its first, the state that it inherits.

    ``summaries`` has (*keys, place, summary); ``combine(a, b)`` is the function ``a`` followed by ``b``; ``apply(state, f)`` is the
    state that ``f`` leaves, where ``None`` is the state before a key's first slice."""
    node, up = "__node", "__up"
    names = [*keys, node]

    def grouped(df: DataFrame) -> DataFrame:
        return df.withColumn(up, F.floor(F.col(node) / ARITY).cast("long"))

    def rows(table: pa.Table, column: str) -> list[tuple[int, bytes | None]]:
        return sorted(zip(table.column(node).to_pylist(), table.column(column).to_pylist()))

    def made(like: pa.Table, schema: T.StructType, nodes: list[int], column: str, values: list) -> pa.Table:
        first = [pa.array([like.column(k)[0].as_py()] * len(nodes), like.schema.field(k).type) for k in keys]
        return pa.Table.from_arrays([*first, pa.array(nodes, pa.int64()), pa.array(values, pa.binary())], [*names, column])

    def merge(table: pa.Table) -> pa.Table:
        group = table.column(up)[0].as_py()
        return made(table, table.schema, [group], "summary", [reduce(combine, [s for _, s in rows(table, "summary")])])

    def descend(members: pa.Table, above: pa.Table | None) -> pa.Table:
        if not members.num_rows:
            return made(members, members.schema, [], "carry", []) if not keys else members.select(names).append_column("carry", pa.array([], pa.binary()))
        state = above.column("carry")[0].as_py() if above is not None and above.num_rows else None
        nodes, states = [], []
        for n, summary in rows(members, "summary"):
            nodes.append(n)
            states.append(state)
            state = apply(state, summary)
        return made(members, members.schema, nodes, "carry", states)

    level = stored(summaries.select(*keys, F.col(place).cast("long").alias(node), "summary"))
    levels, left = [level], slices
    merged = _schema(level, names, ("summary", T.BinaryType()))
    while left > ARITY:
        levels.append(stored(grouped(levels[-1]).groupBy(*keys, up).applyInArrow(merge, merged)))
        left = -(-left // ARITY)
    carry_schema = _schema(level, names, ("carry", T.BinaryType()))
    carry = stored(grouped(levels[-1]).groupBy(*keys, up).applyInArrow(lambda t: descend(t, None), carry_schema))
    for lower in reversed(levels[:-1]):
        above = carry.withColumnRenamed(node, up)
        both = grouped(lower).groupBy(*keys, up).cogroup(above.groupBy(*keys, up))
        carry = stored(both.applyInArrow(descend, carry_schema))
    return carry.filter("carry IS NOT NULL").select(*keys, F.col(node).cast("int").alias(place), "carry")

"""Nested reasoning trees of any depth as node tables.

A tree in JSON becomes a row a node in one pass of the table, numbered in pre-order: node
n's descendants are the nodes n + 1 to its ``last``, so subtrees are ranges and folds need no
pass a level. ``share`` is one over the number of siblings, multiplied from the root down.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_NODES = "node long, parent long, last long, depth int, n_children int, share double, fields string"


def _numbered(tree: dict, children: str) -> list[tuple]:
    """(node, parent, last, depth, n_children, share, fields) of a tree, by a stack of its own."""
    rows: list[list] = []
    todo = [(tree, None, 0, 1.0)]
    while todo:
        node, parent, depth, share = todo.pop()
        below = [c for c in node.get(children) or [] if isinstance(c, dict)]
        number = len(rows)
        fields = json.dumps({k: v for k, v in node.items() if k != children}, ensure_ascii=False)
        rows.append([number, parent, number, depth, len(below), share, fields])
        todo += [(c, number, depth + 1, share / len(below)) for c in reversed(below)]
    for row in reversed(rows):
        if row[1] is not None:
            rows[row[1]][2] = max(rows[row[1]][2], row[2])
    return [tuple(r) for r in rows]


def flattened(trees: DataFrame, key: str, tree: str, children: str = "children") -> DataFrame:
    """(key, node, parent, last, depth, n_children, share, fields) of the JSON trees in a column; fields is a node's JSON without its children.

    Null, and what is no JSON object, has no nodes; children that are no objects are none.
    """
    key_type = trees.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                try:
                    parsed = json.loads(text or "null")
                except ValueError:
                    continue
                if isinstance(parsed, dict):
                    found = _numbered(parsed, children)
                    keys += [k] * len(found)
                    rows += found
                if len(rows) > 50_000:
                    yield _batch(batch.column(0), keys, rows)
                    keys, rows = [], []
            if rows:
                yield _batch(batch.column(0), keys, rows)

    def _batch(column: pa.Array, keys: list[int], rows: list[tuple]) -> pa.RecordBatch:
        names = [c.split()[0] for c in _NODES.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([column.take(pa.array(keys, pa.int64())), *columns], names=[key, *names])

    return trees.select(key, tree).mapInArrow(walk, f"{key} {key_type}, {_NODES}")


def folded(nodes: DataFrame, key: str, leaf_value: Column) -> DataFrame:
    """nodes with value and value_std: leaves have leaf_value (0 where null), others mean and population deviation of their children's values.

    A mean of means is the sum over the leaves of a subtree of value times share, over the node's own share: a difference
    of running sums in pre-order, so the depth of a tree costs nothing. The joins merge: the size of what Python gives is
    only guessed, and a guess too low would send every node through the driver.
    """
    leaf = F.when(F.col("n_children") == 0, F.coalesce(leaf_value, F.lit(0.0)))
    w = W.partitionBy(key).orderBy("node")
    rows = nodes.withColumn("_leaf", leaf).withColumn("_sum", F.sum(F.coalesce(F.col("_leaf") * F.col("share"), F.lit(0.0))).over(w))
    ends = rows.select(key, F.col("node").alias("last"), F.col("_sum").alias("_until"))
    before = F.col("_sum") - F.coalesce(F.col("_leaf") * F.col("share"), F.lit(0.0))
    value = F.coalesce("_leaf", (F.col("_until") - before) / F.col("share"))
    valued = rows.join(ends.hint("merge"), [key, "last"]).withColumn("value", value).select(*nodes.columns, "value")
    spread = valued.where("parent is not null").groupBy(key, F.col("parent").alias("node")).agg(F.stddev_pop("value").alias("_s"))
    return valued.join(spread.hint("merge"), [key, "node"], "left").select(*nodes.columns, "value", F.coalesce("_s", F.lit(0.0)).alias("value_std"))


def ancestors(nodes: DataFrame, key: str) -> DataFrame:
    """(key, ancestor, node) for every node and each of its ancestors, itself included: by ranges, for trees of unknown depth."""
    above = nodes.select(key, F.col("node").alias("ancestor"), F.explode(F.sequence("node", "last")).alias("node"))
    return above.select(key, "ancestor", "node")

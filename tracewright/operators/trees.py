"""Reasoning trees as node tables: folds, paths, edges and path transformations.

A node table has tree_id, node_id, parent_id (null at the root), depth and what
the operator needs. Given the deepest level, an operator is one plan, which suits
shallow trees; without it levels are counted, and each is computed once from the
one before and written, so work grows with the nodes at any depth. Nested trees
come in through module ``nested``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.maths import best_of_k, importance_weight
from ..sources.writers import scratch


def _levels(nodes: DataFrame, deepest: int | None) -> tuple[DataFrame, int, Callable[[DataFrame], DataFrame]]:
    """nodes, their deepest level, and what to do with each level: nothing, or write it and read it back."""
    if deepest is not None:
        return nodes, deepest, lambda level: level
    spark, folder = nodes.sparkSession, scratch(nodes.sparkSession, "levels")
    nodes.write.partitionBy("depth").parquet(f"{folder}/nodes")
    back = spark.read.schema(nodes.schema).parquet(f"{folder}/nodes").select(*nodes.columns)
    made: list[str] = []

    def stored(level: DataFrame) -> DataFrame:
        made.append(f"{folder}/{len(made)}")
        level.write.parquet(made[-1])
        return spark.read.schema(level.schema).parquet(made[-1])

    return back, back.agg(F.max("depth")).first()[0] or 0, stored


def fold_means(nodes: DataFrame, leaf_value: Column, deepest: int | None = None) -> DataFrame:
    """nodes with value and value_std: leaves have leaf_value (0 where null), others the mean and population deviation
    of their children's values, a mean of means."""
    nodes, deepest, stored = _levels(nodes, deepest)
    levels: list[DataFrame] = []
    for depth in range(deepest, -1, -1):
        level = nodes.where(F.col("depth") == depth)
        if not levels:
            out = level.withColumn("value", F.coalesce(leaf_value, F.lit(0.0))).withColumn("value_std", F.lit(0.0))
        else:
            below = levels[-1].groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.avg("value").alias("_v"), F.stddev_pop("value").alias("_s"))
            out = level.join(below, ["tree_id", "node_id"], "left").select(*nodes.columns, F.coalesce("_v", leaf_value, F.lit(0.0)).alias("value"), F.coalesce("_s", F.lit(0.0)).alias("value_std"))
        levels.append(stored(out))
    return reduce(DataFrame.unionByName, levels)


def edges(nodes: DataFrame, value: str = "value") -> DataFrame:
    """A row per non-root node: its value, its parent's, and the advantage."""
    parent = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col(value).alias("parent_value"))
    return nodes.where("parent_id is not null").join(parent, ["tree_id", "parent_id"]).withColumn("advantage", F.col(value) - F.col("parent_value"))


def prover_edges(nodes: DataFrame, k: int = 4, drop_zero: bool = True) -> DataFrame:
    """Edges with the advantage of best-of-k sampling; those where both advantages sum to zero are dropped."""
    out = edges(nodes).withColumn("prover_advantage", best_of_k(F.col("value"), k) - best_of_k(F.col("parent_value"), k))
    return out.where("advantage + prover_advantage <> 0") if drop_zero else out


def paths(nodes: DataFrame, deepest: int | None, fields: list[str]) -> DataFrame:
    """(tree_id, leaf_id, chain) from root to leaf: chain is an array of structs of fields, by depth."""
    nodes, deepest, stored = _levels(nodes, deepest)
    item = F.struct(*fields)
    at = stored(nodes.where("parent_id is null").select("tree_id", "node_id", F.array(item).alias("chain")))
    has_child = nodes.where("parent_id is not null").select("tree_id", F.col("parent_id").alias("node_id")).distinct()
    out = None
    for depth in range(deepest + 1):
        leaves = at.join(has_child, ["tree_id", "node_id"], "left_anti").select("tree_id", F.col("node_id").alias("leaf_id"), "chain")
        out = leaves if out is None else out.unionByName(leaves)
        if depth == deepest:
            break
        child = nodes.where(F.col("depth") == depth + 1).select("tree_id", F.col("parent_id").alias("p"), F.col("node_id").alias("c"), item.alias("item"))
        at = stored(at.join(child, (at.tree_id == child.tree_id) & (at.node_id == child.p)).select(at.tree_id, F.col("c").alias("node_id"), F.concat("chain", F.array("item")).alias("chain")))
    return out


def weighted(chain_depth: Column, deepest: int, base: int) -> Column:
    return importance_weight(chain_depth, F.lit(deepest), base)


def _changed(chain: Column, name: str, value: Callable[[Column, Column], Column]) -> Column:
    return F.transform(chain, lambda n, i: n.withField(name, value(n, i)))


#: Predicates on a chain of nodes with score and advantage; node 0 is the query.
FILTERS: dict[str, Callable[[Column], Column]] = {
    "none": lambda c: F.lit(True),
    "successful": lambda c: F.element_at(c, -1)["score"] == 1,
    "non_zero_score": lambda c: F.get(c, F.lit(1))["score"] != 0,
    "non_zero_last_step_score": lambda c: F.element_at(c, -1)["score"] != 0,
    "zero_last_step_score": lambda c: F.element_at(c, -1)["score"] == 0,
    "non_zero_last_step_advantage": lambda c: F.element_at(c, -1)["advantage"] > 0,
}


def _first_negative(c: Column) -> Column:
    """Index of the first negative advantage after the query, or the length."""
    return F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.size(c), lambda s, i: F.when((s == F.size(c)) & (F.get(c, i)["advantage"] < 0), i).otherwise(s))


def _last_non_zero(c: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.size(c) - 1), F.lit(0), lambda s, i: F.when((i > 0) & (F.abs(F.get(c, i)["advantage"]) >= 1e-6), i).otherwise(s))


#: Transformations of a chain.
POST_PROCESSORS: dict[str, Callable[[Column], Column]] = {
    "chop_zero_advantage_tail": lambda c: F.slice(c, F.lit(1), _last_non_zero(c) + 1),
    "keep_first_step_only": lambda c: F.slice(c, 1, 2),
    "chop_up_to_first_negative_advantage": lambda c: F.when(F.size(c) > 1, F.slice(c, F.lit(1), _first_negative(c))).otherwise(c),
    "all_advantages_to_one": lambda c: _changed(c, "advantage", lambda n, i: F.lit(1.0)),
    "zero_advantages_to_epsilon": lambda c: _changed(c, "advantage", lambda n, i: F.when(n["advantage"] == 0, 0.05).otherwise(n["advantage"])),
    "negative_advantages_to_zero": lambda c: _changed(c, "advantage", lambda n, i: F.greatest(n["advantage"], F.lit(0.0))),
    "non_last_nodes_score_to_zero": lambda c: _changed(c, "score", lambda n, i: F.when(i < F.size(c) - 1, 0.0).otherwise(n["score"])),
    "non_last_nodes_advantage_to_zero": lambda c: _changed(c, "advantage", lambda n, i: F.when(i < F.size(c) - 1, 0.0).otherwise(n["advantage"])),
    "fill_advantage_from_score": lambda c: _changed(c, "advantage", lambda n, i: n["score"]),
    "last_step_advantage_to_one": lambda c: _changed(c, "advantage", lambda n, i: F.when(i == F.size(c) - 1, 1.0).otherwise(n["advantage"])),
    "apply_importance_weights": lambda c: _changed(c, "advantage", lambda n, i: n["advantage"] * n["weight"]),
}


def top_percent(rows: DataFrame, chain: str, share: float, by: str = "mean") -> DataFrame:
    """The share of a tree's paths (one at least) with the highest mean or summed advantage."""
    total = F.aggregate(chain, F.lit(0.0), lambda s, n: s + F.coalesce(n["advantage"], F.lit(0.0)))
    score = total if by == "sum" else total / F.size(chain)
    w = W.partitionBy("tree_id")
    out = rows.withColumn("_rank", F.row_number().over(w.orderBy(F.desc(score), "leaf_id"))).withColumn("_n", F.count("*").over(w))
    return out.where(F.col("_rank") <= F.greatest(F.floor(F.col("_n") * share), F.lit(1))).drop("_rank", "_n")


def episodes_from_paths(rows: DataFrame, filters: list[str] = (), post: list[str] = (), top: float | None = None) -> DataFrame:
    """Filter, then transform, then aggregate, then drop paths of the query alone."""
    for f in filters:
        rows = rows.where(FILTERS[f](F.col("chain")))
    for p in post:
        rows = rows.withColumn("chain", POST_PROCESSORS[p](F.col("chain")))
    if top is not None:
        rows = top_percent(rows, "chain", top)
    return rows.where(F.size("chain") > 1)


def random_paths(leaves: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """At most k leaves(tree_id, leaf_id) of each tree, by hash; ranks are cut before the shuffle."""
    rank = F.row_number().over(W.partitionBy("tree_id").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("leaf_id").cast("string"))), "leaf_id"))
    return leaves.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def preorder(nodes: DataFrame, deepest: int | None = None, separator: str = "/") -> DataFrame:
    """nodes with path, the ids from the root on: ordered by tree_id and path they come parents first, depth first."""
    nodes, deepest, stored = _levels(nodes, deepest)
    level = nodes.where("parent_id is null").withColumn("path", F.col("node_id").cast("string"))
    out = level
    for depth in range(1, deepest + 1):
        above = level.select("tree_id", F.col("node_id").alias("parent_id"), F.col("path").alias("_above"))
        level = nodes.where(F.col("depth") == depth).join(above, ["tree_id", "parent_id"])
        level = stored(level.select(*[F.col(c) for c in nodes.columns], F.concat_ws(separator, "_above", F.col("node_id").cast("string")).alias("path")))
        out = out.unionByName(level)
    return out


def spine(rows: DataFrame, key: str, steps: str, separator: str = "") -> DataFrame:
    """(key, depth, text, full_text): the steps of a solution as a chain of nodes, each with the text up to it."""
    at = F.posexplode(steps).alias("depth", "text")
    full = F.array_join(F.slice(F.col(steps), F.lit(1), F.col("depth") + 1), separator)
    return rows.select(key, steps, at).select(key, "depth", "text", full.alias("full_text"))

"""Seeded samples, shards and plans. Orders come from md5(seed:key), so they do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranks import indexed


def order_key(key: str | Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string") if isinstance(key, str) else key))


def sample(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows: a top-k by hash, no full sort."""
    return rows.orderBy(order_key(key, seed), key).limit(k)


def ranked(rows: DataFrame, keys: list[str], order: Column, tie: str, name: str = "_r") -> DataFrame:
    """rows with their rank from 1 in each group by order, a hash in hexadecimal, then tie.

    A group is ranked in 256 ranges of the hash, each in a task of its own; a range begins after the rows of those before
    it, which a small table of counts tells.
    """
    rows = rows.withColumn("_o", order).withColumn("_b", F.substring("_o", 1, 2))
    counts = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(*keys, "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, "_b").orderBy("_o", tie))
    placed = rows.withColumn("_i", inside).alias("x").join(counts.alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*keys, "_b")])
    return placed.select("x.*", (F.col("_i") + F.col("_before")).alias(name)).drop("_o", "_b", "_i")


def portion(rows: DataFrame, key: str, keys: list[str], share: float, seed: int = 42) -> DataFrame:
    """floor(n * share) rows of each group, by hash."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    out = ranked(rows, keys, order_key(key, seed), key).alias("x").join(n.alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in keys])
    return out.where(F.col("_r") <= F.floor(F.col("_n") * share)).select("x.*").drop("_r")


def numbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with _i, their number from 0 in their group by order, and _n, the size of the group; no task needs a whole group."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    out = indexed(rows, keys, [order], "_i").alias("x").join(n.alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in keys])
    return out.select("x.*", "_n")


def shards(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Contiguous shards of each group, the first ones a row larger."""
    i, size, more = F.col("_i"), F.floor(F.col("_n") / n), F.col("_n") % n
    head = more * (size + 1)
    shard = F.when(i < head, F.floor(i / (size + 1))).otherwise(more + F.floor(F.try_divide(i - head, size)))
    return numbered(rows, keys, order).withColumn("shard", shard.cast("int")).drop("_i", "_n")


def epoch_plan(rows: DataFrame, keys: list[str], key: str, epochs: int, first: int, last: int, seed: int = 42) -> DataFrame:
    """Rows first (inclusive) to last of each group's concatenation of reshuffled epochs."""
    copies = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    order = order_key(F.concat_ws(":", F.col("epoch").cast("string"), F.col(key).cast("string")), seed)
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    out = ranked(copies, [*keys, "epoch"], order, key).alias("x").join(n.alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in keys])
    out = out.select("x.*", (F.col("_r") - 1 + F.col("epoch") * F.col("_n")).cast("int").alias("slot")).drop("_r")
    return out.where((F.col("slot") >= first) & (F.col("slot") < last))


def thinned(rows: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """k rows of each group at the places int(i * n / k)."""
    out = numbered(rows, keys, order)
    nearest = F.ceil(F.col("_i") * k / F.col("_n"))
    return out.where((F.floor(nearest * F.col("_n") / k) == F.col("_i")) & (nearest < k)).drop("_i", "_n")


def budget_prefix(costs: Column, budget: Column) -> Column:
    """Indices of the items that still fit, in order; one that does not is skipped."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<int>)").alias("kept"))
    items = F.transform(costs, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(
        items, start,
        lambda s, x: F.when(s["used"] + x["c"] <= budget, F.struct((s["used"] + x["c"]).alias("used"), F.concat(s["kept"], F.array(x["i"])).alias("kept"))).otherwise(s),
        lambda s: s["kept"],
    )


def row_index(rows: DataFrame, keys: list[str], order: str, name: str = "idx") -> DataFrame:
    """rows with their number from 0 in each group."""
    return indexed(rows, keys, [order], name)

"""Ranks and inversions of keys of any size, none of which one task must hold or sort alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.writers import scratch

#: Rows or different values of a key that one window takes.
BLOCK = 1 << 16


def indexed(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their number from 0 in each group of keys, by order; rows that are equal in it follow each other somehow.

    Rows are sorted by range partitions and written once; a row's place is that in its partition, plus the counts of the
    partitions before it, one row each, less the first place of its group. A group takes as many tasks as it needs.
    """
    path = scratch(rows.sparkSession, "ranks")
    ordered = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ordered.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_id", 33))
    counts = placed.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = placed.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").withColumn("_at", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    first = placed.groupBy(*keys).agg(F.min("_at").alias("_first"))
    both = placed.alias("x").join(first.alias("y"), [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys])
    return both.select(*[F.col(f"x.{c}") for c in rows.columns], (F.col("_at") - F.col("_first")).alias(name))


def dense_ranks(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, value, name): each different value of a key with its rank from 0, ascending."""
    return indexed(rows.select(*keys, value).distinct(), keys, [value], name)


def _with_ranks(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """rows with the dense ranks _a and _b: by windows for keys of up to BLOCK rows, by range partitions for larger ones."""
    large = rows.groupBy(*keys).count().where(F.col("count") > BLOCK).select(*keys)
    rank = lambda c: (F.dense_rank().over(W.partitionBy(*keys).orderBy(c)) - 1).cast("long")
    ranked = lambda df: df.select(*keys, rank(a).alias("_a"), rank(b).alias("_b"))
    if large.isEmpty():
        return ranked(rows)
    hot = rows.join(large, keys, "left_semi")
    hot = hot.join(dense_ranks(hot, keys, a, "_a"), [*keys, a]).join(dense_ranks(hot, keys, b, "_b"), [*keys, b])
    return ranked(rows.join(large, keys, "left_anti")).unionByName(hot.select(*keys, "_a", "_b"))


#: Rows of a key whose pairs are counted in one array.
SMALL = 128


def _alike(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, concordant) for keys of at most SMALL rows, pair by pair in an array."""
    listed = rows.groupBy(*keys).agg(F.collect_list(F.struct(F.col(a).alias("a"), F.col(b).alias("b"))).alias("_x"))
    above = lambda v: F.size(F.filter("_x", lambda w: (w["a"] > v["a"]) & (w["b"] > v["b"])))
    pairs = F.aggregate("_x", F.lit(0), lambda s, v: s + above(v))
    return listed.select(*keys, F.size("_x").cast("long").alias("n"), pairs.cast("long").alias("concordant"))


def concordant(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, concordant): of each key, its rows with both values, and the pairs of them that a and b order alike; equal values order nothing.

    Keys of up to SMALL rows are compared pair by pair in an array, larger ones by the bits of their ranks.
    """
    whole = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b)
    many = whole.groupBy(*keys).count().where(F.col("count") > SMALL).select(*keys)
    same = lambda x, y: [F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in keys]
    few, rest = (whole.alias("x").join(many.alias("y"), same("x", "y"), how) for how in ("left_anti", "left_semi"))
    # a join, as the union of two tables by keys counts as dealt by them, while adaptive execution deals each its own way
    both = _alike(few, keys, a, b).alias("x").join(_by_bits(rest, keys, a, b).alias("y"), same("x", "y"), "full")
    return both.select(*[F.coalesce(F.col(f"x.{c}"), F.col(f"y.{c}")).alias(c) for c in [*keys, "n", "concordant"]])


def _by_bits(whole: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, concordant) for keys of any size.

    Two different ranks of a differ first at one bit: with the bits above it they name a group, and the row without the
    bit is the lower one. So the pairs of a key are, bit by bit, pairs of a lower and an upper row of one group, and a
    running count of lower rows by the rank of b counts them: n log n rows instead of n squared. Rows are added up by
    group and rank of b first; groups are windows of at most BLOCK ranks, joined by the counts of the blocks before.
    """
    counts = _with_ranks(whole.select(*keys, a, b), keys, a, b).groupBy(*keys, "_a", "_b").agg(F.count("*").alias("_n"))
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("n"), F.length(F.bin(F.max("_a"))).alias("_bits"))
    bits = counts.join(sizes.select(*keys, "_bits"), keys).withColumn("_bit", F.explode(F.sequence(F.lit(0), F.col("_bits") - 1)))
    upper = F.call_function("shiftright", F.col("_a"), F.col("_bit")).bitwiseAND(F.lit(1)) == 1
    group = [*keys, "_bit", "_group"]
    sided = bits.select(*keys, "_bit", F.call_function("shiftright", F.col("_a"), F.col("_bit") + 1).alias("_group"), "_b", F.when(upper, 0).otherwise(F.col("_n")).alias("_low"), F.when(upper, F.col("_n")).otherwise(0).alias("_up"))
    by_rank = sided.groupBy(*group, "_b").agg(F.sum("_low").alias("_low"), F.sum("_up").alias("_up")).withColumn("_block", F.floor(F.col("_b") / BLOCK))
    earlier = lambda *of: F.coalesce(F.sum("_low").over(W.partitionBy(*of[:-1]).orderBy(of[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = by_rank.groupBy(*group, "_block").agg(F.sum("_low").alias("_low"), F.sum("_up").alias("_up"))
    across = blocks.withColumn("_pairs", F.col("_up") * earlier(*group, "_block")).groupBy(*keys).agg(F.sum("_pairs").alias("_across"))
    inside = by_rank.withColumn("_pairs", F.col("_up") * earlier(*group, "_block", "_b")).groupBy(*keys).agg(F.sum("_pairs").alias("_inside"))
    pairs = across.join(inside, keys).select(*keys, (F.col("_across") + F.col("_inside")).cast("long").alias("concordant"))
    return sizes.select(*keys, "n").join(pairs, keys)

"""Joins of rollout pipelines: resumption, request fan-out, pairs, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import let


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the finished ones; Spark picks the strategy by size."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def distinct_requests(requests: DataFrame, query: str, order: str) -> DataFrame:
    """The first request of each query: what an expensive step has to compute."""
    return requests.groupBy(query).agg(F.min(order).alias(order), F.count("*").alias("n_requests"))


def fan_out(requests: DataFrame, results: DataFrame, query: str) -> DataFrame:
    return requests.join(results, query)


def accept_reject_pairs(rows: DataFrame, key: str, item: str, reward: str, threshold: float, most: int | None = None, seed: int = 42) -> DataFrame:
    """Every accepted with every rejected item of a key; most: so many pairs a key, by hash, out of the most first
    accepted and rejected items by hash, so that no key gives more than most squared pairs on the way."""
    good = rows.where(F.col(reward) >= threshold).select(key, F.col(item).alias("accepted"))
    bad = rows.where(F.col(reward) < threshold).select(key, F.col(item).alias("rejected"))
    if most is None:
        return good.join(bad, key)
    hashed = lambda *c: F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(x).cast("string") for x in c]))
    first = lambda df, c: df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(hashed(c), c))).where(F.col("_r") <= most).drop("_r")
    pairs, order = first(good, "accepted").join(first(bad, "rejected"), key), hashed("accepted", "rejected")
    return pairs.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("_r") <= most).drop("_r")


def pairs_within(rows: DataFrame, key: str, item: str) -> DataFrame:
    a, b = rows.alias("a"), rows.alias("b")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{item}") < F.col(f"b.{item}")))


def splice_candidates(left: DataFrame, right: DataFrame, key: str, longest: int) -> DataFrame:
    """Prefixes (key, j, prefix_length) with suffixes (key, i, suffix_length) that fit together."""
    return left.join(right, key).where(F.col("prefix_length") + F.col("suffix_length") <= longest)


def best_fitting(left: DataFrame, right: DataFrame, key: str, longest: int, score: str, blocks: int = 256) -> DataFrame:
    """(key, j, i, score): for each prefix (key, j, prefix_length) the suffix (key, i, suffix_length, score) of best score that fits with it.

    Ties go to the smaller i; prefixes that nothing fits are left out. Suffixes by length and prefixes by the room they
    leave lie on one line from 0 to longest, so the best up to a place is a running maximum: in windows of one of blocks
    stretches of a key's line, with the best of the stretches before. No pair but the one wanted is made.
    """
    none = F.lit(None)
    best = F.struct(F.col(score).cast("double").alias("score"), (-F.col("i").cast("long")).alias("less"))
    kind = "struct<score: double, less: bigint>"
    suffixes = right.select(F.col(key), none.cast("long").alias("j"), F.col("suffix_length").cast("double").alias("_at"), F.lit(0).alias("_order"), best.cast(kind).alias("_best"))
    prefixes = left.select(F.col(key), F.col("j").cast("long").alias("j"), (F.lit(longest) - F.col("prefix_length")).cast("double").alias("_at"), F.lit(1).alias("_order"), none.cast(kind).alias("_best"))
    line = suffixes.unionByName(prefixes).where(F.col("_at").between(0, longest)).withColumn("_block", F.floor(F.col("_at") * blocks / (longest + 1)))
    inside = F.max("_best").over(W.partitionBy(key, "_block").orderBy("_at", "_order").rowsBetween(W.unboundedPreceding, 0))
    tops = line.where("_order = 0").groupBy(key, "_block").agg(F.max("_best").alias("_top"))
    # at most blocks rows a key: the best of all blocks before each that holds a prefix
    wanted = line.where("_order = 1").select(key, "_block").distinct().join(tops, [key, "_block"], "full")
    earlier = F.max("_top").over(W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    before = wanted.select(key, "_block", earlier.alias("_before"))
    found = line.withColumn("_inside", inside).where("_order = 1").join(before, [key, "_block"])
    top = F.greatest("_inside", "_before")
    return found.select(key, "j", (-top["less"]).alias("i"), top["score"].alias("score")).where("i is not null")


def first_containing(texts: DataFrame, text: str, items: DataFrame, item_id: str, item: str, max_items: int = 50_000) -> DataFrame:
    """(text id columns, item_id) of the first item contained in each text.

    An item of five words or more has three words inside that a text which contains it must have between single spaces:
    texts and items meet by the hash of these three, and only pairs that meet are compared. Shorter items are
    distinct and counted; up to max_items they are broadcast, beyond that they are taken in blocks.
    """
    items = items.select(F.col(item_id).alias(item_id), F.col(item).alias(item))
    words = F.split(F.col(item), " ", -1)
    long_ = items.where(F.size(words) >= 5).select(F.col(item_id).alias("_id"), F.col(item).alias("_item"), F.xxhash64(F.get(words, F.lit(1)), F.get(words, F.lit(2)), F.get(words, F.lit(3))).alias("_gram"))
    keys = [c for c in texts.columns if c != text]
    grams = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    inside = let(F.split(F.coalesce(F.col(text), F.lit("")), " ", -1), lambda w: F.when(F.size(w) >= 3, F.array_distinct(grams(w))))
    met = texts.select(*keys, F.explode(inside).alias("_gram")).join(long_, "_gram").select(*keys, "_id", "_item").distinct()
    found = texts.join(met, keys).where(F.col(text).contains(F.col("_item"))).groupBy(*keys).agg(F.min("_id").alias(item_id))
    short = items.where(F.size(words) < 5)
    both = found.unionByName(_first_containing_short(texts, text, short, item_id, item, max_items))
    return both.groupBy(*keys).agg(F.min(item_id).alias(item_id))


def _first_containing_short(texts: DataFrame, text: str, items: DataFrame, item_id: str, item: str, max_items: int) -> DataFrame:
    items = items.select(F.col(item_id).alias("_id"), F.col(item).alias("_item")).where("_item is not null and _item <> ''").groupBy("_item").agg(F.min("_id").alias("_id"))
    blocks = max(1, -(-items.count() // max_items))
    keys = [c for c in texts.columns if c != text]
    found = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == k) if blocks > 1 else items
        hit = texts.join(F.broadcast(block), F.col(text).contains(F.col("_item"))).groupBy(*keys).agg(F.min("_id").alias(item_id))
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy(*keys).agg(F.min(item_id).alias(item_id)) if blocks > 1 else found


def changed(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs, with both values; a missing side is null."""
    o, n = old.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    return o.join(n, key, "full").where(~F.col("old").eqNullSafe(F.col("new")))


def checkpoints_with_episodes(checkpoints: DataFrame, episodes: DataFrame, most: int | None = None) -> DataFrame:
    """checkpoints(path) with the episodes(path) of their iteration, the number at the end of both; at most so many, spread
    evenly over the iterations."""
    number = lambda df, name: df.select(F.col("path").alias(name), F.regexp_extract("path", r"(\d+)\D*$", 1).cast("long").alias("iteration"))
    both = number(checkpoints, "checkpoint").join(number(episodes, "episodes"), "iteration")
    if most is None:
        return both
    n = both.count()
    if n <= most:
        return both
    keep = both.select("iteration", (F.row_number().over(W.orderBy("iteration")) - 1).alias("_i"))
    keep = keep.where(F.col("_i").isin([int(i * (n / most)) for i in range(most)])).select("iteration")
    return both.join(keep, "iteration", "left_semi")

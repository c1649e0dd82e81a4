"""Training episodes: truncation, selection, cut points and collation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def truncated(tokens: Column, longest: int) -> Column:
    return F.slice(tokens, 1, longest)


def fits(query: Column, response: Column, longest: int) -> Column:
    return F.size(query) + F.size(response) <= longest


def best_responses(rows: DataFrame, key: str, order: str, reward: str, threshold: float, n: int) -> DataFrame:
    """The first n responses of each question whose reward reaches the threshold."""
    good = rows.where(F.col(reward) >= threshold)
    return good.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def token_rewards(tokens: DataFrame, beta: float) -> DataFrame:
    """tokens(response_id, pos, kl, score): -beta * kl each, and the score at the last token."""
    last = F.max("pos").over(W.partitionBy("response_id"))
    return tokens.withColumn("reward", -beta * F.col("kl") + F.when(F.col("pos") == last, F.col("score")).otherwise(0.0))


def cut_points(tokens: DataFrame, sure: float = 0.9, every: int = 1) -> DataFrame:
    """(response_id, pos) where the token was not sure, every n-th, and -1 for the start."""
    unsure = tokens.where(F.col("prob") < sure).withColumn("_r", F.row_number().over(W.partitionBy("response_id").orderBy("pos")) - 1)
    points = unsure.where(F.col("_r") % every == 0).select("response_id", F.col("pos").cast("long").alias("pos"))
    return points.unionByName(tokens.select("response_id").distinct().withColumn("pos", F.lit(-1).cast("long")))


def chunk_ends(tokens: DataFrame, chunks: int = 4) -> DataFrame:
    """The last position of each of nearly equal chunks but the final one."""
    tile = F.ntile(chunks).over(W.partitionBy("response_id").orderBy("pos"))
    return tokens.withColumn("tile", tile).where(F.col("tile") < chunks).groupBy("response_id", "tile").agg(F.max("pos").alias("pos"))


def run_ends(tokens: DataFrame, step: str) -> DataFrame:
    """The last token of each run of equal steps."""
    nxt = F.lead(step).over(W.partitionBy("response_id").orderBy("pos"))
    return tokens.withColumn("_next", nxt).where(F.col("_next").isNull() | (F.col("_next") != F.col(step))).drop("_next")


def monte_carlo_values(rollouts: DataFrame, key: list[str], reward: str) -> DataFrame:
    return rollouts.groupBy(*key).agg(F.coalesce(F.avg(reward), F.lit(0.0)).alias("value"), F.coalesce(F.stddev_pop(reward), F.lit(-1.0)).alias("value_std"), F.count(reward).alias("n"))


def padded(tokens: Column, length: int, pad: int) -> Column:
    return F.concat(F.slice(tokens, 1, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(tokens), F.lit(0))))

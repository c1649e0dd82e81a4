"""Metric forms of training objectives over token and pair tables, and shapes for trainers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def policy_metrics(tokens: DataFrame, clip: float = 0.2, too_far: float = 10.0) -> DataFrame:
    """tokens(logprob, old_logprob, advantage, mask): one row of ratio, clipped loss, clip share and KL estimate.

    skip: the mean ratio is beyond too_far, so a trainer would leave the batch out.
    """
    ratio = F.exp(F.col("logprob") - F.col("old_logprob"))
    kept = F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip))
    plain, clipped = -F.col("advantage") * ratio, -F.col("advantage") * kept
    on = lambda x: F.when(F.col("mask"), x)
    out = tokens.agg(
        F.avg(on(ratio)).alias("mean_ratio"), F.avg(on(F.greatest(plain, clipped))).alias("policy_loss"),
        F.avg(on((clipped > plain).cast("double"))).alias("clip_share"), F.avg(on(0.5 * F.pow(F.col("logprob") - F.col("old_logprob"), F.lit(2.0)))).alias("approx_kl"),
    )
    return out.withColumn("skip", F.col("mean_ratio") > too_far)


def value_loss(value: Column, old_value: Column, target: Column, clip: float = 0.2) -> Column:
    near = F.least(F.greatest(value, old_value - clip), old_value + clip)
    return 0.5 * F.greatest(F.pow(value - target, F.lit(2.0)), F.pow(near - target, F.lit(2.0)))


def log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def preference_metrics(pairs: DataFrame, beta: float = 0.1, penalty: float = 5.0) -> DataFrame:
    """pairs(accept, accept_ref, reject, reject_ref) of summed log probabilities: loss with a penalty where the
    accepted answer falls below its reference, and how often the accepted one wins."""
    a, r = F.col("accept") - F.col("accept_ref"), F.col("reject") - F.col("reject_ref")
    loss = -log_sigmoid(beta * (a - r - penalty * F.greatest(-a, F.lit(0.0))))
    return pairs.agg(F.avg(loss).alias("loss"), F.avg((a > r).cast("double")).alias("accuracy"), F.avg(beta * a).alias("accept_reward"), F.avg(beta * r).alias("reject_reward"))


def normalised_scores(rows: DataFrame, score: str, clip: float) -> DataFrame:
    """score over the deviation of all, clipped."""
    s = rows.agg(F.stddev_samp(score).alias("_s"))
    z = F.col(score) / F.greatest(F.coalesce("_s", F.lit(1.0)), F.lit(1e-8))
    return rows.crossJoin(F.broadcast(s)).withColumn("normalised", F.least(F.greatest(z, F.lit(-clip)), F.lit(clip))).drop("_s")


def generation_metrics(rows: DataFrame) -> DataFrame:
    """rows(question_id, response, reward, finished): shares of unfinished and empty responses, of questions hit once,
    and the mean number of different responses a question."""
    per = rows.groupBy("question_id").agg(
        F.count("*").alias("n"), F.count_if(~F.col("finished")).alias("u"), F.count_if(F.length("response") == 0).alias("e"), F.bool_or(F.col("reward") == 1.0).alias("hit"), F.count_distinct("response").alias("d")
    )
    return per.agg((F.sum("u") / F.sum("n")).alias("unfinished"), (F.sum("e") / F.sum("n")).alias("empty"), F.avg(F.col("hit").cast("double")).alias("once_hit"), F.avg("d").alias("unique_responses"))


def reconstruction(a: Column, b: Column) -> Column:
    """Mean squared error, largest difference and cosine of two vectors."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p))
    dot, xx, yy = total(lambda p: p["x"] * p["y"]), total(lambda p: p["x"] * p["x"]), total(lambda p: p["y"] * p["y"])
    return F.struct(
        (total(lambda p: (p["x"] - p["y"]) * (p["x"] - p["y"])) / F.size(a)).alias("mse"),
        F.array_max(F.transform(pairs, lambda p: F.abs(p["x"] - p["y"]))).alias("largest"),
        (dot / F.greatest(F.sqrt(xx) * F.sqrt(yy), F.lit(1e-10))).alias("cosine"),
    )


def branch_factor(steps: list[tuple[int, int]], depth: Column) -> Column:
    """The factor of the deepest step at or above a depth."""
    out = F.lit(None).cast("int")
    for at, factor in sorted(steps):
        out = F.when(depth >= at, F.lit(factor)).otherwise(out)
    return out


def filled(rows: DataFrame, keys: list[str], key: str, target: int, seed: int = 42) -> DataFrame:
    """Exactly target rows a group: whole copies, the last one cut by hash; larger groups are sampled."""
    w = W.partitionBy(*keys)
    n = rows.withColumn("_n", F.count("*").over(w))
    copies = n.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.ceil(F.lit(target) / F.col("_n")) - 1).cast("int"))))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("copy").cast("string"), F.col(key).cast("string")))
    return copies.withColumn("_r", F.row_number().over(w.orderBy("copy", order))).where(F.col("_r") <= target).drop("_r", "_n")


def min_max(x: Column, keys: list[str]) -> Column:
    w = W.partitionBy(*keys)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high > low, (x - low) / (high - low)).otherwise(0.0)


def ancestors(nodes: DataFrame, deepest: int) -> DataFrame:
    """(tree_id, node_id, ancestor_id, distance) of every node and itself."""
    parent = nodes.where("parent_id is not null").select("tree_id", F.col("node_id").alias("c"), "parent_id")
    at = nodes.select("tree_id", "node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("distance"))
    out = at
    for d in range(1, deepest + 1):
        at = at.join(parent.withColumnRenamed("tree_id", "t"), (F.col("tree_id") == F.col("t")) & (F.col("ancestor_id") == F.col("c")))
        at = at.select("tree_id", "node_id", F.col("parent_id").alias("ancestor_id"), F.lit(d).alias("distance"))
        out = out.unionByName(at)
    return out

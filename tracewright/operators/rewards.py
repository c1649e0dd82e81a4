"""Rewards of phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def discounted_entropy(phased: DataFrame, psi: float = 0.95, signal: str = "entropy") -> DataFrame:
    """Entropy of each phase, discounted by psi a token from its start.

    Added in order of pos: equal phases have equal sums to the last bit, whatever the partitions. entropy_credit divides
    differences of these sums by as little as 1e-8, so a last bit would show in its fourth decimal.
    """
    first = F.min("pos").over(W.partitionBy("response_id", "phase_id"))
    one = phased.where("phase_id >= 0").withColumn("offset", F.col("pos") - first)
    term = F.col(signal) * F.pow(F.lit(psi), F.col("offset"))
    terms = F.sort_array(F.collect_list(F.when(term.isNotNull(), F.struct("pos", term.alias("x")))))
    total = F.when(F.size("_x") > 0, F.aggregate("_x", F.lit(0.0), lambda s, t: s + t["x"]))
    return one.groupBy("group_id", "response_id", "phase_id").agg(terms.alias("_x")).select("group_id", "response_id", "phase_id", total.alias("phase_entropy"))


def entropy_credit(phases: DataFrame, correct: float = 1.0, partial: float = 0.1, wrong: float = -1.0, percentile: float = 90.0) -> DataFrame:
    """phases(group_id, response_id, phase_id, phase_entropy, outcome) with phase_reward, which sums to the
    response's total. Low entropy against the group's threshold earns credit; the threshold is the largest
    entropy of a correct response, or a percentile if the group has none."""
    group, response = W.partitionBy("group_id"), W.partitionBy("response_id")
    right = F.max(F.when(F.col("outcome") >= 1.0, F.col("phase_entropy"))).over(group)
    limit = F.coalesce(right, F.percentile("phase_entropy", F.lit(percentile / 100)).over(group))
    out = phases.withColumns({"limit": limit, "highest": F.max("phase_entropy").over(group), "n": F.count("*").over(response)})
    raw = F.least(F.lit(1.0), (F.col("limit") - F.col("phase_entropy")) / (F.col("highest") - F.col("limit") + 1e-8))
    total = F.when(F.col("outcome") >= 1.0, correct).when(F.col("outcome") > 0.0, partial).otherwise(wrong)
    out = out.withColumns({"raw": raw, "total": total})
    reward = F.when(F.col("n") <= 1, F.col("total")).otherwise(F.col("raw") + F.col("total") / F.col("n") - F.avg("raw").over(response))
    return out.withColumn("phase_reward", reward).drop("limit", "highest", "n", "raw", "total")


def judge_scaled(phases: DataFrame, wrong: float = 0.3, good_without_gold: float = 0.5, bad_without_gold: float = 0.1, floor: float = 0.5) -> DataFrame:
    """phases(group_id, response_id, phase_id, phase_reward, outcome, has_gold, overlong) rescaled by outcome.

    A response without gold answer counts as good if its mean reward is at least its group's mean of means.
    """
    own = F.avg("phase_reward").over(W.partitionBy("response_id"))
    out = phases.withColumn("judged", own).withColumn("share", 1 / F.count("*").over(W.partitionBy("response_id")))
    group = W.partitionBy("group_id")
    mean = F.sum(F.col("judged") * F.col("share")).over(group) / F.sum("share").over(group)
    out = out.withColumn("group_mean", mean)
    good = F.col("judged") >= F.col("group_mean") - 1e-12
    scale = F.when(F.col("has_gold"), F.when(F.col("outcome") < 1.0, wrong).otherwise(1.0)).otherwise(F.when(good, good_without_gold).otherwise(bad_without_gold))
    scaled = F.col("phase_reward") * scale
    floored = F.when(F.col("has_gold") & (F.col("outcome") >= 1.0), F.greatest(scaled, F.lit(floor))).otherwise(scaled)
    return out.withColumn("phase_reward", floored + F.col("overlong")).drop("judged", "share", "group_mean")


def uniform(total: Column, n_phases: Column) -> Column:
    return total / n_phases


def by_rule(score: Column, phase_id: Column, n_phases: Column) -> Column:
    """One half for each phase, the score for the last."""
    return F.when(phase_id == n_phases - 1, score).otherwise(0.5)


def stitched(reward: Column, phase_id: Column, splice: Column, decay: float = 0.9, before: Column | None = None) -> Column:
    """Phases before the splice keep theirs, at the splice the full reward, after it decaying."""
    return F.when(phase_id < splice, F.lit(0.0) if before is None else before).otherwise(reward * F.pow(F.lit(decay), phase_id - splice))


def influence(attention: DataFrame, norm: str = "none") -> DataFrame:
    """attention(response_id, q_phase, k_phase, w): the shifted lower-triangular influence (i, j, a), normalised."""
    out = attention.where("q_phase >= 1 and k_phase <= q_phase - 1").select("response_id", (F.col("q_phase") - 1).alias("i"), F.col("k_phase").alias("j"), F.col("w").alias("a"))
    keys = {"row": ["response_id", "i"], "col": ["response_id", "j"], "matrix": ["response_id"]}
    if norm == "none":
        return out
    total = F.sum("a").over(W.partitionBy(*keys[norm]))
    return out.withColumn("a", F.when(total > 1e-12, F.col("a") / total).otherwise(F.col("a")))


def phase_attention(weights: DataFrame, phases: DataFrame) -> DataFrame:
    """weights(response_id, head, q, k, w) averaged over heads and blocks of phases; every pair of phases has a row."""
    p = phases.select("response_id", "phase_id", "phase_start", "phase_end")

    def placed(rows: DataFrame, position: str, name: str) -> DataFrame:
        span = p.select(F.col("response_id").alias("r"), F.col("phase_id").alias(name), "phase_start", "phase_end")
        on = (F.col("response_id") == F.col("r")) & (F.col(position) >= F.col("phase_start")) & (F.col(position) < F.col("phase_end"))
        return rows.join(span, on).drop("r", "phase_start", "phase_end")

    cells = placed(placed(weights.select("response_id", "q", "k", "w"), "q", "q_phase"), "k", "k_phase")
    found = cells.groupBy("response_id", "q_phase", "k_phase").agg(F.avg("w").alias("w"))
    grid = p.select("response_id", F.col("phase_id").alias("q_phase")).join(p.select("response_id", F.col("phase_id").alias("k_phase")), "response_id")
    return grid.join(found, ["response_id", "q_phase", "k_phase"], "left").na.fill(0.0, ["w"])

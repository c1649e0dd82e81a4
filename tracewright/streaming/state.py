"""State across iterations: replay buffers, question samplers, running moments, resampling.

An iteration reads a table and writes the next one, so a run resumes from the last written state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _hashed(*columns: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def replay(buffer: DataFrame, fresh: DataFrame, iteration: int, max_age: int = 8, per_question: int = 32, seed: int = 0) -> DataFrame:
    """buffer and fresh edges(question_id, edge_id, iteration): those younger than max_age, at most per_question each."""
    both = buffer.unionByName(fresh).where(iteration - F.col("iteration") < max_age)
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(_hashed("edge_id", seed=seed), "edge_id"))
    return both.withColumn("_r", rank).where(F.col("_r") <= per_question).drop("_r")


def without_used(buffer: DataFrame, used: DataFrame) -> DataFrame:
    return buffer.join(used.select("question_id", "edge_id"), ["question_id", "edge_id"], "left_anti")


def sticky_step(questions: DataFrame, results: DataFrame, threshold: float, give_up_after: int) -> DataFrame:
    """questions(question_id, status, rollouts, correct) after a round of results(question_id, reward).

    A question is satisfied once its share of correct rollouts reaches the threshold, and given up
    after give_up_after rollouts without; both are final.
    """
    new = results.groupBy("question_id").agg(F.count("*").alias("n"), F.count_if(F.col("reward") >= 1.0).alias("c"))
    out = questions.join(new, "question_id", "left").withColumns({"rollouts": F.col("rollouts") + F.coalesce("n", F.lit(0)), "correct": F.col("correct") + F.coalesce("c", F.lit(0))}).drop("n", "c")
    met = (F.col("rollouts") > 0) & (F.col("correct") >= threshold * F.col("rollouts"))
    status = F.when(F.col("status") != "open", F.col("status")).when(met, "satisfied").when(F.col("rollouts") >= give_up_after, "given_up").otherwise("open")
    return out.withColumn("status", status)


def moments(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(n, mean, m2) of a column, by keys if there are any: states that merge."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0)).alias("m2"))


def merged_moments(states: DataFrame) -> DataFrame:
    """One state from several: deviations from the common mean are summed, so large means do not cancel."""
    common = states.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean")).scalar()
    off = F.col("mean") - F.col("_mean")
    return states.withColumn("_mean", common).agg(F.sum("n").alias("n"), F.max("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"))


def resampled_until_sure(rollouts: DataFrame, widest: float, least: int = 2) -> DataFrame:
    """rollouts(problem_id, idx, score) up to the first at which the 95 % interval is no wider than widest."""
    w = W.partitionBy("problem_id").orderBy("idx")
    n, p = F.row_number().over(w), F.avg("score").over(w)
    out = rollouts.withColumn("n", n).withColumn("width", 2 * 1.96 * F.sqrt(p * (1 - p) / n))
    sure = F.when((F.col("n") >= least) & (F.col("width") <= widest), F.col("n"))
    stop = F.min(sure).over(W.partitionBy("problem_id"))
    return out.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("n") <= F.col("stop"))).drop("stop")

"""Loops over iterations: each reads what the last one wrote, so a run goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import _hashed


class EarlyStop(Exception):
    """Raised by a step to end the loop; what was written stays."""


def written_iterations(spark: SparkSession, folder: str, most: int) -> int:
    """How many iterations, from 0 on, stand in the folder whole."""
    for k in range(most):
        try:
            spark.read.json(f"{folder.rstrip('/')}/done-{k}")
        except AnalysisException:
            return k
    return most


def iterate(spark: SparkSession, folder: str, start: DataFrame, step: Callable[[DataFrame, int], DataFrame | None], n: int, stop_at: int | None = None, again: bool = False) -> DataFrame:
    """The state after n iterations of step(state, iteration); iterations that are written are not run again.

    A step that returns None has no data: its iteration is skipped and the state carried on. stop_at ends early, and so
    does EarlyStop. An iteration counts once its mark is written, after its state: a lost run repeats only its last one.
    """
    folder = folder.rstrip("/")
    state = lambda k: spark.read.parquet(f"{folder}/state-{k}")
    first = 0 if again else written_iterations(spark, folder, n)
    now = state(first - 1) if first else start
    for k in range(first, n if stop_at is None else min(n, stop_at)):
        try:
            out = step(now, k)
        except EarlyStop:
            break
        (now if out is None else out).write.mode("overwrite").parquet(f"{folder}/state-{k}")
        spark.range(1).select(F.lit(k).alias("iteration"), F.lit(out is None).alias("skipped")).write.mode("overwrite").json(f"{folder}/done-{k}")
        now = state(k)
    return now


def pooled(buffer: DataFrame, n: int = 512, seed: int = 0) -> DataFrame:
    """A sample of at most n edges of a buffer that never forgets, by hash of the edge."""
    return buffer.orderBy(_hashed("edge_id", seed=seed), "edge_id").limit(n)


def with_leftovers(cache: DataFrame, fresh: DataFrame, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """n episodes(episode_id, ...) of the cache and the fresh ones in a seeded order, and the rest for the next call.

    The rank of the cut is found by a top-n; no row is sorted beyond it.
    """
    both = cache.unionByName(fresh)
    taken = both.select("episode_id").orderBy(_hashed("episode_id", seed=seed), "episode_id").limit(n)
    return both.join(taken, "episode_id", "left_semi"), both.join(taken, "episode_id", "left_anti")


def answered(cache: DataFrame, questions: DataFrame, attempts: DataFrame, verified: Column, most: int = 3) -> DataFrame:
    """The cache(question_id, text) with the first verified one of each question's attempts(question_id, attempt, text).

    Only questions with an answer that the cache lacks take part, with at most ``most`` attempts each; blank texts never
    count. verified is a column over attempts joined with questions(question_id, answer).
    """
    open_ = questions.where(F.length(F.trim("answer")) > 0).join(cache, "question_id", "left_anti")
    tried = attempts.where(F.col("attempt") < most).join(open_, "question_id").where(F.length(F.trim("text")) > 0).where(verified)
    first = tried.groupBy("question_id").agg(F.min_by("text", "attempt").alias("text"))
    return cache.select("question_id", "text").unionByName(first)

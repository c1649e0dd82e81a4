"""The sticky question sampler: a state machine over questions, in batches or as a stream.

A batch of n slots has a random share, drawn from all questions; the questions of the last
batch that are not done are carried on, slot by slot; the rest is drawn from those that are
neither satisfied nor given up. Draws are with replacement, so a question may fill several
slots. A question is satisfied while its last accuracy reaches the threshold, and given up
once its rollouts reach a limit without. Draws are keyed: slot j of iteration t takes the
question at rank md5(seed:part:t:j) modulo the size of the pool, in the order of
md5(seed:question), so a batch that runs again draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor

from .loops import EarlyStop

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Sticky:
    """literal: a satisfied question that passes again is no longer satisfied, as the original does; else it stays."""

    random_share: float = 0.25
    threshold: float = 0.8
    give_up_after: int = 1024
    early_stop: bool = True
    literal: bool = False
    seed: int = 0


def start(questions: DataFrame) -> DataFrame:
    """The state of questions(question_id) before the first batch."""
    return questions.select(
        "question_id", F.lit(0).cast("long").alias("rollouts"), F.lit(0.0).alias("correct"), F.lit(False).alias("satisfied"), F.lit(False).alias("given_up")
    )


def ranked(df: DataFrame, seed: int) -> DataFrame:
    """question_id with its dense rank from 0 by md5(seed:question_id): ranks inside 4,096 ranges of the digest, plus the counts of the ranges before."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("question_id").cast("string")))
    rows = df.select("question_id", key.alias("_key"), F.substring(key, 1, 3).alias("_range"))
    counts = rows.groupBy("_range").count()
    before = F.coalesce(F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("_range").orderBy("_key", "question_id")) - 1
    offsets = F.broadcast(counts.select("_range", before.alias("_before")))
    return rows.withColumn("_inside", inside).join(offsets, "_range").select("question_id", (F.col("_before") + F.col("_inside")).alias("rank"))


def drawn(pool: DataFrame, size: int, n: int, part: str, iteration: int, seed: int) -> DataFrame:
    """(part, since, slot, question_id): n draws with replacement from a pool of size questions."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(part), F.lit(str(iteration)), F.col("id").cast("string")))
    at = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % max(size, 1)
    slots = pool.sparkSession.range(max(n, 0)).select(F.lit(part).alias("part"), F.lit(iteration).alias("since"), F.col("id").alias("slot"), at.alias("rank"))
    return slots.join(ranked(pool, seed), "rank").select("part", "since", "slot", "question_id")


def select(state: DataFrame, before: DataFrame | None, n: int, iteration: int, rule: Sticky) -> DataFrame:
    """The slots (part, since, slot, question_id) of a batch; before are those of the last one. EarlyStop if nothing is left to train."""
    n_random = int(n * rule.random_share)
    everything = state.count()
    out = drawn(state, everything, n_random, "random", iteration, rule.seed)
    n_carried = 0
    if before is not None:
        unmet = state.where("not satisfied and not given_up").select("question_id")
        carried = before.where("part <> 'random'").join(unmet, "question_id").select(F.lit("carried").alias("part"), "since", "slot", "question_id")
        n_carried = carried.count()
        out = out.unionByName(carried)
    rest = n - n_random - n_carried
    if rest > 0:
        sizes = state.agg(F.count_if(F.expr("not satisfied and not given_up")).alias("open"), F.count_if(F.col("given_up")).alias("given_up")).first()
        if sizes["open"]:
            pool, size = state.where("not satisfied and not given_up"), sizes["open"]
        elif rule.early_stop:
            raise EarlyStop("every question is satisfied or given up")
        elif sizes["given_up"]:
            pool, size = state.where("given_up"), sizes["given_up"]
        else:
            pool, size = state, everything
        out = out.unionByName(drawn(pool, size, rest, "new", iteration, rule.seed))
    return out


def _verdicts(rule: Sticky, accuracy: Column, rollouts: Column, satisfied: Column, given_up: Column) -> tuple[Column, Column]:
    passed = accuracy >= rule.threshold
    newly = passed & ~satisfied if rule.literal else passed
    return newly, given_up | (~newly & (rollouts >= rule.give_up_after))


def update(state: DataFrame, results: DataFrame, rule: Sticky) -> DataFrame:
    """state after results(question_id, reward) of one batch."""
    new = results.groupBy("question_id").agg(F.count("reward").alias("_n"), F.sum(F.col("reward").cast("double")).alias("_total")).where("_n > 0")
    both = state.join(new, "question_id", "left")
    rollouts, correct = F.col("rollouts") + F.coalesce("_n", F.lit(0)), F.col("correct") + F.coalesce("_total", F.lit(0.0))
    satisfied, given_up = _verdicts(rule, F.col("_total") / F.col("_n"), rollouts, F.col("satisfied"), F.col("given_up"))
    kept = lambda now, name: F.when(F.col("_n").isNull(), F.col(name)).otherwise(now).alias(name)
    return both.select("question_id", rollouts.alias("rollouts"), correct.alias("correct"), kept(satisfied, "satisfied"), kept(given_up, "given_up"))


_STATE = "iteration long, n long, total double, rollouts long, correct double, satisfied boolean, given_up boolean"
_OUT = "question_id long, iteration long, rollouts long, correct double, satisfied boolean, given_up boolean"


class _Questions(StatefulProcessor):
    """A question's state before its last iteration, and the sums of that iteration: rows that arrive in parts give the same verdict as together."""

    def __init__(self, rule: Sticky):
        self.rule = rule

    def init(self, handle) -> None:
        self.state = handle.getValueState("question", _STATE)

    def _after(self, s: tuple) -> tuple:
        iteration, n, total, rollouts, correct, satisfied, given_up = s
        rollouts, correct = rollouts + n, correct + total
        if n:
            passed = total / n >= self.rule.threshold
            newly = passed and not satisfied if self.rule.literal else passed
            satisfied, given_up = newly, given_up or (not newly and rollouts >= self.rule.give_up_after)
        return rollouts, correct, satisfied, given_up

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = tuple(self.state.get()) if self.state.exists() else (-1, 0, 0.0, 0, 0.0, False, False)
        frames = pd.concat(list(rows)).dropna(subset=["reward"])
        sums = frames.groupby("iteration")["reward"].agg(["size", "sum"]).sort_index()
        for iteration, n, total in zip(sums.index.tolist(), sums["size"].tolist(), sums["sum"].tolist(), strict=True):
            if iteration > s[0]:
                s = (iteration, n, float(total), *self._after(s))
            elif iteration == s[0]:
                s = (iteration, s[1] + n, s[2] + float(total), *s[3:])
            else:
                # of an iteration that is over: counted, without a verdict
                s = (*s[:3], s[3] + n, s[4] + float(total), *s[5:])
        self.state.update(s)
        rollouts, correct, satisfied, given_up = self._after(s)
        yield pd.DataFrame({"question_id": [key[0]], "iteration": [s[0]], "rollouts": [rollouts], "correct": [correct], "satisfied": [satisfied], "given_up": [given_up]})

    def close(self) -> None:
        pass


def with_state_store(stream: DataFrame) -> DataFrame:
    """stream, its session set to the store that keyed state objects need."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream


def followed(results: DataFrame, rule: Sticky) -> DataFrame:
    """The states of a stream of results(question_id long, iteration, reward), in update mode: a row for each question that a micro-batch touched."""
    rows = results.select(F.col("question_id").cast("long"), F.col("iteration").cast("long"), F.col("reward").cast("double"))
    return with_state_store(rows).groupBy("question_id").transformWithStateInPandas(_Questions(rule), _OUT, "Update", "None")

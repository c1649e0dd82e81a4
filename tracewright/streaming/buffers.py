"""Replay buffers and the golden cache as streams.

The on-policy buffer keeps the unused edges of each shard of questions in list state: calls
of the state store and timers go by shard, not by question. Iterations are
logical time: iteration t, from 0 on, is the event time t + 1 seconds after the epoch, so the watermark
says when all edges of t are there, and a timer of a shard samples for all its questions then, also in
iterations that bring it nothing. What is emitted leaves the state in the same commit, so
a restart from the checkpoint repeats and loses nothing.

The off-policy pool keeps, in each of a fixed number of shards, the k edges of smallest
digest: the k smallest of all are among them.

The golden cache appends verified solutions once: a micro-batch writes its rows under its
own number and then enters the number in a ledger, and only what is in the ledger counts.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming import StatefulProcessor

from .sampler import with_state_store
from .state import _hashed

_EDGES = "question_id long, edge_id long, iteration long"
_COLUMNS = ["question_id", "edge_id", "iteration"]


def _digest(seed: int, edge_id: int) -> str:
    return hashlib.md5(f"{seed}:{edge_id}".encode()).hexdigest()


class _OnPolicy(StatefulProcessor):
    def __init__(self, max_age: int, per_question: int, seed: int):
        self.max_age, self.per_question, self.seed = max_age, per_question, seed

    def init(self, handle) -> None:
        self.handle = handle
        self.edges = handle.getListState("edges", _EDGES)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self.edges.appendList(list(batch[_COLUMNS].itertuples(index=False, name=None)))
            for i in set(batch["iteration"].tolist()):
                self.handle.registerTimer((int(i) + 1) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000 - 1
        held = [tuple(e) for e in self.edges.get()] if self.edges.exists() else []
        young = [e for e in held if now - e[2] < self.max_age]
        ready = pd.DataFrame([(*e, _digest(self.seed, e[1])) for e in young if e[2] <= now], columns=[*_COLUMNS, "digest"])
        used = ready.sort_values(["question_id", "digest", "edge_id"]).groupby("question_id").head(self.per_question)[_COLUMNS]
        gone = set(used.itertuples(index=False, name=None))
        rest = [e for e in young if e not in gone]
        if rest:
            self.edges.put(rest)
            self.handle.registerTimer((now + 2) * 1000)
        else:
            self.edges.clear()
        yield used.assign(at=now)[["at", *_COLUMNS]].astype("int64")

    def close(self) -> None:
        pass


def used_edges(edges: DataFrame, max_age: int = 8, per_question: int = 32, seed: int = 0, shards: int = 256) -> DataFrame:
    """(at, question_id, edge_id, iteration): what each iteration takes from the buffer, of a stream of edges(question_id, edge_id, iteration).

    Iterations arrive in order, each in one or more micro-batches; at follows once the watermark has passed it.
    """
    rows = edges.select(*[F.col(c).cast("long").alias(c) for c in _COLUMNS], F.pmod(F.xxhash64(F.col("question_id").cast("long")), F.lit(shards)).alias("shard"))
    rows = rows.withColumn("time", F.timestamp_seconds(F.col("iteration") + 1)).withWatermark("time", "0 seconds")
    return with_state_store(rows).groupBy("shard").transformWithStateInPandas(_OnPolicy(max_age, per_question, seed), "at long, question_id long, edge_id long, iteration long", "Append", "EventTime")


class _Pool(StatefulProcessor):
    def __init__(self, k: int, seed: int):
        self.k, self.seed = k, seed

    def init(self, handle) -> None:
        self.least = handle.getListState("least", "digest string, edge_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {(d, e) for d, e in self.least.get()} if self.least.exists() else set()
        for batch in rows:
            held.update((_digest(self.seed, e), int(e)) for e in batch["edge_id"].tolist())
            held = set(heapq.nsmallest(self.k, held))
        least = sorted(held)
        self.least.put(least)
        yield pd.DataFrame({"shard": [key[0]] * len(least), "place": range(len(least)), "edge_id": [e for _, e in least]})

    def close(self) -> None:
        pass


def pooled_shards(edges: DataFrame, k: int = 512, shards: int = 16, seed: int = 0) -> DataFrame:
    """(shard, place, edge_id) of a stream of edges(edge_id), in update mode: the k least of each shard that a micro-batch touched."""
    rows = edges.select(F.col("edge_id").cast("long"), F.pmod(F.xxhash64("edge_id"), F.lit(shards)).cast("int").alias("shard"))
    return with_state_store(rows).groupBy("shard").transformWithStateInPandas(_Pool(k, seed), "shard int, place long, edge_id long", "Update", "None")


def pool(latest_shards: DataFrame, k: int = 512, seed: int = 0) -> DataFrame:
    """The k edges of smallest digest, of the latest rows of all shards: at most shards * k rows."""
    return latest_shards.select("edge_id").orderBy(_hashed("edge_id", seed=seed), "edge_id").limit(k)


# golden cache


def _tables(spark: SparkSession, folder: str, below: int | None = None) -> dict[str, DataFrame]:
    """The rows of all batches in the ledger: cache(question_id, text) and tries(question_id, n)."""
    schema = {"cache": "question_id long, text string, batch long", "tries": "question_id long, n long, batch long"}
    try:
        ledger = spark.read.json(f"{folder}/ledger/*")
    except AnalysisException:
        return {t: spark.createDataFrame([], s).drop("batch") for t, s in schema.items()}
    ledger = ledger.select(F.col("batch").cast("long")).where(F.lit(True) if below is None else F.col("batch") < below).distinct()
    return {t: spark.read.schema(s).option("basePath", f"{folder}/{t}").parquet(f"{folder}/{t}").join(F.broadcast(ledger), "batch").drop("batch") for t, s in schema.items()}


def golden_cache(spark: SparkSession, folder: str) -> DataFrame:
    """(question_id, text): the verified solutions so far."""
    return _tables(spark, folder.rstrip("/"))["cache"]


def golden_sink(questions: DataFrame, folder: str, verified: Column, most: int = 3) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch over a stream of attempts(question_id, attempt, text).

    Of each question with an answer that the cache lacks, the first of its attempts that is verified is appended, if
    fewer than most came before it in all batches; attempts count, blank or not, and later ones are never looked at.
    verified is a column over attempts joined with questions(question_id, answer). A batch that runs again finds itself
    in the ledger, or writes over its own unfinished files, so it appends once.
    """
    folder = folder.rstrip("/")

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            if not spark.read.json(f"{folder}/ledger/{number}").isEmpty():
                return
        except AnalysisException:
            pass
        have = _tables(spark, folder, below=number)
        tried = have["tries"].groupBy("question_id").agg(F.sum("n").alias("_tried"))
        open_ = questions.where(F.length(F.trim("answer")) > 0).join(have["cache"].select("question_id"), "question_id", "left_anti")
        place = F.row_number().over(Window.partitionBy("question_id").orderBy("attempt", "text")) + F.coalesce("_tried", F.lit(0))
        rows = batch.join(open_, "question_id").join(tried, "question_id", "left").withColumn("_place", place).where(F.col("_place") <= most)
        passed = rows.where(F.length(F.trim("text")) > 0).where(verified)
        first = passed.groupBy("question_id").agg(F.min_by("text", "_place").alias("text"))
        for name, out in (("cache", first), ("tries", rows.groupBy("question_id").agg(F.count("*").alias("n")))):
            out.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        spark.range(1).select(F.lit(number).alias("batch")).coalesce(1).write.mode("overwrite").json(f"{folder}/ledger/{number}")

    return append


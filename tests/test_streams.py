"""Sampler, buffers and golden cache: streams against batches and plain loops, restarts and replays."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracewright.streaming import buffers, sampler
from tracewright.streaming.loops import EarlyStop


def digest(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


class Loop:
    """The sampler as one loop over lists."""

    def __init__(self, ids, rule):
        self.rule, self.ids = rule, ids
        self.n, self.c, self.ok, self.up, self.train = dict.fromkeys(ids, 0), dict.fromkeys(ids, 0.0), set(), set(), []

    def draw(self, pool, n, part, t):
        order = sorted(pool, key=lambda q: (digest(self.rule.seed, q), q))
        return [order[int(digest(self.rule.seed, part, t, j)[:15], 16) % len(order)] for j in range(n)]

    def select(self, n, t):
        r = int(n * self.rule.random_share)
        out = self.draw(self.ids, r, "random", t)
        self.train = [q for q in self.train if q not in self.ok and q not in self.up]
        rest = n - r - len(self.train)
        if rest > 0:
            pool = [q for q in self.ids if q not in self.ok and q not in self.up]
            if not pool and self.rule.early_stop:
                raise EarlyStop
            self.train += self.draw(pool or sorted(self.up) or self.ids, rest, "new", t)
        return out + self.train

    def update(self, results):
        by = defaultdict(list)
        for q, x in results:
            by[q].append(x)
        for q, xs in by.items():
            self.n[q] += len(xs)
            self.c[q] += sum(xs)
            passed = sum(xs) / len(xs) >= self.rule.threshold
            if passed and not (self.rule.literal and q in self.ok):
                self.ok.add(q)
            else:
                self.ok.discard(q)
                if self.n[q] >= self.rule.give_up_after:
                    self.up.add(q)

    def state(self):
        return {q: (self.n[q], self.c[q], q in self.ok, q in self.up) for q in self.ids}


def reward(q, t, j):
    return float(int(digest("r", q, t, j)[:4], 16) % (q % 7 + 2) > 0)


@pytest.mark.parametrize("literal", [False, True])
def test_sampler_batch_stream_and_loop_agree(spark, tmp_path, literal):
    rule = sampler.Sticky(0.25, 0.8, 40, True, literal, seed=5)
    ids = list(range(120))
    loop, rounds = Loop(ids, rule), 20
    state = sampler.start(spark.createDataFrame([(q,) for q in ids], "question_id long"))
    before = None
    for t in range(rounds):
        want = loop.select(16, t)
        results = [(q, t, reward(q, t, j)) for j, q in enumerate(sorted(want))]
        if t < 4:
            got = sampler.select(state, before, 16, t, rule)
            rows = got.collect()
            assert Counter(r["question_id"] for r in rows) == Counter(want)
            before = spark.createDataFrame(rows, got.schema)
            now = sampler.update(state, spark.createDataFrame(results, "question_id long, iteration long, reward double"), rule)
            state = spark.createDataFrame(now.collect(), now.schema)
        loop.update([(q, x) for q, _, x in results])
        if t == 3:
            assert {r["question_id"]: tuple(r)[1:] for r in state.collect()} == loop.state()
        # an iteration comes in two files, so in two micro-batches
        for k, part in enumerate((results[:7], results[7:])):
            spark.createDataFrame(part, "question_id long, iteration long, reward double").coalesce(1).write.parquet(f"{tmp_path}/in/{t:03d}-{k}")
    seen = {}

    def keep(df, _):
        seen.update({r["question_id"]: tuple(r)[2:] for r in df.collect()})

    def run():
        rows = spark.readStream.schema("question_id long, iteration long, reward double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = sampler.followed(rows, rule).writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").outputMode("update").trigger(availableNow=True).start()
        assert q.awaitTermination(280) and q.exception() is None

    run()
    assert seen == {q: s for q, s in loop.state().items() if s[0]}


def test_sampler_stops_or_goes_on(spark):
    done = sampler.update(sampler.start(spark.range(3).withColumnRenamed("id", "question_id")), spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 0.0), (2, None)], "question_id long, reward double"), sampler.Sticky(give_up_after=1))
    assert [tuple(r) for r in done.orderBy("question_id").collect()] == [(0, 1, 1.0, True, False), (1, 1, 1.0, True, False), (2, 1, 0.0, False, True)]
    with pytest.raises(EarlyStop):
        sampler.select(done, None, 8, 0, sampler.Sticky(give_up_after=1))
    rows = sampler.select(done, None, 8, 0, sampler.Sticky(early_stop=False)).collect()
    assert len(rows) == 8 and {r["question_id"] for r in rows if r["part"] == "new"} == {2}
    assert len({r["rank"] for r in sampler.ranked(done, 3).collect()} & {0, 1, 2}) == 3


def brute_buffer(edges, last, max_age, most, seed):
    held, out = defaultdict(list), []
    for t in range(last + 1):
        for q, e, i in edges:
            if i == t:
                held[q].append((e, i))
        for q in held:
            held[q] = [x for x in held[q] if t - x[1] < max_age]
            used = sorted(held[q], key=lambda x: (digest(seed, x[0]), x[0]))[:most]
            out += [(t, q, e, i) for e, i in used]
            held[q] = [x for x in held[q] if x not in used]
    return out


def test_buffer_survives_a_restart(spark, tmp_path):
    rng = random.Random(2)
    edges = [(rng.randrange(5), 1000 * t + k, t) for t in range(12) if t not in (5, 6) for k in range(rng.randrange(30))]
    write = lambda t: spark.createDataFrame([e for e in edges if e[2] == t] or [(99, -t - 1, t)], "question_id long, edge_id long, iteration long").coalesce(1).write.parquet(f"{tmp_path}/in/{t:03d}")
    got = []

    def run(fail_at=None):
        def keep(df, n):
            if n == fail_at:
                raise RuntimeError("lost")
            got.extend(tuple(r) for r in df.collect())

        rows = spark.readStream.schema("question_id long, edge_id long, iteration long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = buffers.used_edges(rows, 3, 4, 7).writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(280)
        except Exception as e:
            assert "lost" in str(e)

    for t in range(6):
        write(t)
    run(fail_at=4)
    for t in range(6, 12):
        write(t)
    # a later iteration closes the last one
    spark.createDataFrame([(99, -99, 30)], "question_id long, edge_id long, iteration long").coalesce(1).write.parquet(f"{tmp_path}/in/zzz")
    run()
    want = brute_buffer([e for e in edges], 29, 3, 4, 7)
    mine = sorted(r for r in got if r[1] != 99)
    assert (sorted(set(want) - set(mine)), sorted(set(mine) - set(want))) == ([], []) and len(mine) == len(want)


def test_pool_of_shards(spark, tmp_path):
    ids = list(range(3000))
    for k in range(3):
        spark.createDataFrame([(i,) for i in ids[k::3]], "edge_id long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    latest = {}

    def keep(df, _):
        for r in df.collect():
            latest[r["shard"], r["place"]] = r["edge_id"]

    rows = spark.readStream.schema("edge_id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = buffers.pooled_shards(rows, 50, 4).writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").outputMode("update").trigger(availableNow=True).start()
    assert q.awaitTermination(280)
    got = buffers.pool(spark.createDataFrame([(s, p, e) for (s, p), e in latest.items()], "shard int, place long, edge_id long"), 50)
    assert {r[0] for r in got.collect()} == set(sorted(ids, key=lambda e: digest(0, e))[:50])


def test_golden_cache_appends_once(spark, tmp_path):
    questions = spark.createDataFrame([(1, "7"), (2, "8"), (3, " "), (4, "9"), (5, "1")], "question_id long, answer string")
    add = buffers.golden_sink(questions, f"{tmp_path}/g", F.col("text") == F.col("answer"))
    batches = [
        [(1, 0, "0"), (1, 1, "7"), (2, 0, " "), (2, 1, "0"), (3, 0, " "), (4, 0, "x")],
        [(1, 0, "7"), (2, 2, "0"), (4, 1, "9"), (4, 2, "9")],
        [(2, 3, "8"), (5, 0, "1")],
    ]
    frame = lambda b: spark.createDataFrame(b, "question_id long, attempt long, text string")
    read = lambda: sorted(tuple(r) for r in buffers.golden_cache(spark, f"{tmp_path}/g").collect())
    assert read() == []
    add(frame(batches[0]), 0)
    add(frame(batches[0]), 0)
    assert read() == [(1, "7")]
    # a batch that was lost between its rows and the ledger: its rows do not count, and it runs again
    frame([(9, 0, "lost")]).select("question_id", "text").write.parquet(f"{tmp_path}/g/cache/batch=1")
    assert read() == [(1, "7")]
    for k in (1, 2, 2, 1):
        add(frame(batches[k]), k)
    # question 2 had three attempts before its right one
    assert read() == [(1, "7"), (4, "9"), (5, "1")]


def test_replay_state_goes_by_shard(spark, tmp_path):
    edges = [(q, 100 * q + k, k % 3) for q in range(60) for k in range(7)]
    schema = "question_id long, edge_id long, iteration long"
    for t in range(3):
        spark.createDataFrame([e for e in edges if e[2] == t], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{t}")
    spark.createDataFrame([(-1, -1, 9)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/end")
    got = []

    def keep(df, _):
        got.extend(tuple(r) for r in df.collect())

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    used = buffers.used_edges(rows, 2, 2, 0, shards=3)
    q = used.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(280)
    assert sorted(r for r in got if r[1] >= 0) == sorted(brute_buffer(edges, 8, 2, 2, 0))

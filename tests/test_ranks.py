"""Ranks and inversions against all pairs."""

import random

from tracewright.operators import metrics, ranks


def test_concordant_pairs_like_all_pairs(spark, monkeypatch):
    rng = random.Random(1)
    rows = []
    for key in range(12):
        span = rng.choice([2, 5, 1000])
        for _ in range(rng.choice([0, 1, 2, 7, 60])):
            rows.append((f"k{key}", key % 3, rng.choice([None, *map(float, range(span))]) if rng.random() < 0.3 else float(rng.randrange(span)), rng.randrange(span)))
    rows += [("hot", 0, float(rng.randrange(400)), rng.randrange(300)) for _ in range(1500)] + [(None, 0, 1.0, 1), ("nulls", 0, None, 1), ("nulls", 0, None, 2)]
    monkeypatch.setattr(ranks, "BLOCK", 16)
    df = spark.createDataFrame(rows, "k string, j int, a double, b int").repartition(3)
    got = {(r["k"], r["j"]): (r["pairs"], r["accuracy"]) for r in metrics.ranking_accuracy(df, ["k", "j"], "a", "b").collect()}
    groups = {}
    for k, j, a, b in rows:
        groups.setdefault((k, j), []).append((a, b))
    want = {}
    for key, items in groups.items():
        n, whole = len(items), [x for x in items if x[0] is not None]
        good = sum((x[0] - y[0]) * (x[1] - y[1]) > 0 for i, x in enumerate(whole) for y in whole[:i])
        if n > 1:
            m = len(whole) * (len(whole) - 1) // 2
            want[key] = (n * (n - 1) // 2, good / m if m else None)
    assert got.keys() == want.keys()
    for k, (pairs, accuracy) in want.items():
        assert got[k][0] == pairs and (got[k][1] is None) == (accuracy is None) and (accuracy is None or abs(got[k][1] - accuracy) < 1e-12)


def test_concordant_pairs_by_array_and_by_bits(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k if k else None, rng.choice([None, rng.randrange(6)]), rng.randrange(9)) for k in range(9) for _ in range(k * 3)] + [(9, None, 1)]
    df = spark.createDataFrame(rows, "k int, a int, b int").repartition(3)
    each = []
    for small in (0, 7, 128):
        monkeypatch.setattr(ranks, "SMALL", small)
        each.append(sorted(map(tuple, ranks.concordant(df, ["k"], "a", "b").collect())))
    assert each[0] == each[1] == each[2] and len(each[0]) > 5


def test_dense_ranks(spark):
    rows = [(k % 3, v) for k in range(300) for v in (k * 7 % 50, k)]
    got = ranks.dense_ranks(spark.createDataFrame(rows, "k int, v int").repartition(5), ["k"], "v", "r").collect()
    for k in range(3):
        values = sorted({v for q, v in rows if q == k})
        assert {r["v"]: r["r"] for r in got if r["k"] == k} == {v: i for i, v in enumerate(values)}


def test_indices_shards_and_thinning_like_windows(spark):
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from tracewright.operators import sampling

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), k) for k in rng.sample(range(10_000), 700)] + [("one", 1)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    w = W.partitionBy("g").orderBy("v")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(sampling.row_index(df, ["g"], "v"), df.withColumn("idx", (F.row_number().over(w) - 1).cast("long")))
    for n in (1, 7, 600):
        assert same(sampling.shards(df, ["g"], "v", n), df.withColumn("shard", F.ntile(n).over(w) - 1))
    sizes = {g: sorted(v for k, v in rows if k == g) for g in {g for g, _ in rows}}
    want = {(g, x[i * len(x) // 7]) for g, x in sizes.items() for i in range(7)}
    assert {tuple(r) for r in sampling.thinned(df, ["g"], "v", 7).collect()} == want

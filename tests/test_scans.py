"""Backward scans over long arrays against plain loops."""

import random

from pyspark.sql import functions as F

from tracewright.operators import advantages


def test_generalised_advantages_of_long_responses(spark):
    rng = random.Random(9)
    rows = [(n, [rng.uniform(-1, 1) for _ in range(n)], [rng.uniform(-1, 1) for _ in range(n)]) for n in (0, 1, 2, 127, 128, 129, 256, 1000, 20_000)]
    df = spark.createDataFrame([*rows, (-1, None, None)], "n int, r array<double>, v array<double>")
    for gamma, lam in ((1.0, 0.95), (0.99, 0.9), (1.0, 1.0), (0.5, 0.0)):
        got = {r["n"]: r["a"] for r in df.select("n", advantages.generalised(F.col("r"), F.col("v"), gamma, lam).alias("a")).collect()}
        assert got.pop(-1) is None
        for n, r, v in rows:
            last, want = 0.0, []
            for i in reversed(range(n)):
                last = r[i] + gamma * (v[i + 1] if i + 1 < n else 0.0) - v[i] + gamma * lam * last
                want.append(last)
            assert len(got[n]) == n and all(abs(a - b) < 1e-8 for a, b in zip(got[n], reversed(want)))

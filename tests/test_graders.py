"""Graders, solvers, losses and loops on small cases worked out by hand or in numpy."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright import plugins
from tracewright.functions import graders, maths, puzzles
from tracewright.functions import text as X
from tracewright.operators import advantages, diversity, joins, losses, sampling
from tracewright.sources import readers, writers
from tracewright.streaming import loops


def answers(spark, function, rows):
    """function over columns a, b, ... of rows, in order."""
    names = "abcdef"[: len(rows[0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} string" for c in names))
    return [r[1] for r in df.select("i", function(*[F.col(c) for c in names]).alias("x")).orderBy("i").collect()]


def test_competition_form(spark):
    cases = {
        "\\frac12": "\\frac{1}{2}", "\\frac1{72}": "\\frac{1}{72}", "\\dfrac{3}{4}": "\\frac{3}{4}", "3/4": "\\frac{3}{4}", "03/4": "03/4", "0.5": "\\frac{1}{2}", ".5": "\\frac{1}{2}", "x = 7": "7", "xyz=7": "xyz=7",
        "\\sqrt3": "\\sqrt{3}", "\\text{ blue }": "blue", "5\\text{ cm}": "5", "a\\text{ b}\\text{ c}": "a\\text{ b}\\text{ c}", "\\sqrt": "\\sqrt", "\\frac": "\\frac", "90^\\circ": "90", "50\\%": "50", "": "",
    }
    assert answers(spark, graders.competition_normal, [(k,) for k in cases]) == list(cases.values())
    assert answers(spark, graders.competition_normal, [(None,), ("1",)])[0] is None


def test_process_form(spark):
    cases = {"1,000": "1000", "1,234,567,890": "1,234,567,890", "3 1/2": "3+1/2", "5 cm": "5", "12 inches^2": "12", "{7}": "7", "7.0": "7", "- 3": "-3", "\\text{Yes}": "yes", "2 million": "2*10^6", "\\frac{1}{2}": "1/2", "\\sqrt{2}": "sqrt(2)"}
    # of four groups the commas between the last ones are not seen again once the first is gone, so they are no integer
    assert answers(spark, graders.process_normal, [(k,) for k in cases]) == list(cases.values())
    assert answers(spark, graders.without_number_commas, [("1,234,567,890",), ("1,234,567",), ("1,23",)]) == ["1234,567890", "1234567", "1,23"]


def test_process_grade(spark):
    rows = [("1/2", "0.5", True), ("2/4", "1/2", False), ("(1,2)", "(1, 2)", True), ("(1,2)", "[1,2)", False), ("1.5", "2", False), (None, "2", False), ("x", None, False), ("", "2", False)]
    assert answers(spark, lambda a, b: graders.process_grade(a, b), [r[:2] for r in rows]) == [r[2] for r in rows]


def test_list_form(spark):
    assert answers(spark, lambda x: F.to_json(graders.listed_answers(x)), [("\\boxed{1} \\boxed{2}",), ("no number",), ("boxed{a{b}",), ("he answer is 5.\nThen 6",)]) == ['["1","2"]', "[]", "[]", '["5"]']
    rows = [("x+1", "x+1", True), ("50\\%", "0.5", True), ("(1,2)", "(2,1)", False), ("x=3", "3", True), ("a=b", "b=a", True), ("1e1000", "2", False), ("", "0", False)]
    assert answers(spark, lambda a, b: graders.listed_correct(a, b), [r[:2] for r in rows]) == [r[2] for r in rows]
    df = spark.createDataFrame([(["1", "1", "2"], ["2"]), (["2", "1"], ["1", "2"]), ([], []), (["1"], [])], "p array<string>, a array<string>")
    assert [r[0] for r in df.select(graders.listed_grade(F.col("p"), F.col("a"))).collect()] == [True, True, True, False]


def numpy_rewards(a, last):
    n = len(a)
    b = np.zeros((n, n))
    for i in range(n):
        b[i, : i + 1] = a[i]
        if i + 1 < n:
            b[i, i + 1] -= 1
    c = np.zeros(n)
    c[-1] = last
    x = np.linalg.lstsq(b, c, rcond=None)[0] if abs(np.linalg.det(b)) < 1e-12 else np.linalg.solve(b, c)
    bound = max(10 * abs(last), 5)
    return np.clip([*x, last], -bound, bound)


def test_rewards_to_the_outcome_like_linear_algebra(spark):
    rng = random.Random(1)
    rows = [([[rng.uniform(0, 1) for _ in range(i + 1)] for i in range(n)], rng.choice([1.0, -1.0, 0.1])) for n in range(1, 7) for _ in range(5)]
    rows += [([[0.0], [0.0, 0.0]], 1.0), ([[1.0], [1.0, -1.0]], 1.0), ([[0.5], [0.0, 0.0], [0.3, 0.0, 0.0]], 1.0)]
    df = spark.createDataFrame([(i, a, r) for i, (a, r) in enumerate(rows)], "i int, a array<array<double>>, r double")
    got = [x[0] for x in df.orderBy("i").select(maths.rewards_to_outcome(F.col("a"), F.col("r"))).collect()]
    for (a, r), x in zip(rows, got):
        assert np.allclose(x, numpy_rewards(a, r), atol=1e-6), (a, r)
    empty = spark.createDataFrame([([], 0.5)], "a array<array<double>>, r double")
    assert empty.select(maths.rewards_to_outcome(F.col("a"), F.col("r"))).first()[0] == [0.5]


def test_step_advantages_like_the_recursion(spark):
    rng = random.Random(2)
    rows = [(r, k, rng.uniform(-1, 1), rng.choice([None, rng.uniform(0, 1)])) for r in range(12) for k in range(r + 1)]
    got = {(x["response_id"], x["step"]): x["advantage"] for x in advantages.step_advantages(spark.createDataFrame(rows, "response_id int, step int, reward double, value double")).collect()}
    for r in range(12):
        mine, nxt = [x for x in rows if x[0] == r], 0.0
        for _, k, reward, value in reversed(mine):
            filled = value if value is not None else reward + nxt
            assert abs(got[r, k] - (reward + nxt - filled)) < 1e-9
            nxt = filled


def test_ranks_in_ranges_of_the_hash(spark):
    rows = [(k, "a" if k % 3 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, g string")
    got = sampling.ranked(df, ["g"], F.md5(F.col("k").cast("string")), "k").collect()
    import hashlib

    for g in ("a", None):
        want = sorted((hashlib.md5(str(k).encode()).hexdigest(), k) for k, h in rows if h == g)
        assert [k for _, k in sorted((r["_r"], r["k"]) for r in got if r["g"] == g)] == [k for _, k in want]
    assert sampling.portion(df, "k", ["g"], 0.1).count() == len([1 for _, g in rows if g]) // 10 + len([1 for _, g in rows if not g]) // 10


def test_first_containing_like_substring_search(spark):
    rng = random.Random(3)
    words = ["aa", "bb", "cc", "d d", "", "é"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [(k, say(60)) for k in range(40)] + [(90, None), (91, "")]
    items = [(k, say(rng.randrange(1, 9))[rng.randrange(2) :]) for k in range(60)] + [(99, None), (98, "")]
    got = {(r["k"], r["id"]) for r in joins.first_containing(spark.createDataFrame(texts, "k int, text string"), "text", spark.createDataFrame(items, "id int, item string"), "id", "item").collect()}
    want = set()
    for k, t in texts:
        hits = [i for i, x in items if x and t and x in t]
        if hits:
            want.add((k, min(hits)))
    assert got == want


def brute_bleu(texts):
    pairs = [(a.split(), b.split()) for i, a in enumerate(texts) for b in texts[i + 1 :]]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    logs = []
    for n in range(1, 5):
        m = sum(sum((grams(a, n) & grams(b, n)).values()) for a, b in pairs)
        p = sum(max(len(a) - n + 1, 0) for a, _ in pairs)
        if not m:
            return 0.0
        logs.append(math.log(m / p))
    x, y = sum(len(a) for a, _ in pairs), sum(len(b) for _, b in pairs)
    return math.exp(sum(logs) / 4) * (1 if x > y else math.exp(1 - y / x))


def test_sibling_bleu_like_all_pairs(spark):
    rng = random.Random(4)
    rows = [(g, k, " ".join(rng.choice("abc") for _ in range(rng.randrange(12)))) for g in range(20) for k in range(g % 6)]
    got = {r["g"]: r["bleu"] for r in diversity.sibling_bleu(spark.createDataFrame(rows, "g int, k int, t string"), ["g"], "k", "t").collect()}
    for g in range(20):
        texts = [t for h, _, t in rows if h == g]
        assert (g in got) == (len(texts) > 1)
        assert len(texts) < 2 or abs(got[g] - brute_bleu(texts)) < 1e-9


def test_sibling_bleu_by_family_and_by_gram(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(g if g else None, k, rng.choice([None, "", " ".join(rng.choice(["a", "b", "c\u00a0d", "e"]) + rng.choice(["", "\n", "\t "]) for _ in range(rng.randrange(40)))])) for g in range(9) for k in range(g % 5 + 1)]
    df = spark.createDataFrame(rows, "g int, k int, t string").repartition(3)
    each = []
    for limit in (0, 30, diversity.FAMILY):
        monkeypatch.setattr(diversity, "FAMILY", limit)
        each.append({r["g"]: (r["n"], r["bleu"]) for r in diversity.sibling_bleu(df, ["g"], "k", "t").collect()})
    assert each[0].keys() == each[1].keys() == each[2].keys()
    assert all(x[g] == (n, pytest.approx(b)) for x in each[:2] for g, (n, b) in each[2].items())


def test_rewards_by_name_grade_different_tuples(spark, tmp_path):
    from tracewright.plans import plugin_queries

    spark.createDataFrame([(k, k % 4, k % 6, 1.0 + k % 2) for k in range(48)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = plugin_queries.f1_f7_f11_rewards_by_name(spark, str(tmp_path))
    assert "Aggregate" in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.collect()
    assert len(rows) == 48 and {r["offline"] for r in rows} == {0.5} and all(r["judged"] == r["l_linenumber"] / 10 for r in rows)


def test_boxed_steps_by_closing_braces(spark):
    cases = {
        "\\boxed{a{b}c}d}": "a{b}c", "\\boxed{}": "", "\\boxed{{}": "{}", "\\boxed{\U0001d465{é}} }": "\U0001d465{é}", "\\boxed{open {x}": "open {x}", "\\boxed{ 7 } and }": "7", "no box": None, "\\boxed{1} \\boxed{2": "2",
    }
    df = spark.createDataFrame([(x,) for x in cases], "x string")
    assert {r["x"]: r["b"] for r in df.select("x", X.boxed(F.col("x")).alias("b")).collect()} == cases
    # a step a brace, not a character
    assert r"\}, -1" in df.select(X.boxed(F.col("x")))._jdf.queryExecution().analyzed().toString()


def test_components(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 4))
    df = spark.createDataFrame([(1, k, k // 4, x[k].tolist()) for k in range(12)], "response_id int, pos int, phase_id int, state array<double>")
    got = {(r["a"], r["b"]): r["confluence"] for r in diversity.state_confluence(df, 3).collect()}
    c = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c @ c.T)
    means = np.array([vectors[:, ::-1][4 * p : 4 * p + 4, :3].mean(axis=0) for p in range(3)])
    unit = means / np.linalg.norm(means, axis=1, keepdims=True)
    assert all(abs(got[a, b] - ((unit @ unit.T)[a, b] + 1) / 2) < 1e-9 for a in range(3) for b in range(3))
    # with all components nothing is lost
    heads = rng.uniform(size=(12, 3))
    cells = spark.createDataFrame([(1, k, k, k // 6, k % 2, heads[k].tolist()) for k in range(12)], "response_id int, q int, k int, q_phase int, k_phase int, heads array<double>")
    for r in diversity.denoised_attention(cells, 3).collect():
        assert abs(r["w"] - heads[[k for k in range(12) if (k // 6, k % 2) == (r["q_phase"], r["k_phase"])]].mean()) < 1e-9


def test_puzzles_that_reach_24():
    assert puzzles.reaches((3, 3, 8, 8)) and puzzles.reaches((1, 5, 5, 5)) and puzzles.reaches((24,)) and not puzzles.reaches((1, 1, 1, 1)) and not puzzles.reaches((0, 0))


def test_token_advantages_and_padding(spark):
    one = spark.range(1).select(
        losses.character_to_token_advantages(F.array(F.lit("ab"), F.lit("c")), F.array(F.lit(0.1), F.lit(0.2)), F.array(*map(F.lit, (0, 1, 3, 4))), F.lit(False)).alias("a"),
        losses.shifted_logprobs(F.array(*map(F.lit, (1.0, 2.0, 3.0))), F.lit(2), F.lit(6), 0.0).alias("s"), losses.rectangle(F.array(F.lit(5.0)), 3, 0.0).alias("r"),
    ).first()
    # "\nab\n" holds characters 0 to 3, "c" the fourth; the first token goes and the end copies the last
    assert one["a"] == [0.1, 0.1, 0.2, 0.2] and one["s"] == [0.0, 2.0, 3.0, 0.0, 0.0] and one["r"].asDict() == {"values": [5.0, 0.0, 0.0], "mask": [1, 0, 0]}


def test_loop_resumes_and_skips(spark, tmp_path):
    seen = []

    def step(state, k):
        seen.append(k)
        return None if k == 1 else state.withColumn("v", F.col("v") + 10**k)

    start = spark.createDataFrame([(0,)], "v int")
    loops.iterate(spark, f"file://{tmp_path}/l", start, step, 5, stop_at=2)
    out = loops.iterate(spark, f"file://{tmp_path}/l", start, step, 4)
    assert seen == [0, 1, 2, 3] and out.first()["v"] == 1101
    assert loops.written_iterations(spark, f"file://{tmp_path}/none", 3) == 0


def test_rewrite_leaves_one_whole_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(5).write.parquet(path)
    writers.rewrite(spark, path, lambda df: df.where("id > 1"))
    assert spark.read.parquet(path).count() == 3 and len(list(tmp_path.iterdir())) == 1


def test_first_readable_path(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/b")
    assert readers.read_first(spark, [f"{tmp_path}/a", f"{tmp_path}/b"]).count() == 2
    with pytest.raises(Exception):
        readers.read_first(spark, [f"{tmp_path}/a"])


def test_plugins():
    assert plugins.named("reward", "gsm8k") is X.score_gsm8k
    plugins.register("judge", "mine")(len)
    assert plugins.named("judge", "mine") is len
    with pytest.raises(KeyError):
        plugins.register("judge", "mine")(len)
    with pytest.raises(KeyError):
        plugins.named("judge", "none")
    del plugins.KINDS["judge"]["mine"]

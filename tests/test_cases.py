"""Unit cases on tiny frames."""

import math

import pytest
from pyspark.sql import functions as F

from tracewright.functions import maths, text
from tracewright.operators import advantages, metrics, phases, rewards, sampling, trees
from tracewright.streaming import state


def signal(spark, rows, name="entropy"):
    return spark.createDataFrame([(0, r, p, float(v)) for r, values in rows.items() for p, v in enumerate(values)], f"group_id int, response_id int, pos int, {name} double")


def bounds(df):
    return {r["response_id"]: r["boundaries"] for r in df.collect()}


def value(spark, column, **inputs):
    kinds = {k: v[1] for k, v in inputs.items()}
    df = spark.createDataFrame([tuple(v[0] for v in inputs.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))
    return df.select(column.alias("x")).first()["x"]


def test_entropy(spark):
    assert value(spark, maths.entropy(F.col("a")), a=([0.0] * 100, "array<double>")) == pytest.approx(math.log(100))
    assert value(spark, maths.entropy(F.col("a")), a=([0.0] + [-1e9] * 49, "array<double>")) < 0.01
    assert value(spark, maths.token_entropy(None, F.col("p")), p=(-2.0, "double")) == 2.0
    assert value(spark, maths.token_entropy(F.col("a"), F.col("p")), a=([0.0, 0.0], "array<double>"), p=(-2.0, "double")) == pytest.approx(math.log(2))
    with pytest.raises(ValueError):
        maths.token_entropy(None, None)
    assert value(spark, maths.top_k_entropy(F.col("a")), a=([math.log(0.5), math.log(0.25)], "array<double>")) == pytest.approx(1.5 * math.log(2))


def test_peaks(spark):
    two, close, many = [0.5] * 50, [0.1] * 30, [0.1] * 200
    two[20], two[40] = 5.0, 4.0
    close[10], close[13] = 5.0, 4.5
    for k in range(0, 200, 10):
        many[k] = 1.0 + k / 100
    found = bounds(phases.peak_boundaries(signal(spark, {1: two}), "entropy", 80, 5, 10))
    assert found[1] == [0, 20, 40]
    found = bounds(phases.peak_boundaries(signal(spark, {1: close}), "entropy", 50, 10, 10))
    assert 10 in found[1] and 13 not in found[1]
    found = bounds(phases.peak_boundaries(signal(spark, {1: many, 2: [1.0] * 50}), "entropy", 80, 5, 5))
    assert len(found[1]) == 5 and found[2] == [0]


def test_sliding_windows(spark):
    one, other = [0.1] * 100, [0.1] * 100
    one[20:35], one[60:75], other[40:55] = [5.0] * 15, [4.0] * 15, [6.0] * 15
    found = bounds(phases.sliding_boundaries(signal(spark, {1: one, 2: other, 3: [1.0] * 8}), "entropy", 10, 75, 10, 5))
    assert all(b[0] == 0 and b == sorted(b) and len(b) <= 5 for b in found.values())
    assert all(y - x >= 10 for b in found.values() for x, y in zip(b, b[1:]))
    assert len(found[1]) >= 2 and found[3] == [0]


def test_limits_between_equal_sums(spark):
    """Two windows have the sum 272.06, added in another order; DuckDB's limit is the upper one of their means, so it is no candidate."""
    x = [
        35.74, 105.37, 4.09, 13.02, 59.61, 32.72, 21.78, 8.44, 29.28, 45.52, 29.38, 51.26, 5.58, 35.67, 88.39, 91.16, 13.26, 52.69, 15.17, 7.52, 5.15, 113.98, 100.69, 41.38, 46.59,
        14.39, 72.67, 78.29, 6.91, 89.82, 23.64, 119.44, 31.64, 13.15, 16.2, 70.33, 119.84, 52.54, 6.23, 0.81, 68.31, 73.32, 77.33, 15.16, 130.42, 42.44, 15.13, 2.63, 62.87, 28.37,
        1.77,
    ]
    assert bounds(phases.sliding_boundaries(signal(spark, {1: x}), "entropy", 5, 80.0, 5, 6))[1] == [0, 13, 21, 27, 40]


def test_phases_partition_tokens(spark):
    t = signal(spark, {1: [0.1] * 30})
    b = spark.createDataFrame([(0, 1, 0, 30, [0, 10, 25])], "group_id int, response_id int, start int, end int, boundaries array<int>")
    sizes = {r["phase_id"]: r["count"] for r in phases.assign(t, b).groupBy("phase_id").count().collect()}
    assert sizes == {0: 10, 1: 15, 2: 5}
    assert [(r["phase_start"], r["phase_end"]) for r in phases.segments(b).orderBy("phase_id").collect()] == [(0, 10), (10, 25), (25, 30)]


@pytest.mark.parametrize(("outcome", "total"), [(1.0, 1.0), (0.1, 0.1), (0.0, -1.0)])
def test_entropy_credit_sums_to_the_total(spark, outcome, total):
    rows = [(0, r, p, float(e), outcome if r == 1 else 0.0) for r, es in {1: [3, 1, 2], 2: [5, 4], 3: [2]}.items() for p, e in enumerate(es)]
    out = rewards.entropy_credit(spark.createDataFrame(rows, "group_id int, response_id int, phase_id int, phase_entropy double, outcome double"))
    sums = {r["response_id"]: r["s"] for r in out.groupBy("response_id").agg(F.sum("phase_reward").alias("s")).collect()}
    assert sums[1] == pytest.approx(total) and sums[2] == pytest.approx(-1.0) and sums[3] == pytest.approx(-1.0)


def test_influence(spark):
    w = {(1, 0): 0.012, (2, 0): 0.009, (2, 1): 0.015, (3, 2): 0.019, (0, 0): 1.0, (1, 2): 9.0}
    att = spark.createDataFrame([(1, q, k, v) for (q, k), v in w.items()], "response_id int, q_phase int, k_phase int, w double")
    got = {(r["i"], r["j"]): r["a"] for r in rewards.influence(att).collect()}
    assert got == {(0, 0): 0.012, (1, 0): 0.009, (1, 1): 0.015, (2, 2): 0.019}
    rows = rewards.influence(att, "row").groupBy("i").agg(F.sum("a").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in rows)


@pytest.mark.parametrize("norm", ["row", "col", "matrix"])
@pytest.mark.parametrize("w", [0.0, 1e-14, -2.0])
def test_influence_without_weight_stays_as_it_is(spark, norm, w):
    att = spark.createDataFrame([(1, 1, 0, w)], "response_id int, q_phase int, k_phase int, w double")
    assert [r["a"] for r in rewards.influence(att, norm).collect()] == [w]


def test_forward_substitution(spark):
    solve = maths.forward_substitution(F.col("a"), F.col("last"), F.col("first"))
    got = value(spark, solve, a=([[0.5, 0.0], [0.3, 0.4]], "array<array<double>>"), last=(1.0, "double"), first=(0.5, "double"))
    assert got == pytest.approx([0.5, 0.25, 1.25])


def test_human_count(spark):
    # the original's examples, every unit's first and last number, millions that its product with 1e-6 rounds down; 1150 as in the SQL
    want = {
        0: "0  ", 123: "123  ", 999: "999  ", 1000: "1.0 K", 1234: "1.2 K", 1150: "1.1 K", 100000: "100 K", 999999: "999 K", 10**6: "1.0 M", 2 * 10**6: "2.0 M", 1350000: "1.3 M", 2450000: "2.4 M",
        1450000: "1.4 M", 10**9 - 1: "999 M", 10**9: "1.0 B", 3 * 10**9: "3.0 B", 10**12 - 1: "999 B", 10**12: "1.0 T", 4 * 10**14: "400 T", 10**15 - 1: "999 T", 5 * 10**15: "5,000 T",
    }
    got = spark.createDataFrame([(n,) for n in want], "n bigint").select("n", maths.human_count(F.col("n")).alias("x")).collect()
    assert {r["n"]: r["x"] for r in got} == want


def test_group_advantages(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 0.0), (1, 0.0), (2, 1.0), (3, 0.5), (3, 0.5)], "group_id int, s double")
    s = F.col("s")
    out = df.select("group_id", advantages.grpo(s).alias("g"), advantages.leave_one_out(s).alias("r"), advantages.grpo_or_centred(s).alias("d")).collect()
    assert sum(r["r"] for r in out if r["group_id"] == 1) == pytest.approx(0)
    assert sum(r["g"] for r in out if r["group_id"] == 1) == pytest.approx(0)
    assert [r["g"] for r in out if r["group_id"] == 3] == [0.0, 0.0]
    assert [(r["g"], r["r"], r["d"]) for r in out if r["group_id"] == 2] == [(0.0, 1.0, 0.0)]


def test_decay(spark):
    first = value(spark, advantages.decayed(F.col("a"), F.lit(0)), a=(6.0, "double"))
    later = value(spark, advantages.decayed(F.col("a"), F.lit(9)), a=(6.0, "double"))
    assert first == pytest.approx(5.0) and 2.0 < later < first


def test_generalised_advantages(spark):
    r, v, g, l = [0.0, 1.0, 0.5], [0.2, 0.1, 0.4], 0.9, 0.8
    got = value(spark, advantages.generalised(F.col("r"), F.col("v"), g, l), r=(r, "array<double>"), v=(v, "array<double>"))
    d = [r[i] + g * (v[i + 1] if i < 2 else 0) - v[i] for i in range(3)]
    assert got == pytest.approx([sum((g * l) ** (s - t) * d[s] for s in range(t, 3)) for t in range(3)])
    assert value(spark, advantages.returns(F.col("r"), 0.5), r=(r, "array<double>")) == pytest.approx([0.625, 1.25, 0.5])


def test_cut_point_advantages(spark):
    rows = [(1, p, 0.95 if p == 2 else 0.5, v) for p, v in enumerate([None, 0.2, None, 0.5, None])]
    out = advantages.from_cutpoints(spark.createDataFrame(rows, "response_id int, pos int, prob double, value double"))
    assert [r["advantage"] for r in out.orderBy("pos").collect()] == pytest.approx([0.0, 0.0, 0.0, 0.3, 0.0])


def test_pass_at_k_and_votes(spark):
    at = lambda n, c, k, u=False: value(spark, maths.pass_at_k(F.col("n"), F.col("c"), k, u), n=(n, "bigint"), c=(c, "bigint"))
    assert at(4, 0, 2) == 0.0 and at(4, 2, 1) == 1.0 and at(4, 2, 1, True) == pytest.approx(0.5)
    assert at(4, 1, 2) == pytest.approx(0.5) and at(100, 3, 2, True) == pytest.approx(1 - 97 * 96 / 9900)
    rows = [(1, 0, "a", False), (1, 1, "b", True), (2, 0, None, False), (2, 1, None, False), (2, 2, "x", True), (3, 0, "q", True), (3, 1, "q", False), (3, 2, "", False)]
    got = {r["problem_id"]: r for r in metrics.answer_votes(spark.createDataFrame(rows, "problem_id int, idx int, answer string, correct boolean")).collect()}
    assert (got[1]["majority_correct"], got[2]["majority_correct"], got[3]["majority_correct"]) == (0, 0, 1)
    assert got[2]["unique_answers"] == 2 and got[2]["none_frac"] == pytest.approx(2 / 3) and got[3]["none_frac"] == pytest.approx(1 / 3)


GRADES = [
    ("gsm8k", "\\boxed{\\frac{1}{2}}", "\\dfrac{1}{2}", 1.0),
    ("gsm8k", "so #### 1,000", "1000", 1.0),
    ("gsm8k", "\\boxed{3}", "4", 0.1),
    ("gsm8k", "no number", "4", 0.0),
    ("math", "\\boxed{1} then \\boxed{2", "2", 1.0),
    ("math", "\\boxed{1/2}", "0.5", 1.0),
    ("math", "\\boxed{50\\%}", "0.5", 1.0),
    ("math", "\\boxed{x=5}", "5", 1.0),
    ("math", "\\boxed{1,-2}", "-2,1", 1.0),
    ("math", "\\boxed{\\left(2, 12\\right)}", "(2,12)", 1.0),
    ("math", "answer 7", "\\boxed{7}", 1.0),
    ("competition_math", "answer 7", "\\boxed{7}", 0.0),
    ("unknown", "\\boxed{2}", "2.0", 1.0),
    ("math", "", "2", 0.0),
    ("math", None, "2", 0.0),
]


def test_grading(spark):
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(GRADES)], "i int, source string, solution string, gold string, want double")
    for r in df.withColumn("got", text.score(F.col("source"), F.col("solution"), F.col("gold"))).collect():
        assert r["got"] == r["want"], r


def test_texts(spark):
    one = lambda f, x: value(spark, f(F.col("x")), x=(x, "string"))
    assert one(text.boxed, "a \\boxed{b{c}d} e") == "b{c}d" and one(text.boxed, "none") is None
    assert one(text.boxed_by_pattern, "\\boxed{1} \\boxed{\\frac{1}{2}}") == "\\frac{1}{2}"
    assert one(text.last_number, "from 3 to -1,234.5") == "-1234.5"
    assert one(text.number, "1/4") == 0.25 and one(text.number, "1_000") is None and one(text.number, "1/0") is None
    assert one(text.question_id, " \n x\t") == one(text.question_id, "x")
    assert one(text.judge_score, '<think>0.1</think>{"score": 0.7}') == 0.7 and one(text.judge_score, "garbage") == 0.5
    assert one(text.answer_after_heading, "x\n# Answer\n 5 ") == "5" and one(text.answer_after_heading, "# Answer\n1# Answer\n2") is None
    got = one(text.steps, "\n\nfirst\nsecond\n\nlast")
    assert "".join(got) == "\n\nfirst\nsecond\n\nlast" and all(s.strip() for s in got)
    assert one(text.preview, "a\nb") == "a b"


def test_tree_fold_is_a_mean_of_means(spark):
    rows = [(0, "r", None, 0, None), (0, "a", "r", 1, None), (0, "b", "r", 1, None), (0, "c", "r", 1, None), (0, "a1", "a", 2, 1.0), (0, "b1", "b", 2, 0.0), (0, "b2", "b", 2, 0.0), (0, "b3", "b", 2, 1.0)]
    nodes = spark.createDataFrame(rows, "tree_id int, node_id string, parent_id string, depth int, score double")
    got = {r["node_id"]: r["value"] for r in trees.fold_means(nodes, F.col("score"), 2).collect()}
    assert got["b"] == pytest.approx(1 / 3) and got["c"] == 0.0 and got["r"] == pytest.approx((1 + 1 / 3 + 0) / 3)
    assert trees.paths(nodes, 2, ["node_id"]).count() == 5


def test_path_processors(spark):
    kind = "array<struct<score double, advantage double, weight double>>".replace(" double", ": double")
    chain = [(0.0, 0.0, 1.0), (1.0, 0.5, 2.0), (0.0, -0.2, 1.0), (1.0, 0.0, 1.0)]
    run = lambda name: value(spark, trees.POST_PROCESSORS[name](F.col("c")), c=(chain, kind))
    assert len(run("chop_zero_advantage_tail")) == 3 and len(run("keep_first_step_only")) == 2
    assert len(run("chop_up_to_first_negative_advantage")) == 2
    assert [n["advantage"] for n in run("negative_advantages_to_zero")] == [0.0, 0.5, 0.0, 0.0]
    assert [n["advantage"] for n in run("apply_importance_weights")] == [0.0, 1.0, -0.2, 0.0]
    assert [n["advantage"] for n in run("zero_advantages_to_epsilon")] == [0.05, 0.5, -0.2, 0.05]
    assert [n["score"] for n in run("non_last_nodes_score_to_zero")] == [0.0, 0.0, 0.0, 1.0]


def test_sampling(spark):
    df = spark.range(100).withColumn("g", F.lit(1)).withColumnRenamed("id", "k")
    assert [r["k"] for r in sampling.sample(df, "k", 5).collect()] == [r["k"] for r in sampling.sample(df.repartition(7), "k", 5).collect()]
    assert [r["k"] for r in sampling.thinned(df, ["g"], "k", 3).orderBy("k").collect()] == [0, 33, 66]
    assert value(spark, sampling.budget_prefix(F.col("c"), F.lit(10)), c=([4, 7, 5, 2, 1], "array<int>")) == [0, 2, 4]


def test_state(spark):
    edges = spark.createDataFrame([(q, q * 100 + e, e % 10) for q in range(3) for e in range(50)], "question_id int, edge_id int, iteration int")
    kept = state.replay(edges.where("iteration < 9"), edges.where("iteration = 9"), 9, 8, 32)
    assert kept.groupBy("question_id").count().where("count > 32").count() == 0 and kept.where("iteration < 2").count() == 0
    q = spark.createDataFrame([(1, "open", 0, 0), (2, "open", 0, 0), (3, "satisfied", 4, 4)], "question_id int, status string, rollouts bigint, correct bigint")
    r = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 0.0), (3, 0.0)], "question_id int, reward double")
    got = {x["question_id"]: x["status"] for x in state.sticky_step(q, r, 0.5, 1).collect()}
    assert got == {1: "satisfied", 2: "given_up", 3: "satisfied"}


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    from tracewright.streaming import windows

    events = spark.range(500).select(F.timestamp_seconds(F.col("id") * 37).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("value"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = windows.tumbling(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "10 minutes", ["k"], "value")
    query = stream.writeStream.format("memory").queryName("streamed").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = windows.tumbling(events, "10 minutes", ["k"], "value")
    assert {tuple(r) for r in spark.table("streamed").collect()} == {tuple(r) for r in batch.collect()}


def test_files(spark, tmp_path):
    from tracewright.sources import readers, writers

    raw = spark.createDataFrame([(1, "q1", "a1", "3"), (2, "q2", "a2", None)], "id int, question string, answer string, level string")
    spec = readers.SourceSpec("math", ("problem", "question"), ("answer",), extra={"level": "level", "type": "nowhere"})
    back = writers.write_prompts(spec.load(raw, "train", "id"), f"{tmp_path}/p.parquet")
    again = readers.read_prompts(spark, f"{tmp_path}/p.parquet")
    assert [r["prompt"][1]["content"] for r in again.orderBy("extra_info.index").collect()] == ["q1", "q2"] and back.count() == 2
    with pytest.raises(TypeError):
        writers.write_prompts(raw, f"{tmp_path}/x")
    (tmp_path / "r.json").write_text('{"prompt": "plain", "data_source": "x", "responses": ["a", "b"], "scores": [1.0, 0.0]}\n')
    assert readers.read_prompts(spark, f"{tmp_path}/r.json").first()["prompt"][0]["role"] == "user"
    assert [(r["response"], r["score"]) for r in readers.read_results(spark, f"{tmp_path}/r.json").collect()] == [("a", 1.0), ("b", 0.0)]
    writers.rewrite(spark, f"{tmp_path}/p.parquet", lambda df: df.limit(1))
    assert spark.read.parquet(f"{tmp_path}/p.parquet").count() == 1


def test_sentence_spans(spark):
    spans = lambda tokens, at: [tuple(x) for x in value(spark, text.sentence_spans(F.col("t"), F.lit(at)), t=(tokens, "array<string>"))]
    assert spans(["a", " b", ".", " c", " d", "?", " ", "e"], 100) == [(0, 3), (3, 6), (6, 8)]
    assert spans(["a", " b", ".", " c", " d"], 4) == [(0, 3), (3, 4), (4, 5)]
    assert spans([".", "a", "\n\n", "b"], 100) == [(0, 2), (2, 4)] or spans([".", "a", "\n\n", "b"], 100) == [(0, 3), (3, 4)]
    assert spans([], 3) == []


def test_make_24():
    from tracewright.functions.puzzles import evaluate

    assert evaluate("(1+2+3)*4") == 24 and evaluate("8/(3-8/3)") == pytest.approx(24)
    assert evaluate("1/0") is None and evaluate("__import__('os')") is None and evaluate("2**9") is None and evaluate(None) is None and evaluate("1 2") is None


def test_credit_by_name(spark):
    from tracewright.plans.credit import assign_credit

    t = signal(spark, {r: [(7 * r * p) % 11 / 3 for p in range(40)] for r in (1, 2, 3, 4)}).withColumn("nlp", F.col("entropy")).withColumn("token", F.lit("x"))
    o = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 0.1), (4, 0.0)], "response_id int, outcome double")
    for splitter in ("sliding", "threshold", "peak"):
        for reward in ("entropy_credit", "uniform", "rule"):
            rows = assign_credit(t, o, splitter, reward).collect()
            assert len(rows) == 160 and all(math.isfinite(r["token_advantage"]) for r in rows)
    hybrid = {r["response_id"]: r["token_advantage"] for r in assign_credit(t, o, advantage="hybrid").where("pos = 39").collect()}
    assert hybrid[1] > 0 > hybrid[2] and hybrid[2] == hybrid[4]
    with pytest.raises(ValueError):
        assign_credit(t, o, advantage="other")


def test_equal_phases_have_equal_entropies(spark):
    from tracewright.operators import rewards

    values = [0.1, 0.2, 0.3]
    rows = [(0, 1, k, 0, v) for k, v in enumerate(values)] + [(0, 2, k, 0, v) for k, v in reversed(list(enumerate(values)))] + [(0, 3, 0, 0, None)]
    phased = spark.createDataFrame(rows, "group_id int, response_id int, pos int, phase_id int, entropy double").coalesce(1)
    got = {r["response_id"]: r["phase_entropy"] for r in rewards.discounted_entropy(phased, 1.0).collect()}
    assert got == {1: 0.1 + 0.2 + 0.3, 2: 0.1 + 0.2 + 0.3, 3: None}

"""Queries on training metrics and the shapes that trainers read."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..operators import advantages as A
from ..operators import episodes as E
from ..operators import training as M
from .rollouts import NODES, OUTCOMES, ROLLOUTS, TOKENS, outcomes, rollouts, table, tokens, tree_nodes

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"""WITH {TOKENS}, t AS (SELECT exp(logprob + ln(1 + entropy * 0.97)) AS r, entropy / 100 - 0.2 AS a, logprob + ln(1 + entropy * 0.97) AS d FROM tok WHERE pos > 2)
SELECT round(avg(r), 6) AS mean_ratio, round(avg(greatest(-a * r, -a * least(greatest(r, 0.99), 1.01))), 6) AS policy_loss, round(avg(CASE WHEN -a * least(greatest(r, 0.99), 1.01) > -a * r THEN 1.0 ELSE 0.0 END), 6) AS clip_share, round(avg(0.5 * d * d), 8) AS approx_kl, avg(r) > 10 AS skip FROM t""")
def m7_policy_metrics(spark, sf_dir):
    t = tokens(spark, sf_dir).select("logprob", (-F.log1p(F.col("entropy") * 0.97)).alias("old_logprob"), (F.col("entropy") / 100 - 0.2).alias("advantage"), (F.col("pos") > 2).alias("mask"))
    return M.policy_metrics(t, clip=0.01).withColumns({c: F.round(c, 6) for c in ("mean_ratio", "policy_loss", "clip_share")}).withColumn("approx_kl", F.round("approx_kl", 8))


@query(f"WITH {TOKENS} SELECT response_id, pos, round(0.5 * greatest(pow(entropy / 50 - nlp, 2), pow(least(greatest(entropy / 50, 0.3), 0.7) - nlp, 2)), 6) AS loss FROM tok")
def m8_value_loss(spark, sf_dir):
    return tokens(spark, sf_dir).select("response_id", "pos", F.round(M.value_loss(F.col("entropy") / 50, F.lit(0.5), F.col("nlp")), 6).alias("loss"))


@query("""WITH p AS (SELECT -o_totalprice / 1e5 AS a, -o_totalprice / 1e5 + (o_orderkey % 7 - 3) / 2.0 AS ar, -o_totalprice / 9e4 AS r, -o_totalprice / 9e4 - (o_orderkey % 5 - 2) / 3.0 AS rr FROM (SELECT o_totalprice::DOUBLE AS o_totalprice, o_orderkey FROM orders)),
l AS (SELECT a - ar AS a, r - rr AS r, 0.1 * ((a - ar) - (r - rr) - 5 * greatest(-(a - ar), 0)) AS z FROM p)
SELECT round(avg(-(least(z, 0) - ln(1 + exp(-abs(z))))), 6) AS loss, round(avg(CASE WHEN round(a, 9) > round(r, 9) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(0.1 * a), 6) AS accept_reward, round(avg(0.1 * r), 6) AS reject_reward FROM l""")
def m10_g50_preference_metrics(spark, sf_dir):
    p, k = F.col("o_totalprice").cast("double"), F.col("o_orderkey")
    a, r = F.round((k % 7 - 3) / 2.0, 9), F.round((k % 5 - 2) / 3.0, 9)
    pairs = table(spark, sf_dir, "orders").select((-a).alias("accept"), F.lit(0.0).alias("accept_ref"), r.alias("reject"), F.lit(0.0).alias("reject_ref"), p.alias("p"))
    return rounded(M.preference_metrics(pairs), "loss", "accuracy", "accept_reward", "reject_reward")


@query(f"WITH {ROLLOUTS} SELECT problem_id, idx, round(least(greatest(score / (SELECT stddev_samp(score) FROM roll), -1.5), 1.5), 6) AS normalised FROM roll")
def m12_normalised_scores(spark, sf_dir):
    return rounded(M.normalised_scores(rollouts(spark, sf_dir), "score", 1.5).select("problem_id", "idx", "normalised"), "normalised")


@query(f"""WITH {ROLLOUTS}, p AS (SELECT problem_id, count(*) AS n, count(*) FILTER (WHERE answer = 'P') AS u, bool_or(score = 1) AS hit, count(DISTINCT answer) AS d FROM roll GROUP BY problem_id)
SELECT round(sum(u) / sum(n), 6) AS unfinished, 0.0::DOUBLE AS empty, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS once_hit, round(avg(d), 6) AS unique_responses FROM p""")
def g31_generation_metrics(spark, sf_dir):
    r = rollouts(spark, sf_dir).select(F.col("problem_id").alias("question_id"), F.col("answer").alias("response"), F.col("score").alias("reward"), (F.col("answer") != "P").alias("finished"))
    return rounded(M.generation_metrics(r), "unfinished", "empty", "once_hit", "unique_responses")


@query("""SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2))) / len(a.embedding), 6) AS mse,
  round(list_max(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS largest,
  round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def g49_reconstruction_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    out = e.join(b, "vec_id").select("vec_id", M.reconstruction(F.col("x"), F.col("y")).alias("r")).select("vec_id", "r.*")
    return rounded(out, "mse", "largest", "cosine")


@query(f"""WITH {TOKENS}, {OUTCOMES} SELECT outcome >= 1 AS correct, count(*) AS n, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std, round(median(m), 6) AS median
FROM (SELECT response_id, avg(entropy) AS m FROM tok GROUP BY response_id) JOIN outc USING (response_id) GROUP BY correct""")
def g40_features_by_outcome(spark, sf_dir):
    f = tokens(spark, sf_dir).groupBy("response_id").agg(F.avg("entropy").alias("m")).join(outcomes(spark, sf_dir), "response_id")
    out = f.groupBy((F.col("outcome") >= 1).alias("correct")).agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"), F.median("m").alias("median"))
    return rounded(out, "mean", "std", "median")


@query(f"""WITH {TOKENS}, {OUTCOMES}, p AS (SELECT response_id, avg(entropy) / 100 AS predicted FROM tok GROUP BY response_id) SELECT round(avg(pow(outcome - predicted, 2)), 6) AS mse FROM p JOIN outc USING (response_id)""")
def g45_g52_value_error(spark, sf_dir):
    p = tokens(spark, sf_dir).groupBy("response_id").agg((F.avg("entropy") / 100).alias("predicted")).join(outcomes(spark, sf_dir), "response_id")
    return p.agg(F.round(F.avg(F.pow(F.col("outcome") - F.col("predicted"), F.lit(2.0))), 6).alias("mse"))


@query(f"WITH {TOKENS}, {OUTCOMES}, a AS (SELECT response_id, (outcome - avg(outcome) OVER (PARTITION BY group_id)) AS adv FROM outc) SELECT t.response_id, pos, round(adv * nlp / greatest(sum(nlp) OVER (PARTITION BY t.response_id), 1e-8), 8) AS advantage FROM tok t JOIN a USING (response_id)")
def w15_w24_weighted_token_advantages(spark, sf_dir):
    a = outcomes(spark, sf_dir).select("response_id", (F.col("outcome") - F.avg("outcome").over(W.partitionBy("group_id"))).alias("adv"))
    t = A.token_weights(tokens(spark, sf_dir)).join(a, "response_id")
    return t.select("response_id", "pos", F.round(F.col("adv") * F.col("weight"), 8).alias("advantage"))


@query(f"WITH {TOKENS} SELECT response_id, pos, round((pos + 1) / count(*) OVER (PARTITION BY response_id), 6) AS relative FROM tok QUALIFY count(*) OVER (PARTITION BY response_id) > 2")
def w23_relative_steps(spark, sf_dir):
    n = F.count("*").over(W.partitionBy("response_id"))
    return tokens(spark, sf_dir).withColumn("n", n).where("n > 2").select("response_id", "pos", F.round((F.col("pos") + 1) / F.col("n"), 6).alias("relative"))


@query(f"WITH {TOKENS}, m AS (SELECT response_id, min(entropy) AS lo, max(entropy) AS hi FROM tok GROUP BY response_id) SELECT response_id, pos, round(CASE WHEN hi > lo THEN (entropy - lo) / (hi - lo) ELSE 0.0 END, 6) AS scaled FROM tok JOIN m USING (response_id)")
def m23_min_max_scaled(spark, sf_dir):
    return tokens(spark, sf_dir).select("response_id", "pos", F.round(M.min_max(F.col("entropy"), ["response_id"]), 6).alias("scaled"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 >= 3 THEN 2 WHEN c_custkey % 5 >= 1 THEN 4 ELSE 6 END AS factor FROM customer")
def a13_branch_factors(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", M.branch_factor([(0, 6), (1, 4), (3, 2)], F.col("c_custkey") % 5).alias("factor"))


@query("""WITH n AS (SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS n FROM documents), c AS (SELECT source, doc_id, CAST(unnest(range(0, CAST(ceil(70 / n) AS BIGINT))) AS INTEGER) AS copy FROM n)
SELECT source, doc_id, copy FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY copy, md5('42:' || copy || ':' || doc_id)) AS r FROM c) WHERE r <= 70""")
def p30_filled_to_target(spark, sf_dir):
    return M.filled(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", 70).select("source", "doc_id", "copy")


@query(f"""WITH {NODES}, up AS (SELECT tree_id, node_id, node_id AS ancestor_id, 0 AS distance FROM nodes UNION ALL
  SELECT c.tree_id, c.node_id, p.node_id, 1 FROM nodes c JOIN nodes p ON p.tree_id = c.tree_id AND p.node_id = c.parent_id UNION ALL
  SELECT c.tree_id, c.node_id, g.node_id, 2 FROM nodes c JOIN nodes p ON p.tree_id = c.tree_id AND p.node_id = c.parent_id JOIN nodes g ON g.tree_id = p.tree_id AND g.node_id = p.parent_id UNION ALL
  SELECT c.tree_id, c.node_id, h.node_id, 3 FROM nodes c JOIN nodes p ON p.tree_id = c.tree_id AND p.node_id = c.parent_id JOIN nodes g ON g.tree_id = p.tree_id AND g.node_id = p.parent_id JOIN nodes h ON h.tree_id = g.tree_id AND h.node_id = g.parent_id)
SELECT tree_id, node_id, ancestor_id, distance FROM up""")
def a5_ancestor_closure(spark, sf_dir):
    return M.ancestors(tree_nodes(spark, sf_dir), 3)


@query(f"""WITH {ROLLOUTS} SELECT problem_id, string_agg(DISTINCT answer, ',' ORDER BY answer) AS alternatives FROM roll GROUP BY problem_id HAVING count(DISTINCT answer) > 1""")
def a24_alternative_actions(spark, sf_dir):
    r = rollouts(spark, sf_dir).groupBy("problem_id").agg(F.sort_array(F.collect_set("answer")).alias("x")).where(F.size("x") > 1)
    return r.select("problem_id", F.array_join("x", ",").alias("alternatives"))


@query("""WITH w AS (SELECT doc_id, regexp_split_to_array(text, ' ') AS w FROM documents)
SELECT doc_id, array_to_string(list_concat(w[1:20], list_transform(range(greatest(20 - len(w), 0)), lambda i: '<pad>')), ' ') AS padded, len(w) + 5 <= 400 AS fits FROM w""")
def a16_p23_p34_padded_and_fitting(spark, sf_dir):
    w = F.split("text", " ")
    query_ids = F.array(*[F.lit("q")] * 5)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(E.padded(w, 20, "<pad>"), " ").alias("padded"), E.fits(query_ids, w, 400).alias("fits"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 1000)::VARCHAR WHEN o_orderkey % 3 = 1 THEN (o_orderkey % 1000)::VARCHAR END AS answer, o_orderkey % 3 < 2 AS equal FROM orders")
def t17_t18_gsm8k_answers(spark, sf_dir):
    k = F.col("o_orderkey")
    v = (k % 1000).cast("string")
    solution = F.when(k % 3 == 0, F.concat(F.lit("1 + 2 #### 5 #### "), v)).when(k % 3 == 1, F.concat(F.lit("first 12, then "), v)).otherwise("no digits")
    answer = X.gsm8k_answer(solution)
    return table(spark, sf_dir, "orders").select("o_orderkey", answer.alias("answer"), X.gsm8k_equal(answer, v).alias("equal"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey::VARCHAR END AS answer FROM orders")
def t20_answers_under_heading(spark, sf_dir):
    k = F.col("o_orderkey")
    s = F.when(k % 3 == 0, F.concat(F.lit("steps\n# Answer\n "), k.cast("string"), F.lit("\n"))).when(k % 3 == 1, "none").otherwise("# Answer\n1\n# Answer\n2")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.answer_after_heading(s).alias("answer"))

"""Queries on evaluation metrics and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths
from ..operators import metrics as M
from .rollouts import ROLLOUTS, TOKENS, rollouts, table, tokens

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


_KS = (1, 2, 4)


def _pass_sql(k: int, unbiased: bool) -> str:
    rule = f"n - c < {k}" if unbiased else f"c >= {k} OR n - c < {k}"
    return f"CASE WHEN {rule} THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - {k}.0 / i)) END"


_PROBLEMS = f"WITH {ROLLOUTS}, p AS (SELECT problem_id, count(*) AS n, count(*) FILTER (WHERE score > 0.5) AS c, avg(score) AS m FROM roll GROUP BY problem_id)"


@query(f"""{_PROBLEMS} SELECT count(*) AS n_problems, round(avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(m), 6) AS avg_at_n, round(avg(CASE WHEN c > n / 2 THEN 1.0 ELSE 0.0 END), 6) AS maj_at_n,
""" + ", ".join(f"round(avg(CASE WHEN n >= {k} THEN {_pass_sql(k, u)} END), 6) AS pass_at_{k}{'_unbiased' * u}" for k in _KS for u in (False, True)) + " FROM p")
def eval_metrics(spark, sf_dir):
    p = M.per_problem(rollouts(spark, sf_dir))
    out = M.evaluation(p, _KS)
    return rounded(out, *[c for c in out.columns if c != "n_problems"])


@query(f"{_PROBLEMS} SELECT problem_id, n, c AS n_correct, round({_pass_sql(2, False)}, 6) AS pass_at_2, round({_pass_sql(2, True)}, 6) AS pass_at_2_unbiased FROM p")
def g3_pass_at_k_by_problem(spark, sf_dir):
    p = M.per_problem(rollouts(spark, sf_dir))
    n, c = F.col("n"), F.col("n_correct")
    return p.select("problem_id", "n", "n_correct", F.round(maths.pass_at_k(n, c, 2), 6).alias("pass_at_2"), F.round(maths.pass_at_k(n, c, 2, True), 6).alias("pass_at_2_unbiased"))


@query(f"""WITH {ROLLOUTS}, a AS (SELECT problem_id, idx, CASE WHEN idx % 7 = 0 THEN NULL WHEN idx % 11 = 0 THEN '' ELSE answer END AS answer, score > 0.5 AS ok FROM roll),
v AS (SELECT problem_id, answer, count(*) AS n, min(idx) AS first, arg_min(ok, idx) AS ok1, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS hits FROM a GROUP BY problem_id, answer),
r AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY n DESC, first) AS r FROM v)
SELECT problem_id, CAST(max(CASE WHEN hits > 0 THEN 1 ELSE 0 END) AS INTEGER) AS once_hit, round(sum(hits) / sum(n), 6) AS correct_frac, CAST(max(CASE WHEN r = 1 AND ok1 THEN 1 ELSE 0 END) AS INTEGER) AS majority_correct,
  count(*) AS unique_answers, round(sum(CASE WHEN answer IS NULL OR answer = '' THEN n ELSE 0 END) / sum(n), 6) AS none_frac FROM r GROUP BY problem_id""")
def g6_g10_answer_votes(spark, sf_dir):
    i = F.col("idx")
    a = rollouts(spark, sf_dir).select("problem_id", "idx", F.when(i % 7 == 0, None).when(i % 11 == 0, "").otherwise(F.col("answer")).alias("answer"), (F.col("score") > 0.5).alias("correct"))
    return rounded(M.answer_votes(a), "correct_frac", "none_frac")


@query("""WITH c AS (SELECT source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source), b AS (SELECT *, row_number() OVER (ORDER BY n DESC, first) AS r FROM c),
t AS (SELECT source, n FROM b WHERE r <= 5 UNION ALL SELECT 'others', sum(n) FROM b WHERE r > 5 HAVING sum(n) IS NOT NULL)
SELECT source, CAST(n AS BIGINT) AS n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM t""")
def g11_frequency_table(spark, sf_dir):
    return rounded(M.frequency_table(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 5), "percent")


@query("""SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents WHERE lang <> '' GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source <> '' GROUP BY source""")
def g12_profile(spark, sf_dir):
    return M.profile(table(spark, sf_dir, "documents"), ["lang", "source"])


_QS = ", ".join(f"round(quantile_cont({{x}}, {p / 100}), 6) AS p{p}" for p in (5, 25, 50, 75, 95))


@query(f"WITH {TOKENS} SELECT response_id, count(entropy) AS n, round(avg(entropy), 6) AS mean, round(stddev_pop(entropy), 6) AS std, min(entropy) AS low, max(entropy) AS high, {_QS.format(x='entropy')} FROM tok GROUP BY response_id")
def g37_token_summary(spark, sf_dir):
    return rounded(M.summary(tokens(spark, sf_dir), ["response_id"], "entropy"), "mean", "std", "p5", "p25", "p50", "p75", "p95")


@query(f"WITH {TOKENS} SELECT pos, count(entropy) AS n, round(avg(entropy), 6) AS mean, round(stddev_pop(entropy), 6) AS std, min(entropy) AS low, max(entropy) AS high, {_QS.format(x='entropy')} FROM tok GROUP BY pos")
def g39_position_summary(spark, sf_dir):
    return rounded(M.summary(tokens(spark, sf_dir), ["pos"], "entropy"), "mean", "std", "p5", "p25", "p50", "p75", "p95")


_XS = ("l_quantity", "l_extendedprice", "l_discount")


@query(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(covar_samp({a}, {b}), 4) AS covariance, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for i, a in enumerate(_XS) for b in _XS[i:]))
def g38_g41_moment_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in _XS])
    return M.moments(rows, list(_XS)).select("x", "y", F.round("covariance", 4).alias("covariance"), F.round("correlation", 6).alias("correlation"))


@query("""WITH s AS (SELECT avg(l_quantity) FILTER (WHERE r) - avg(l_quantity) FILTER (WHERE NOT r) AS d, var_samp(l_quantity) FILTER (WHERE r) / count(*) FILTER (WHERE r) AS a, var_samp(l_quantity) FILTER (WHERE NOT r) / count(*) FILTER (WHERE NOT r) AS b,
  count(*) FILTER (WHERE r) AS n, count(*) FILTER (WHERE NOT r) AS m FROM (SELECT l_quantity::DOUBLE AS l_quantity, l_returnflag = 'R' AS r FROM lineitem))
SELECT round(d / sqrt(a + b), 6) AS t, round((a + b) * (a + b) / (a * a / (n - 1) + b * b / (m - 1)), 3) AS df FROM s""")
def g42_welch_test(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").alias("r"), F.col("l_quantity").cast("double").alias("q"))
    return M.welch(rows, "r", "q").select(F.round("t", 6).alias("t"), F.round("df", 3).alias("df"))


@query("""SELECT a.o_custkey AS problem_id, count(*) AS pairs, round(avg(CASE WHEN (a.o_totalprice - b.o_totalprice) * (a.x - b.x) > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM (SELECT *, o_orderkey % 97 AS x FROM orders) a JOIN (SELECT *, o_orderkey % 97 AS x FROM orders) b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey GROUP BY a.o_custkey""")
def g44_j10_ranking_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("problem_id"), "o_orderkey", F.col("o_totalprice").cast("double").alias("truth"), (F.col("o_orderkey") % 97).alias("predicted"))
    return rounded(M.ranking_accuracy(rows, ["problem_id"], "truth", "predicted"), "accuracy")


@query(f"WITH {TOKENS} SELECT round(avg(s), 4) AS mean FROM (SELECT sum(nlp) AS s FROM tok GROUP BY response_id)")
def g47_sequence_mean(spark, sf_dir):
    return rounded(M.two_level_mean(tokens(spark, sf_dir), ["response_id"], "nlp"), "mean", digits=4)


@query(f"""WITH {TOKENS}, m AS (SELECT avg(entropy) AS m, var_samp(entropy) AS v FROM tok WHERE pos > 5) SELECT response_id, pos, round((entropy - m) / sqrt(v + 1e-8), 6) AS whitened FROM tok, m""")
def g32_whitened(spark, sf_dir):
    return rounded(M.whitened(tokens(spark, sf_dir), "entropy", F.col("pos") > 5).select("response_id", "pos", "whitened"), "whitened")


@query(f"""WITH {TOKENS}, s AS (SELECT avg(entropy) AS m, stddev_pop(entropy) AS d FROM tok) SELECT CAST(0 AS BIGINT) AS n_nan, CAST(0 AS BIGINT) AS n_inf, count(*) FILTER (WHERE abs(entropy - m) > 3 * d) AS n_far, round(100 * avg(CASE WHEN abs(entropy) < 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS zero_percent FROM tok, s""")
def g35_g36_anomalies(spark, sf_dir):
    return rounded(M.anomalies(tokens(spark, sf_dir), "entropy"), "zero_percent")


@query(f"""WITH {TOKENS}, q AS (SELECT response_id, pos, logprob AS p, -ln(1 + entropy * 0.9) AS r FROM tok)
SELECT response_id, pos, round(p - r, 6) AS kl, round(abs(p - r), 6) AS abs_kl, round(0.5 * (p - r) * (p - r), 6) AS mse, round(exp(greatest(-10, least(10, r - p))) - 1 - greatest(-10, least(10, r - p)), 6) AS control_variate FROM q""")
def m6_divergences(spark, sf_dir):
    p, r = F.col("logprob"), -F.log1p(F.col("entropy") * 0.9)
    kinds = {"kl": "kl", "abs": "abs_kl", "mse": "mse", "control_variate": "control_variate"}
    return tokens(spark, sf_dir).select("response_id", "pos", *[F.round(maths.kl(k, p, r), 6).alias(v) for k, v in kinds.items()])


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
z AS (SELECT vec_id, x, list_max(x) AS top FROM e), l AS (SELECT vec_id, x, top + ln(list_sum(list_transform(x, lambda v: exp(v - top)))) AS lse FROM z)
SELECT vec_id, round(-list_sum(list_transform(x, lambda v: exp(v - lse) * (v - lse))), 6) AS entropy FROM l""")
def m2_m4_entropy_from_logits(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(maths.entropy(F.col("embedding").cast("array<double>")), 6).alias("entropy"))


@query("""WITH e AS (SELECT vec_id, list_sort(list_transform(embedding, lambda x: -ln(10 + x::DOUBLE * x)), 'DESC')[1:5] AS lp FROM embeddings), s AS (SELECT vec_id, -list_sum(list_transform(lp, lambda v: exp(v) * v)) AS h, 1 - list_sum(list_transform(lp, lambda v: exp(v))) AS rest FROM e)
SELECT vec_id, round(h + CASE WHEN rest > 1e-10 THEN -rest * ln(rest) ELSE 0 END, 6) AS entropy FROM s""")
def m3_top_k_entropy(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    lp = F.slice(F.sort_array(F.transform(F.col("embedding").cast("array<double>"), lambda x: -F.log(10 + x * x)), asc=False), 1, 5)
    return e.select("vec_id", F.round(maths.top_k_entropy(lp), 6).alias("entropy"))


@query("SELECT doc_id, round(least(-(n_chars - (4000 - 500)) / 500.0 * 1.5, 0), 6) AS penalty, round(1 - pow(1 - (n_chars % 10) / 10.0, 4), 6) AS best_of_4 FROM documents")
def m18_m19_penalty_and_best_of_k(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(maths.overlong_penalty(n, 4000, 500, 1.5), 6).alias("penalty"), F.round(maths.best_of_k((n % 10) / 10.0), 6).alias("best_of_4"))


@query(f"""{_PROBLEMS} SELECT problem_id, round(m, 6) AS value, round(2 * 1.96 * sqrt(m * (1 - m) / n), 6) AS ci_length FROM p""")
def g25_g27_monte_carlo_values(spark, sf_dir):
    p = M.per_problem(rollouts(spark, sf_dir))
    return p.select("problem_id", F.round("mean_score", 6).alias("value"), F.round(maths.confidence_length(F.col("mean_score"), F.col("n")), 6).alias("ci_length"))


@query("SELECT round(sqrt(sum(d * d)), 4) AS distance FROM (SELECT unnest(a.embedding)::DOUBLE - unnest(b.embedding)::DOUBLE AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def g48_l2_distance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    d = F.aggregate(F.zip_with("embedding", "other", lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v)
    return e.join(b, "vec_id").agg(F.round(F.sqrt(F.sum(d)), 4).alias("distance"))

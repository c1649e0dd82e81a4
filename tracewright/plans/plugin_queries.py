"""Queries on jobs put together by names: credit, rewards, judges, selectors and path strategies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import plugins
from ..operators import trees as T
from ..operators.grading import graded_by
from ..sources import writers
from . import credit, phase_queries, text_queries, tree_queries
from .rollouts import OUTCOMES, TOKENS, outcomes, table, tokens

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PHASES = phase_queries._PHASES
_REWARD = _PHASES[_PHASES.index("rew AS (") : _PHASES.index("loc AS (")]
_HEAD = "rew AS (SELECT group_id, response_id, phase_id, phase_entropy, outcome, "
#: Rewards by name, as DuckDB computes them.
_REWARDS = {
    "entropy_credit": _REWARD,
    "uniform": _HEAD + "outcome / n AS phase_reward FROM raw),\n",
    "rule": _HEAD + "CASE WHEN phase_id = n - 1 THEN outcome ELSE 0.5 END AS phase_reward FROM raw),\n",
}
_ADVANTAGES = ("phase", "hybrid")
_ROUTES = """rt AS (SELECT response_id, bool_or(outcome >= 1) OVER g AS right_, (outcome - avg(outcome) OVER g) / (coalesce(stddev_samp(outcome) OVER g, 0) + 1e-10) AS z
  FROM (SELECT DISTINCT t.group_id, t.response_id, outcome FROM tok t JOIN outc USING (response_id)) WINDOW g AS (PARTITION BY group_id))"""


def _credit_sql(reward: str, advantage: str) -> str:
    token = "coalesce((a.advantage / 3 + a.advantage / 2 * pow(0.9, row_number() OVER (PARTITION BY p.response_id, p.phase_id ORDER BY p.pos) - 1)) / m.m, 0.0)"
    value = token if advantage == "phase" else f"CASE WHEN right_ THEN z ELSE {token} END"
    return f"""SELECT * FROM (WITH RECURSIVE {TOKENS}, {OUTCOMES}, {_PHASES.replace(_REWARD, _REWARDS[reward])}, m AS (SELECT response_id, count(*) AS m FROM adv GROUP BY response_id), {_ROUTES}
SELECT '{reward}' AS reward, '{advantage}' AS advantage, p.response_id, p.pos, round({value}, 4) AS token_advantage
FROM phased p LEFT JOIN adv a ON a.response_id = p.response_id AND a.phase_id = p.phase_id LEFT JOIN m ON m.response_id = p.response_id JOIN rt ON rt.response_id = p.response_id)"""


@query(" UNION ALL ".join(_credit_sql(r, a) for r in _REWARDS for a in _ADVANTAGES))
def f3_f6_credit_by_name(spark, sf_dir):
    """Token advantages of every phase reward with every advantage, the splitter by name and options."""
    t, o = tokens(spark, sf_dir), outcomes(spark, sf_dir)
    options = {"width": phase_queries.WIDTH, "percentile": phase_queries.PERCENTILE, "min_gap": phase_queries.GAP, "most": phase_queries.MOST}
    each = [
        credit.assign_credit(t, o, "sliding", r, a, splitter_options=options).select(F.lit(r).alias("reward"), F.lit(a).alias("advantage"), "response_id", "pos", F.round("token_advantage", 4).alias("token_advantage"))
        for r in _REWARDS for a in _ADVANTAGES
    ]
    return reduce(DataFrame.unionByName, each)


@query(f"""WITH {text_queries._GRADED} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <> 3 THEN 1.0::DOUBLE WHEN k IN (0, 2, 4, 5) THEN 0.1 ELSE 0.0 END AS gsm8k, CASE WHEN l_linenumber <> 3 THEN 1.0::DOUBLE ELSE 0.0 END AS math, 0.5::DOUBLE AS offline,
  round(l_linenumber / 10.0, 6)::DOUBLE AS judged FROM g""")
def f1_f7_f11_rewards_by_name(spark, sf_dir):
    """Rewards and judges looked up by name."""
    g = text_queries.graded(spark, sf_dir)
    score = lambda name, s, gold: plugins.named("reward", name)(s, gold).alias(name)
    judge = lambda name, said: F.round(plugins.named("judge", name)(said), 6)
    grade = lambda s, gold, said: F.struct(score("gsm8k", s, gold), score("math", s, gold), judge("offline", said).alias("offline"), judge("reply", said).alias("judged"))
    g = g.withColumn("said", F.concat(F.lit('{"score": '), (F.col("l_linenumber") / 10).cast("string"), F.lit("}")))
    return graded_by(g, ["solution", "gold", "said"], grade).select("l_orderkey", "l_linenumber", "l_partkey", "verdict.*")


_CONDITIONS = {
    "none": "true", "successful": "last_score = 1", "non_zero_score": "second_score <> 0", "non_zero_last_step_score": "last_score <> 0", "zero_last_step_score": "last_score = 0", "non_zero_last_step_advantage": "last_advantage > 0",
}


@query(
    f"WITH {tree_queries._PATHS.removeprefix('WITH ')}, pc AS (SELECT tree_id, leaf_id, sum(greatest(advantage * weight, 0)) AS s FROM anc GROUP BY ALL) "
    + " UNION ALL ".join(f"SELECT '{name}' AS filter, count(*) AS n, round(coalesce(sum(s), 0.0), 3) AS total FROM chain JOIN pc USING (tree_id, leaf_id) WHERE n > 1 AND {c}" for name, c in _CONDITIONS.items())
)
def a12_f10_strategies(spark, sf_dir):
    """Every path filter by name, followed by two post-processors in a row, and what is left."""
    assert set(_CONDITIONS) == set(plugins.KINDS["path_filter"])
    post, folder = ["apply_importance_weights", "negative_advantages_to_zero"], writers.scratch(spark, "paths")
    tree_queries._paths(spark, sf_dir).write.parquet(folder)
    rows = spark.read.parquet(folder)
    total = F.aggregate("chain", F.lit(0.0), lambda s, n: s + n["advantage"])
    each = [T.episodes_from_paths(rows, [name], post).agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum(total), F.lit(0.0)), 3).alias("total")).select(F.lit(name).alias("filter"), "n", "total") for name in _CONDITIONS]
    return reduce(DataFrame.unionByName, each)


@query("""WITH r AS (SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50), c AS (SELECT doc_id, n_chars % 7 + 1 AS a, n_chars % 5 + 1 AS b, n_chars % 3 + 1 AS c, doc_id IN (SELECT doc_id FROM r) AS sampled FROM documents),
u AS (SELECT *, CASE WHEN a + b <= 8 THEN a + b ELSE a END AS u FROM c) SELECT doc_id, sampled, concat_ws(',', '0', CASE WHEN a + b <= 8 THEN '1' END, CASE WHEN u + c <= 8 THEN '2' END) AS kept FROM u""")
def f13_selectors_by_name(spark, sf_dir):
    """A seeded sample and the items that fit a budget, by name."""
    d = table(spark, sf_dir, "documents")
    chosen = plugins.named("selector", "random")(d.select("doc_id"), "doc_id", 50).select("doc_id", F.lit(True).alias("sampled"))
    costs = F.array(*[F.col("n_chars") % k + 1 for k in (7, 5, 3)]).cast("array<bigint>")
    kept = F.array_join(plugins.named("selector", "budget")(costs, F.lit(8)), ",")
    return d.join(chosen, "doc_id", "left").select("doc_id", F.coalesce("sampled", F.lit(False)).alias("sampled"), kept.alias("kept"))

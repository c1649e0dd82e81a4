"""Queries on trees, paths and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.maths import best_of_k, importance_weight
from ..operators import trees as T
from .rollouts import NODES, tree_nodes

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _valued(spark, sf_dir):
    return T.fold_means(tree_nodes(spark, sf_dir), F.col("score"), 3)


@query(f"WITH {NODES} SELECT v.tree_id, v.node_id, round(value, 6) AS value, round(value_std, 6) AS value_std FROM vals v JOIN nodes USING (tree_id, node_id) WHERE depth < 3")
def g28_g29_tree_fold(spark, sf_dir):
    return _valued(spark, sf_dir).where("depth < 3").select("tree_id", "node_id", F.round("value", 6).alias("value"), F.round("value_std", 6).alias("value_std"))


_EDGES = f"""WITH {NODES}, ed AS (SELECT n.tree_id, n.node_id, n.parent_id, n.depth, v.value, p.value AS parent_value, v.value - p.value AS advantage, (1 - pow(1 - v.value, 4)) - (1 - pow(1 - p.value, 4)) AS prover
  FROM nodes n JOIN vals v ON v.tree_id = n.tree_id AND v.node_id = n.node_id JOIN vals p ON p.tree_id = n.tree_id AND p.node_id = n.parent_id)"""


@query(f"{_EDGES} SELECT tree_id, node_id, round(advantage, 6) AS advantage FROM ed")
def a6_j9_tree_advantages(spark, sf_dir):
    return T.edges(_valued(spark, sf_dir)).select("tree_id", "node_id", F.round("advantage", 6).alias("advantage"))


@query(f"{_EDGES} SELECT tree_id, node_id, round(advantage, 6) AS advantage, round(prover, 6) AS prover_advantage, round(parent_value + 5 * prover, 6) AS blended FROM ed WHERE advantage + prover <> 0")
def a7_m19_m20_prover_edges(spark, sf_dir):
    out = T.prover_edges(_valued(spark, sf_dir))
    blended = F.col("parent_value") + 5 * F.col("prover_advantage")
    return out.select("tree_id", "node_id", F.round("advantage", 6).alias("advantage"), F.round("prover_advantage", 6).alias("prover_advantage"), F.round(blended, 6).alias("blended"))


def _paths(spark, sf_dir):
    valued = _valued(spark, sf_dir)
    parent = valued.select("tree_id", F.col("node_id").alias("parent_id"), F.col("value").alias("pv"))
    rows = valued.join(parent, ["tree_id", "parent_id"], "left").select(
        "tree_id", "node_id", "parent_id", "depth", F.col("value").alias("score"), F.coalesce(F.col("value") - F.col("pv"), F.lit(0.0)).alias("advantage"),
        importance_weight(F.col("depth"), F.lit(3), 2).alias("weight"),
    )
    return T.paths(rows, 3, ["node_id", "score", "advantage", "weight"])


_PATHS = f"""{_EDGES},
al AS (SELECT n.tree_id, n.node_id, n.parent_id, n.depth, v.value AS score, coalesce(e.advantage, 0.0) AS advantage, greatest(pow(2, 3 - n.depth), 1) AS weight FROM nodes n JOIN vals v ON v.tree_id = n.tree_id AND v.node_id = n.node_id LEFT JOIN ed e ON e.tree_id = n.tree_id AND e.node_id = n.node_id),
lf AS (SELECT * FROM al x WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.tree_id = x.tree_id AND c.parent_id = x.node_id)),
anc AS (
  SELECT l.tree_id, l.node_id AS leaf_id, l.depth AS leaf_depth, a.* EXCLUDE (tree_id) FROM lf l JOIN al a ON a.tree_id = l.tree_id AND a.node_id = l.node_id
  UNION ALL SELECT l.tree_id, l.node_id, l.depth, a.* EXCLUDE (tree_id) FROM lf l JOIN al a ON a.tree_id = l.tree_id AND a.node_id = l.parent_id
  UNION ALL SELECT l.tree_id, l.node_id, l.depth, b.* EXCLUDE (tree_id) FROM lf l JOIN al a ON a.tree_id = l.tree_id AND a.node_id = l.parent_id JOIN al b ON b.tree_id = l.tree_id AND b.node_id = a.parent_id
  UNION ALL SELECT l.tree_id, l.node_id, l.depth, c.* EXCLUDE (tree_id) FROM lf l JOIN al a ON a.tree_id = l.tree_id AND a.node_id = l.parent_id JOIN al b ON b.tree_id = l.tree_id AND b.node_id = a.parent_id JOIN al c ON c.tree_id = l.tree_id AND c.node_id = b.parent_id),
chain AS (SELECT tree_id, leaf_id, string_agg(node_id, '>' ORDER BY depth) AS path, count(*) AS n, sum(advantage) AS total, sum(advantage * weight) AS weighted,
  max(CASE WHEN depth = leaf_depth THEN advantage END) AS last_advantage, max(CASE WHEN depth = 1 THEN score END) AS second_score, max(CASE WHEN depth = leaf_depth THEN score END) AS last_score FROM anc GROUP BY ALL)"""


@query(f"{_PATHS} SELECT tree_id, leaf_id, path, n FROM chain")
def a4_root_to_leaf_paths(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return p.select("tree_id", "leaf_id", F.array_join(F.transform("chain", lambda n: n["node_id"]), ">").alias("path"), F.size("chain").cast("long").alias("n"))


@query(f"{_PATHS} SELECT 'successful' AS filter, count(*) FILTER (WHERE last_score = 1) AS n FROM chain UNION ALL SELECT 'non_zero_score', count(*) FILTER (WHERE second_score <> 0) FROM chain UNION ALL SELECT 'non_zero_last_step_score', count(*) FILTER (WHERE last_score <> 0) FROM chain UNION ALL SELECT 'zero_last_step_score', count(*) FILTER (WHERE last_score = 0) FROM chain UNION ALL SELECT 'non_zero_last_step_advantage', count(*) FILTER (WHERE last_advantage > 0) FROM chain UNION ALL SELECT 'none', count(*) FROM chain")
def a9_path_filters(spark, sf_dir):
    p = _paths(spark, sf_dir)
    counts = p.agg(*[F.count_if(F.coalesce(f(F.col("chain")), F.lit(False))).alias(name) for name, f in T.FILTERS.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("filter"), F.col(n).alias("n")) for n in T.FILTERS])))


@query(f"""{_PATHS},
fn AS (SELECT tree_id, leaf_id, coalesce(min(CASE WHEN depth >= 1 AND advantage < 0 THEN depth END), any_value(leaf_depth) + 1) AS cut, coalesce(max(CASE WHEN depth >= 1 AND abs(advantage) >= 1e-6 THEN depth END), 0) AS tail FROM anc GROUP BY ALL)
SELECT c.tree_id, c.leaf_id, CAST(tail + 1 AS BIGINT) AS chopped_tail, CAST(least(n, 2) AS BIGINT) AS first_step, CAST(CASE WHEN n > 1 THEN cut ELSE n END AS BIGINT) AS to_first_negative, round(weighted, 6) AS weighted,
  round((SELECT sum(greatest(advantage, 0)) FROM anc a WHERE a.tree_id = c.tree_id AND a.leaf_id = c.leaf_id), 6) AS non_negative FROM chain c JOIN fn USING (tree_id, leaf_id)""")
def a10_path_post_processors(spark, sf_dir):
    c = F.col("chain")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, n: s + n["advantage"])
    post = T.POST_PROCESSORS
    size = lambda name: F.size(post[name](c)).cast("long")
    return _paths(spark, sf_dir).select(
        "tree_id", "leaf_id", size("chop_zero_advantage_tail").alias("chopped_tail"), size("keep_first_step_only").alias("first_step"),
        size("chop_up_to_first_negative_advantage").alias("to_first_negative"), F.round(total(post["apply_importance_weights"](c)), 6).alias("weighted"),
        F.round(total(post["negative_advantages_to_zero"](c)), 6).alias("non_negative"),
    )


@query(f"""{_PATHS}, ok AS (SELECT *, total / n AS mean FROM chain WHERE last_score <> 0 AND n > 1), rk AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY round(mean, 9) DESC, leaf_id) AS r, count(*) OVER (PARTITION BY tree_id) AS m FROM ok)
SELECT tree_id, leaf_id FROM rk WHERE r <= greatest(floor(m * 0.2), 1)""")
def a11_o2_top_percent_paths(spark, sf_dir):
    p = _paths(spark, sf_dir).withColumn("chain", F.transform("chain", lambda n: n))
    p = p.where(T.FILTERS["non_zero_last_step_score"](F.col("chain"))).where(F.size("chain") > 1)
    mean = F.round(F.aggregate("chain", F.lit(0.0), lambda s, n: s + n["advantage"]) / F.size("chain"), 9)
    p = p.select("tree_id", "leaf_id", F.array(F.struct(mean.alias("advantage"))).alias("chain"))
    return T.top_percent(p, "chain", 0.2).select("tree_id", "leaf_id")


@query(f"{_PATHS} SELECT tree_id, leaf_id, round(total, 6) AS total, round(last_score, 6) AS last_score FROM chain WHERE n > 1")
def a8_path_sums(spark, sf_dir):
    total = F.aggregate("chain", F.lit(0.0), lambda s, n: s + n["advantage"])
    return T.episodes_from_paths(_paths(spark, sf_dir)).select("tree_id", "leaf_id", F.round(total, 6).alias("total"), F.round(F.element_at("chain", -1)["score"], 6).alias("last_score"))


@query("SELECT n_nationkey, round(greatest(pow(6, 3 - n_regionkey), 1), 6) AS weight, round(1 - pow(1 - n_nationkey / 25.0, 4), 6) AS best_of_4 FROM nation")
def m22_importance_weights(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select("n_nationkey", F.round(importance_weight(F.col("n_regionkey"), F.lit(3), 6), 6).alias("weight"), F.round(best_of_k(F.col("n_nationkey") / 25.0), 6).alias("best_of_4"))

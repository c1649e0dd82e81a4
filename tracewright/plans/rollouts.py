"""Rollout frames derived from the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tokens: a user is a response, ten groups, value is the entropy."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    pos = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")
    return e.select(
        (F.col("user_id") % 10).alias("group_id"), F.col("user_id").alias("response_id"), pos.alias("pos"), F.col("value").alias("entropy"),
        (-F.log1p("value")).alias("logprob"), F.log1p("value").alias("nlp"), F.col("event_type").alias("token"),
    )


TOKENS = """tok AS (
  SELECT user_id % 10 AS group_id, user_id AS response_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos,
    value AS entropy, -ln(1 + value) AS logprob, ln(1 + value) AS nlp, event_type AS token FROM events)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per response: right, partial or wrong by its number of purchases."""
    n = F.count_if(F.col("event_type") == "purchase") % 3
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    return e.groupBy((F.col("user_id") % 10).alias("group_id"), F.col("user_id").alias("response_id")).agg(F.when(n == 0, 1.0).when(n == 1, 0.1).otherwise(0.0).alias("outcome"))


OUTCOMES = """outc AS (
  SELECT user_id % 10 AS group_id, user_id AS response_id,
    CASE sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS outcome
  FROM events GROUP BY ALL)"""


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as graded samples: a customer is a problem; finished orders are right, pending ones half right."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    score = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.0)
    return o.select(F.col("o_custkey").alias("problem_id"), F.col("o_orderkey").alias("idx"), score.alias("score"), F.col("o_orderstatus").alias("answer"))


ROLLOUTS = """roll AS (
  SELECT o_custkey AS problem_id, o_orderkey AS idx, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'P' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score,
    o_orderstatus AS answer FROM orders)"""


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation, customer, orders as four levels of one tree a region; orders are the leaves."""
    read = lambda name, *c: table(spark, sf_dir, name).select(*c)
    r, n = read("region", "r_regionkey"), read("nation", "n_nationkey", "n_regionkey")
    c, o = read("customer", "c_custkey", "c_nationkey"), read("orders", "o_orderkey", "o_custkey", "o_orderstatus")
    none = F.lit(None).cast("double")
    key = lambda kind, x: F.concat(F.lit(kind), F.col(x).cast("string"))
    cn = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    on = o.join(cn, o.o_custkey == cn.c_custkey)
    score = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.0)
    row = lambda df, tree, node, parent, depth, s: df.select(F.col(tree).alias("tree_id"), node.alias("node_id"), parent.alias("parent_id"), F.lit(depth).alias("depth"), s.alias("score"))
    return (
        row(r, "r_regionkey", key("r", "r_regionkey"), F.lit(None).cast("string"), 0, none)
        .unionByName(row(n, "n_regionkey", key("n", "n_nationkey"), key("r", "n_regionkey"), 1, none))
        .unionByName(row(cn, "n_regionkey", key("c", "c_custkey"), key("n", "c_nationkey"), 2, none))
        .unionByName(row(on, "n_regionkey", key("o", "o_orderkey"), key("c", "o_custkey"), 3, score))
    )


NODES = """nodes AS (
  SELECT r_regionkey AS tree_id, 'r' || r_regionkey AS node_id, NULL::VARCHAR AS parent_id, 0 AS depth, NULL::DOUBLE AS score FROM region
  UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey, 1, NULL FROM nation
  UNION ALL SELECT n_regionkey, 'c' || c_custkey, 'n' || c_nationkey, 2, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, 'o' || o_orderkey, 'c' || o_custkey, 3, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'P' THEN 0.5 ELSE 0.0 END
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
v2 AS (SELECT p.tree_id, p.node_id, coalesce(avg(c.score), 0.0) AS value, coalesce(stddev_pop(c.score), 0.0) AS value_std FROM nodes p LEFT JOIN nodes c ON c.tree_id = p.tree_id AND c.parent_id = p.node_id WHERE p.depth = 2 GROUP BY ALL),
v1 AS (SELECT p.tree_id, p.node_id, coalesce(avg(v.value), 0.0) AS value, coalesce(stddev_pop(v.value), 0.0) AS value_std FROM nodes p LEFT JOIN nodes c ON c.tree_id = p.tree_id AND c.parent_id = p.node_id LEFT JOIN v2 v ON v.tree_id = c.tree_id AND v.node_id = c.node_id WHERE p.depth = 1 GROUP BY ALL),
v0 AS (SELECT p.tree_id, p.node_id, coalesce(avg(v.value), 0.0) AS value, coalesce(stddev_pop(v.value), 0.0) AS value_std FROM nodes p LEFT JOIN nodes c ON c.tree_id = p.tree_id AND c.parent_id = p.node_id LEFT JOIN v1 v ON v.tree_id = c.tree_id AND v.node_id = c.node_id WHERE p.depth = 0 GROUP BY ALL),
vals AS (SELECT * FROM v0 UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT tree_id, node_id, score, 0.0 FROM nodes WHERE depth = 3)"""

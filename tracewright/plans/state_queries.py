"""Queries on state, streams and event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import state as S
from ..streaming import windows as E
from .rollouts import ROLLOUTS, rollouts, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_EDGES = "e AS (SELECT o_custkey AS question_id, o_orderkey AS edge_id, CAST(o_orderkey % 20 AS INTEGER) AS iteration FROM orders)"


@query(f"WITH {_EDGES} SELECT question_id, edge_id, iteration FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY md5('0:' || edge_id), edge_id) AS r FROM e WHERE 19 - iteration < 8) WHERE r <= 3")
def z1_replay_buffer(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("edge_id"), (F.col("o_orderkey") % 20).cast("int").alias("iteration"))
    return S.replay(e.where("iteration < 19"), e.where("iteration = 19"), 19, 8, 3)


@query(f"""WITH {ROLLOUTS}, n AS (SELECT problem_id AS question_id, count(*) AS n, count(*) FILTER (WHERE score >= 1) AS c FROM roll GROUP BY problem_id)
SELECT c_custkey AS question_id, coalesce(n, 0) AS rollouts, coalesce(c, 0) AS correct, CASE WHEN coalesce(n, 0) > 0 AND c >= 0.5 * n THEN 'satisfied' WHEN coalesce(n, 0) >= 10 THEN 'given_up' ELSE 'open' END AS status
FROM customer LEFT JOIN n ON n.question_id = c_custkey""")
def z3_sticky_sampler(spark, sf_dir):
    zero = F.lit(0).cast("long")
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"), F.lit("open").alias("status"), zero.alias("rollouts"), zero.alias("correct"))
    r = rollouts(spark, sf_dir).select(F.col("problem_id").alias("question_id"), F.col("score").alias("reward"))
    return S.sticky_step(q, r, 0.5, 10).select("question_id", "rollouts", "correct", "status")


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance FROM events")
def z4_g34_running_moments(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = S.merged_moments(S.moments(e, "value", "event_type"))
    return m.select("n", F.round("mean", 6).alias("mean"), F.round(F.col("m2") / F.col("n"), 4).alias("variance"))


@query(f"""WITH {ROLLOUTS}, w AS (SELECT problem_id, idx, row_number() OVER p AS n, avg(score) OVER p AS m FROM roll WINDOW p AS (PARTITION BY problem_id ORDER BY idx)),
x AS (SELECT *, 2 * 1.96 * sqrt(m * (1 - m) / n) AS width FROM w), s AS (SELECT problem_id, min(n) FILTER (WHERE n >= 2 AND width <= 0.8) AS stop FROM x GROUP BY problem_id)
SELECT x.problem_id, idx, CAST(n AS INTEGER) AS n, round(width, 6) AS width FROM x JOIN s USING (problem_id) WHERE stop IS NULL OR n <= stop""")
def z8_resampled_until_sure(spark, sf_dir):
    out = S.resampled_until_sure(rollouts(spark, sf_dir), 0.8)
    return out.select("problem_id", "idx", "n", F.round("width", 6).alias("width"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def e1_tumbling_windows(spark, sf_dir):
    out = E.tumbling(table(spark, sf_dir, "events"), "1 hour", ["event_type"], "value")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER u < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s)
SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, g""")
def e2_session_windows(spark, sf_dir):
    out = E.sessions(table(spark, sf_dir, "events"), "30 minutes", ["user_id"], "value")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT o_custkey % 200 AS question_id, o_orderkey AS edge_id, CAST(o_orderkey % 20 AS INTEGER) AS iteration FROM orders)
SELECT question_id, edge_id, iteration FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY md5('0:' || edge_id), edge_id) AS r FROM e WHERE 19 - iteration < 8) WHERE r <= 32""")
def o5_capped_edges(spark, sf_dir):
    """The buffer's own bounds: eight iterations, 32 edges a question."""
    e = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("question_id"), F.col("o_orderkey").alias("edge_id"), (F.col("o_orderkey") % 20).cast("int").alias("iteration"))
    return S.replay(e.where("iteration < 19"), e.where("iteration = 19"), 19)

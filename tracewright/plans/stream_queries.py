"""Queries on samplers, buffers and sinks that carry state over iterations; their DuckDB equivalents unroll the iterations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import writers
from ..streaming import buffers, sampler
from .rollouts import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ROUNDS = 3
RULE = sampler.Sticky(0.25, 0.6, 3, early_stop=True, seed=0)


def _draws(part: str, t: int, n: str, pool: str) -> str:
    """n draws of question_id from a pool."""
    ranked = f"(SELECT question_id, row_number() OVER (ORDER BY md5('0:' || question_id), question_id) - 1 AS r FROM {pool})"
    at = f"CAST('0x' || substr(md5('0:{part}:{t}:' || slot), 1, 15) AS BIGINT) % (SELECT count(*) FROM {pool})"
    return f"SELECT '{part}' AS part, {t} AS since, slot, question_id FROM (SELECT unnest(range(0, {n})) AS slot) JOIN {ranked} ON r = {at}"


def _sticky_sql() -> str:
    ctes = ["n AS (SELECT count(*) // 2 AS n, CAST(floor(count(*) // 2 * 0.25) AS BIGINT) AS r FROM customer)", "st0 AS (SELECT c_custkey AS question_id, 0 AS rollouts, 0.0::DOUBLE AS correct, false AS satisfied, false AS given_up FROM customer)"]
    for t in range(ROUNDS):
        carried = "SELECT 'carried' AS part, since, slot, question_id FROM car0 WHERE false" if not t else f"SELECT 'carried' AS part, since, slot, question_id FROM tr{t - 1} WHERE part <> 'random' AND question_id IN (SELECT question_id FROM open{t})"
        ctes += [f"open{t} AS (SELECT question_id FROM st{t} WHERE NOT satisfied AND NOT given_up)"]
        ctes += [f"car{t} AS ({carried})"] if t else ["car0 AS (SELECT '' AS part, 0 AS since, CAST(0 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS question_id WHERE false)"]
        ctes += [
            f"tr{t} AS ({_draws('random', t, '(SELECT r FROM n)', f'st{t}')} UNION ALL SELECT * FROM car{t} UNION ALL {_draws('new', t, f'(SELECT n - r FROM n) - (SELECT count(*) FROM car{t})', f'open{t}')})",
            f"res{t} AS (SELECT question_id, count(*) AS m, CAST(count(*) FILTER (WHERE (question_id * 7 + {t * 3} + slot) % 5 < 3) AS DOUBLE) AS good FROM tr{t} GROUP BY ALL)",
            f"""st{t + 1} AS (SELECT question_id, rollouts + coalesce(m, 0) AS rollouts, correct + coalesce(good, 0) AS correct, CASE WHEN m IS NULL THEN satisfied ELSE good / m >= 0.6 END AS satisfied,
given_up OR coalesce(good / m < 0.6 AND rollouts + m >= 3, false) AS given_up FROM st{t} LEFT JOIN res{t} USING (question_id))""",
        ]
    return f"WITH {', '.join(ctes)} SELECT question_id, CAST(rollouts AS BIGINT) AS rollouts, correct, satisfied, given_up FROM st{ROUNDS}"


@query(_sticky_sql())
def z3_u5_sticky_iterations(spark, sf_dir):
    """Three batches of half as many slots as questions: drawn, carried on, graded by a rule, and folded into the state."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"))
    state, slots, n = sampler.start(customers), None, customers.count() // 2
    for t in range(ROUNDS):
        folder = writers.scratch(spark, f"sticky-{t}")
        sampler.select(state, slots, n, t, RULE).write.parquet(f"{folder}/slots")
        slots = spark.read.parquet(f"{folder}/slots")
        results = slots.select("question_id", F.when((F.col("question_id") * 7 + 3 * t + F.col("slot")) % 5 < 3, 1.0).otherwise(0.0).alias("reward"))
        sampler.update(state, results, RULE).write.parquet(f"{folder}/state")
        state = spark.read.parquet(f"{folder}/state")
    return state


ITERATIONS, MAX_AGE, PER_QUESTION = 5, 2, 2


def _buffer_sql() -> str:
    ctes = [f"e AS (SELECT o_custkey AS question_id, o_orderkey AS edge_id, o_orderkey % {ITERATIONS} AS iteration FROM orders)"]
    # one iteration more than there are: what is left over is used then
    for t in range(ITERATIONS + 1):
        held = f"SELECT * FROM held{t - 1} WHERE edge_id NOT IN (SELECT edge_id FROM used{t - 1}) AND {t} - iteration < {MAX_AGE} UNION ALL " if t else ""
        ctes += [
            f"held{t} AS ({held}SELECT * FROM e WHERE iteration = {t})",
            f"used{t} AS (SELECT question_id, edge_id, iteration FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY md5('0:' || edge_id), edge_id) AS r FROM held{t}) WHERE r <= {PER_QUESTION})",
        ]
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f'SELECT CAST({t} AS BIGINT) AS "at", question_id, edge_id, CAST(iteration AS BIGINT) AS iteration FROM used{t}' for t in range(ITERATIONS + 1))


@query(_buffer_sql())
def z1_replay_stream(spark, sf_dir):
    """The edges of orders as a stream, one iteration a micro-batch, and what each iteration takes from the buffer."""
    folder = writers.scratch(spark, "replay")
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("edge_id"), (F.col("o_orderkey") % ITERATIONS).alias("iteration"))
    # a last edge of a question that no order has: it closes the iterations before it
    ends = spark.range(1).select(F.lit(-1).cast("long").alias("question_id"), F.lit(-1).cast("long").alias("edge_id"), F.lit(ITERATIONS + 2).cast("long").alias("iteration"))
    for t in range(ITERATIONS):
        edges.where(F.col("iteration") == t).coalesce(1).write.parquet(f"{folder}/in/{t}")
    ends.write.parquet(f"{folder}/in/end")
    stream = spark.readStream.schema(edges.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    used = buffers.used_edges(stream, MAX_AGE, PER_QUESTION)
    run = used.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/marks").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(used.schema).parquet(f"{folder}/out").where("question_id >= 0")


@query("""WITH q AS (SELECT c_custkey AS question_id, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(c_custkey % 3 AS VARCHAR) END AS answer FROM customer),
a AS (SELECT o_custkey AS question_id, CAST(o_orderkey % 3 AS VARCHAR) AS text, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2, o_orderkey) AS place FROM orders)
SELECT question_id, min_by(text, place) AS text FROM a JOIN q USING (question_id) WHERE answer <> '' AND place <= 3 AND text = answer GROUP BY question_id""")
def z7_golden_sink(spark, sf_dir):
    """Two batches of attempts, each handed to the sink twice: even orders first."""
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise((F.col("c_custkey") % 3).cast("string")).alias("answer"))
    attempts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("attempt"), (F.col("o_orderkey") % 3).cast("string").alias("text"))
    folder = writers.scratch(spark, "golden")
    add = buffers.golden_sink(q, folder, F.col("text") == F.col("answer"))
    for number in (0, 0, 1, 1, 0):
        add(attempts.where(F.col("attempt") % 2 == number), number)
    return buffers.golden_cache(spark, folder)

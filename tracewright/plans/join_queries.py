"""Queries on joins, samples, shards and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import episodes as E
from ..operators import joins as J
from ..operators import sampling as S
from .rollouts import ROLLOUTS, TOKENS, rollouts, table, tokens

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j1_skip_done(spark, sf_dir):
    return J.not_done(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("""WITH u AS (SELECT text, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY text) SELECT d.doc_id, first, n AS n_requests, CAST(length(d.text) AS BIGINT) AS result FROM documents d JOIN u USING (text)""")
def j2_u4_request_fan_out(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    unique = J.distinct_requests(docs.withColumnRenamed("doc_id", "first"), "text", "first")
    results = unique.withColumn("result", F.length("text").cast("long"))
    return J.fan_out(docs, results, "text").select("doc_id", "first", "n_requests", "result")


@query("""SELECT l.l_orderkey, l.l_linenumber, count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(max(o_totalprice), 2) AS order_total FROM lineitem l JOIN orders o ON o_orderkey = l_orderkey GROUP BY l.l_orderkey, l.l_linenumber""")
def j3_composite_key_results(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("p"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").cast("double").alias("t"))
    per = li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum("p"), 2).alias("total"))
    return per.join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "n", "total", F.round("t", 2).alias("order_total"))


@query(f"WITH {ROLLOUTS} SELECT a.problem_id, a.idx AS accepted, r.idx AS rejected FROM roll a JOIN roll r USING (problem_id) WHERE a.score >= 0.5 AND r.score < 0.5")
def j7_j8_accept_reject_pairs(spark, sf_dir):
    return J.accept_reject_pairs(rollouts(spark, sf_dir), "problem_id", "idx", "score", 0.5)


@query(f"""WITH {ROLLOUTS}, s AS (SELECT problem_id, idx, score >= 0.5 AS good, row_number() OVER (PARTITION BY problem_id, score >= 0.5 ORDER BY md5('42:' || idx), idx) AS k FROM roll),
p AS (SELECT a.problem_id, a.idx AS accepted, r.idx AS rejected FROM s a JOIN s r USING (problem_id) WHERE a.good AND NOT r.good AND a.k <= 3 AND r.k <= 3)
SELECT problem_id, accepted, rejected FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY md5('42:' || accepted || ':' || rejected)) AS r FROM p) WHERE r <= 3""")
def o7_capped_pairs(spark, sf_dir):
    return J.accept_reject_pairs(rollouts(spark, sf_dir), "problem_id", "idx", "score", 0.5, most=3)


@query(f"WITH {ROLLOUTS} SELECT problem_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY idx) AS r FROM roll WHERE score >= 0.5) WHERE r <= 2")
def o6_first_good_responses(spark, sf_dir):
    return E.best_responses(rollouts(spark, sf_dir), "problem_id", "idx", "score", 0.5, 2).select("problem_id", "idx")


@query(f"""WITH {TOKENS}, l AS (SELECT response_id, pos AS j, sum(entropy) OVER (PARTITION BY response_id ORDER BY pos) AS a, sum(entropy) OVER (PARTITION BY response_id ORDER BY pos DESC) AS b FROM tok)
SELECT x.response_id, x.j, y.j AS i FROM l x JOIN l y USING (response_id) WHERE round(x.a, 6) + round(y.b, 6) <= 300""")
def j11_splice_candidates(spark, sf_dir):
    from pyspark.sql import Window as W

    t = tokens(spark, sf_dir)
    w = W.partitionBy("response_id")
    t = t.select("response_id", "pos", F.round(F.sum("entropy").over(w.orderBy("pos")), 6).alias("a"), F.round(F.sum("entropy").over(w.orderBy(F.desc("pos"))), 6).alias("b"))
    left, right = t.select("response_id", F.col("pos").alias("j"), F.col("a").alias("prefix_length")), t.select("response_id", F.col("pos").alias("i"), F.col("b").alias("suffix_length"))
    return J.splice_candidates(left, right, "response_id", 300).select("response_id", "j", "i")


@query("SELECT d.doc_id, min(b.item_id) AS item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY d.doc_id")
def j12_first_containing(spark, sf_dir):
    return J.first_containing(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


@query("SELECT doc_id, quality::BIGINT AS old, CASE WHEN doc_id % 10 = 0 THEN 1 - quality ELSE quality END::BIGINT AS new FROM labels WHERE doc_id % 10 = 0")
def j17_changed_scores(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("q"))
    new = old.withColumn("q", F.when(F.col("doc_id") % 10 == 0, 1 - F.col("q")).otherwise(F.col("q")))
    return J.changed(old, new, "doc_id", "q")


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def p26_seeded_sample(spark, sf_dir):
    return S.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE r <= floor(n * 0.3)")
def p27_portion(spark, sf_dir):
    return S.portion(table(spark, sf_dir, "documents").select("lang", "doc_id"), "doc_id", ["lang"], 0.3)


@query("SELECT lang, doc_id, CAST(ntile(8) OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS INTEGER) AS shard FROM documents")
def p29_shards(spark, sf_dir):
    return S.shards(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 8)


@query("""WITH c AS (SELECT lang, doc_id, CAST(e AS INTEGER) AS epoch FROM documents, (SELECT unnest(range(3)) AS e)), s AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY epoch, md5('42:' || epoch || ':' || doc_id)) - 1 AS INTEGER) AS slot FROM c)
SELECT * FROM s WHERE slot >= 50 AND slot < 150""")
def p28_epoch_plan(spark, sf_dir):
    return S.epoch_plan(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 3, 50, 150).select("lang", "doc_id", "epoch", "slot")


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents), k AS (SELECT DISTINCT lang, n, (j * n) // 7 AS i FROM r, (SELECT unnest(range(7)) AS j))
SELECT r.lang, r.doc_id FROM r JOIN k ON k.lang = r.lang AND k.i = r.i""")
def p31_thinned(spark, sf_dir):
    return S.thinned(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 7)


@query("""WITH RECURSIVE c AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents),
g AS (SELECT source, 0::BIGINT AS nx, 0::BIGINT AS used, []::BIGINT[] AS kept FROM (SELECT DISTINCT source FROM documents)
  UNION ALL SELECT g.source, c.i + 1, CASE WHEN used + n_chars <= 20000 THEN used + n_chars ELSE used END, CASE WHEN used + n_chars <= 20000 THEN list_append(kept, c.i) ELSE kept END FROM g JOIN c ON c.source = g.source AND c.i = g.nx)
SELECT source, array_to_string(arg_max(kept, nx), ',') AS kept FROM g GROUP BY source""")
def p35_budget_prefix(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("doc_id", "n_chars"))).alias("x"))
    kept = S.budget_prefix(F.transform("x", lambda y: y["n_chars"]), F.lit(20000))
    return d.select("source", F.array_join(F.transform(kept, lambda i: i.cast("string")), ",").alias("kept"))


@query("SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx FROM documents")
def p20_row_index(spark, sf_dir):
    return S.row_index(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], "doc_id")


@query("SELECT doc_id FROM documents WHERE lower(trim(lang)) IN ('en', 'de') AND contains(lower(source), 'c1')")
def p3_p5_level_and_substring_filters(spark, sf_dir):
    wanted = {x.strip().lower() for x in "EN, de ,".split(",") if x.strip()}
    d = table(spark, sf_dir, "documents")
    return d.where(F.lower(F.trim("lang")).isin(*sorted(wanted)) & F.lower("source").contains("c1")).select("doc_id")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def u5_remaining_pool(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


@query("SELECT problem_id, hard FROM (SELECT o_custkey AS problem_id, NOT bool_or(o_orderstatus = 'F') AS hard FROM orders GROUP BY o_custkey) WHERE hard")
def p14_hard_questions(spark, sf_dir):
    r = rollouts(spark, sf_dir).groupBy("problem_id").agg((~F.bool_or(F.col("score") >= 1.0)).alias("hard"))
    return r.where("hard")


@query(f"""WITH {TOKENS}, l AS (SELECT response_id, pos, round(sum(entropy) OVER (PARTITION BY response_id ORDER BY pos), 6) AS a, round(sum(entropy) OVER (PARTITION BY response_id ORDER BY pos DESC), 6) AS b, CAST(pos * 7 % 13 AS DOUBLE) AS s FROM tok)
SELECT response_id, j, i, score FROM (SELECT x.response_id, CAST(x.pos AS BIGINT) AS j, CAST(y.pos AS BIGINT) AS i, y.s AS score, row_number() OVER (PARTITION BY x.response_id, x.pos ORDER BY y.s DESC, y.pos) AS r FROM l x JOIN l y USING (response_id) WHERE y.b <= 300 - x.a) WHERE r = 1""")
def j11_o3_best_fitting_splices(spark, sf_dir):
    """For each prefix of a response the best suffix that fits, without their grid."""
    from pyspark.sql import Window as W

    t, w = tokens(spark, sf_dir), W.partitionBy("response_id")
    left = t.select("response_id", F.col("pos").alias("j"), F.round(F.sum("entropy").over(w.orderBy("pos")), 6).alias("prefix_length"))
    right = t.select("response_id", F.col("pos").alias("i"), F.round(F.sum("entropy").over(w.orderBy(F.desc("pos"))), 6).alias("suffix_length"), (F.col("pos") * 7 % 13).alias("score"))
    return J.best_fitting(left, right, "response_id", 300, "score")

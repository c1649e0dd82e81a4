"""Queries on training episodes: losses, solvers, prompts, loaders, loops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import plugins
from ..functions import maths, puzzles
from ..functions import text as X
from ..operators import diversity as D
from ..operators import joins as J
from ..operators import losses as L
from ..operators import nested as N
from ..operators import phases as P
from ..operators import rewards as R
from ..operators import trees as T
from ..sources import readers, writers
from ..streaming import loops
from . import phase_queries
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
    return df.select(*[F.round(c, digits).alias(c) if c in columns else c for c in df.columns])


# -- phase rewards from influence


def _influence(spark, sf_dir):
    """A lower triangle of three phases a response, from its mean entropies, with the outcome."""
    mean = [F.coalesce(F.avg(F.when(F.col("pos") % 6 == k, F.col("entropy"))), F.lit(0.0)) / 200 for k in range(6)]
    rows = F.array(F.array(F.col("e0")), F.array("e1", "e2"), F.array("e3", "e4", "e5"))
    e = tokens(spark, sf_dir).groupBy("response_id").agg(*[m.alias(f"e{k}") for k, m in enumerate(mean)])
    return e.select("response_id", rows.alias("a")).join(outcomes(spark, sf_dir).select("response_id", "outcome"), "response_id")


_INFLUENCE = f"""WITH {TOKENS}, {OUTCOMES}, e AS (SELECT response_id, {", ".join(f"coalesce(avg(entropy) FILTER (WHERE pos % 6 = {k}), 0) / 200 AS e{k}" for k in range(6))} FROM tok GROUP BY response_id),
i AS (SELECT * FROM e JOIN outc USING (response_id))"""


@query(f"""{_INFLUENCE}, r AS (SELECT *, 0.5 AS r0, e0 * 0.5 AS r1, e1 * 0.5 + e2 * e0 * 0.5 AS r2 FROM i), s AS (SELECT *, e3 * r0 + e4 * r1 + e5 * r2 + outcome AS r3, greatest(5.0, 10 * outcome) AS b FROM r)
SELECT response_id, generate_subscripts([r0, r1, r2, r3], 1) - 1 AS phase_id, round(unnest(list_transform([r0, r1, r2, r3], lambda v: greatest(-b, least(b, v)))), 6) AS reward FROM s""")
def m15_rewards_from_the_first_phase(spark, sf_dir):
    out = _influence(spark, sf_dir).select("response_id", F.posexplode(maths.forward_substitution(F.col("a"), F.col("outcome"), F.lit(0.5))).alias("phase_id", "reward"))
    return rounded(out.withColumn("phase_id", F.col("phase_id").cast("long")), "reward")


@query(f"""{_INFLUENCE}, u AS (SELECT *, e0 AS u1, e1 + e2 * e0 AS u2 FROM i), d AS (SELECT *, e3 + e4 * u1 + e5 * u2 AS d, greatest(5.0, 10 * outcome) AS b FROM u),
r AS (SELECT response_id, list_transform([outcome / d, u1 * outcome / d, u2 * outcome / d, outcome], lambda v: greatest(-b, least(b, v))) AS r FROM d WHERE abs(d) >= 1e-12)
SELECT response_id, generate_subscripts(r, 1) - 1 AS phase_id, round(unnest(r), 6) AS reward FROM r""")
def m15_rewards_to_the_outcome(spark, sf_dir):
    out = _influence(spark, sf_dir).select("response_id", F.posexplode(maths.rewards_to_outcome(F.col("a"), F.col("outcome"))).alias("phase_id", "reward"))
    return rounded(out.withColumn("phase_id", F.col("phase_id").cast("long")), "reward")


_PHASES = f"WITH {TOKENS}, n AS (SELECT response_id, count(*) AS n FROM tok GROUP BY ALL), ph AS (SELECT DISTINCT response_id, pos // 20 AS phase_id FROM tok), cell AS (SELECT response_id, pos AS q, (pos * 5) % n AS k, entropy AS w FROM tok JOIN n USING (response_id))"


@query(f"""{_PHASES}, c AS (SELECT response_id, q // 20 AS q_phase, k // 20 AS k_phase, avg(w) AS w FROM cell GROUP BY ALL)
SELECT a.response_id, CAST(a.phase_id AS INTEGER) AS q_phase, CAST(b.phase_id AS INTEGER) AS k_phase, round(coalesce(c.w, 0), 6) AS w
FROM ph a JOIN ph b USING (response_id) LEFT JOIN c ON c.response_id = a.response_id AND c.q_phase = a.phase_id AND c.k_phase = b.phase_id""")
def g24_phase_attention(spark, sf_dir):
    t = tokens(spark, sf_dir).select("response_id", "pos", "entropy")
    n = t.groupBy("response_id").agg(F.count("*").alias("n"))
    phase = F.floor(F.col("pos") / 20).cast("int")
    spans = t.groupBy("response_id", phase.alias("phase_id")).agg(F.min("pos").alias("phase_start"), (F.max("pos") + 1).alias("phase_end"))
    cells = t.join(n, "response_id").select("response_id", F.lit(0).alias("head"), F.col("pos").alias("q"), ((F.col("pos") * 5) % F.col("n")).alias("k"), F.col("entropy").alias("w"))
    return rounded(R.phase_attention(cells, spans), "w")


_NAMED = {
    "sliding": ({"signal": "entropy", "width": phase_queries.WIDTH, "percentile": phase_queries.PERCENTILE, "min_gap": phase_queries.GAP, "most": phase_queries.MOST}, "w2_sliding_boundaries"),
    "threshold": ({"signal": "nlp", "delta": 4.0, "min_gap": 5}, "w3_threshold_boundaries"),
    "peak": ({"signal": "nlp", "percentile": 70.0, "min_gap": 5, "most": 10}, "w4_peak_boundaries"),
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS splitter, * FROM ({phase_queries.SQL[q]})" for name, (_, q) in _NAMED.items()))
def w7_f2_splitters_by_name(spark, sf_dir):
    t = tokens(spark, sf_dir)
    each = [phase_queries._joined(plugins.named("splitter", name)(t, **options)).withColumn("splitter", F.lit(name)) for name, (options, _) in _NAMED.items()]
    return reduce(DataFrame.unionByName, each).select("splitter", "response_id", "boundaries")


# -- episodes


def _episodes(spark, sf_dir):
    t = tokens(spark, sf_dir).select("response_id", F.struct("pos", "logprob", "entropy").alias("x")).groupBy("response_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    t = t.join(outcomes(spark, sf_dir).select("response_id", "outcome"), "response_id")
    pick = lambda f: F.transform("x", f)
    return t.select(
        "response_id", (F.col("response_id") % 2 == 0).alias("leaf"), F.col("outcome").alias("score"), F.lit(3).alias("query_length"), pick(lambda v: v["logprob"]).alias("actor"),
        pick(lambda v: 0.9 * v["logprob"] - 0.01 * (v["pos"] % 3)).alias("reference"), pick(lambda v: v["entropy"] - 50).alias("advantages"), pick(lambda v: v["entropy"]).alias("values"),
    )


@query(f"""WITH {TOKENS}, {OUTCOMES}, t AS (SELECT *, 0.9 * logprob - 0.01 * (pos % 3) AS ref, count(*) OVER (PARTITION BY response_id) AS n FROM tok),
e AS (SELECT response_id, count(*) FILTER (WHERE pos >= 2) AS len, coalesce(sum(logprob) FILTER (WHERE pos >= 2), 0) AS a, coalesce(sum(ref) FILTER (WHERE pos >= 2), 0) AS r, sum(logprob - ref) AS kl,
  sum(exp(greatest(-10, least(10, ref - logprob))) - 1 - greatest(-10, least(10, ref - logprob))) AS cv FROM t GROUP BY response_id),
f AS (SELECT avg(entropy - 50) AS am, stddev_pop(entropy - 50) AS sd, avg(entropy) FILTER (WHERE pos >= 2 AND pos < n - 1) AS vm, stddev_pop(entropy) FILTER (WHERE pos >= 2 AND pos < n - 1) AS vs FROM t)
SELECT round(avg(outcome) FILTER (WHERE response_id % 2 = 0), 6) AS score_mean, round(stddev_pop(outcome) FILTER (WHERE response_id % 2 = 0), 6) AS score_std, round(avg(len), 6) AS length_mean, round(stddev_pop(len), 6) AS length_std,
  round(avg(a), 6) AS actor_logprob, round(avg(CASE WHEN len > 0 THEN a / len END), 6) AS actor_logprob_per_token, round(avg(r), 6) AS reference_logprob, round(avg(CASE WHEN len > 0 THEN r / len END), 6) AS reference_logprob_per_token,
  round(avg(kl), 6) AS kl_mean, round(avg(cv), 6) AS control_variate_mean, round(any_value(am), 4) AS advantage_mean, round(any_value(sd), 4) AS advantage_std, round(any_value(vm), 4) AS value_mean, round(any_value(vs), 4) AS value_std
FROM e JOIN outc USING (response_id), f""")
def g30_episode_metrics(spark, sf_dir):
    out = L.episode_metrics(_episodes(spark, sf_dir))
    four = [c for c in out.columns if c.startswith(("advantage", "value"))]
    return rounded(rounded(out, *[c for c in out.columns if c not in four]), *four, digits=4)


@query(f"WITH {TOKENS} SELECT round(avg(entropy), 4) AS mean, round(var_pop(entropy), 4) AS variance, count(*) AS n FROM tok WHERE token <> 'view'")
def g33_global_statistics(spark, sf_dir):
    return rounded(L.global_statistics(tokens(spark, sf_dir), "entropy", F.col("token") != "view"), "mean", "variance", digits=4)


@query(f"""WITH {TOKENS}, {OUTCOMES}, e AS (SELECT response_id, sum(logprob) / 100 AS lr, sum(entropy) / 5000 AS lo FROM tok GROUP BY ALL)
SELECT round(avg(0.5 * least(exp(lo), 10) * pow(0.1 * lr - outcome, 2)), 6) AS loss, round(avg(lr), 6) AS log_ratio, round(avg(outcome), 6) AS advantage, round(avg(least(exp(lo), 10)), 6) AS weight,
  round(avg(CASE WHEN exp(lo) > 10 THEN 1.0 ELSE 0.0 END), 6) AS clip_fraction FROM e JOIN outc USING (response_id)""")
def m9_direct_value_loss(spark, sf_dir):
    e = tokens(spark, sf_dir).groupBy("response_id").agg((F.sum("logprob") / 100).alias("log_ratio_ref"), (F.sum("entropy") / 5000).alias("log_ratio_old"))
    out = L.direct_value_loss(e.join(outcomes(spark, sf_dir).withColumnRenamed("outcome", "advantage"), "response_id"), 0.1)
    return rounded(out, *out.columns)


@query(f"""WITH {TOKENS}, e AS (SELECT response_id, count(*) AS n, sum(entropy) AS a, sum(-logprob * entropy) AS l FROM tok GROUP BY ALL)
SELECT 'batch' AS reduction, false AS upscale, round(sum(l) / count(*), 4) AS loss FROM e UNION ALL SELECT 'batch', true, round(sum(l * n / a) / count(*), 4) FROM e
UNION ALL SELECT 'instances', false, round(avg(l / n), 4) FROM e UNION ALL SELECT 'instances', true, round(avg(l / a), 4) FROM e
UNION ALL SELECT 'tokens', false, round(sum(l) / sum(n), 4) FROM e UNION ALL SELECT 'tokens', true, round(sum(l * n / a) / sum(n), 4) FROM e""")
def m11_weighted_likelihood(spark, sf_dir):
    t = tokens(spark, sf_dir).select("response_id", "logprob", F.col("entropy").alias("advantage"))
    out = None
    for reduction in ("tokens", "instances", "batch"):
        for upscale in (False, True):
            one = L.weighted_likelihood(t, "response_id", reduction, upscale).select(F.lit(reduction).alias("reduction"), F.lit(upscale).alias("upscale"), F.round("loss", 4).alias("loss"))
            out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {TOKENS}, g AS (SELECT group_id, response_id, avg(entropy) / 100 AS d FROM tok GROUP BY ALL),
m AS (SELECT group_id, response_id, 1 + greatest(-0.2, least(0.2, d / 0.5 - 1)) * 32 / 1000 AS f FROM g)
SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY response_id) - 1 AS step, round(0.2 * exp(sum(ln(f)) OVER (PARTITION BY group_id ORDER BY response_id)), 8) AS coefficient FROM m""")
def m13_adaptive_coefficients(spark, sf_dir):
    g = tokens(spark, sf_dir).groupBy("group_id", "response_id").agg((F.avg("entropy") / 100).alias("d"))
    listed = g.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("response_id", "d"))), lambda x: x["d"]).alias("d"))
    out = listed.select("group_id", F.posexplode(L.adaptive_kl(F.col("d"), 0.2, 0.5, 1000.0, 32.0)).alias("step", "coefficient"))
    return rounded(out.withColumn("step", F.col("step").cast("long")), "coefficient", digits=8)


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 4 + 1 AS n FROM orders), t AS (SELECT *, list_transform(range(n), lambda i: repeat('x', CAST(i * 2 + 1 AS INTEGER))) AS texts FROM o),
s AS (SELECT *, array_to_string(list_transform(range(n), lambda i: CASE WHEN i = 0 THEN chr(10) ELSE '' END || texts[i + 1] || CASE WHEN i < n - 1 THEN chr(10) ELSE '' END), '') AS shown FROM t),
c AS (SELECT *, list_transform(range(length(shown)), lambda p: length(regexp_replace(left(rtrim(shown[1:p + 1], chr(10)) , CAST(p + 1 AS INTEGER)), '[^' || chr(10) || ']', '', 'g'))) AS lines FROM s),
u AS (SELECT o_orderkey, n, list_transform(range(1, length(shown), 3), lambda p: CAST(greatest(lines[p + 1] - 1, 0) AS DOUBLE) / 10) AS a FROM c)
SELECT o_orderkey, array_to_string(list_transform(CASE WHEN o_orderkey % 2 = 0 THEN a ELSE list_append(a, a[-1]) END, lambda v: CAST(v AS VARCHAR)), ' ') AS advantages FROM u""")
def a15_token_advantages(spark, sf_dir):
    n = (F.col("o_orderkey") % 4 + 1).cast("int")
    index = F.sequence(F.lit(0), n - 1)
    texts, advantage = F.transform(index, lambda i: F.repeat(F.lit("x"), i * 2 + 1)), F.transform(index, lambda i: i / 10)
    length = n * n + n
    starts = F.concat(F.array(F.lit(0)), F.sequence(F.lit(1), length - 1, F.lit(3)))
    o = table(spark, sf_dir, "orders")
    out = L.character_to_token_advantages(texts, advantage, starts, F.col("o_orderkey") % 2 == 0)
    return o.select("o_orderkey", F.array_join(F.transform(out, lambda v: v.cast("string")), " ").alias("advantages"))


@query(f"""WITH {TOKENS}, e AS (SELECT response_id, list(round(entropy, 2) ORDER BY pos) AS x FROM tok GROUP BY ALL)
SELECT response_id, len(x) + 5 AS width, CAST(round(list_sum(x[3:]), 2) AS DOUBLE) AS total, CAST(2 AS BIGINT) AS before, CAST(5 AS BIGINT) AS behind, len(x) AS ones FROM e WHERE len(x) > 2""")
def w25_a2_padded_rows(spark, sf_dir):
    e = tokens(spark, sf_dir).groupBy("response_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "entropy"))), lambda v: F.round(v["entropy"], 2)).alias("x")).where(F.size("x") > 2)
    longest = F.size("x") + 6
    out = e.withColumn("s", L.shifted_logprobs(F.col("x"), F.lit(3), longest, -1.0)).withColumn("r", L.rectangle(F.col("x"), 100_000, 0.0)["mask"])
    count = lambda a, v: F.size(F.filter(a, lambda y: y == v))
    total = F.round(F.aggregate(F.filter("s", lambda v: v != -1), F.lit(0.0), lambda a, v: a + v), 2)
    pads = lambda part: count(part, -1.0).cast("long")
    return out.select(
        "response_id", F.size("s").cast("long").alias("width"), total.alias("total"), pads(F.slice("s", 1, 2)).alias("before"), pads(F.slice("s", F.size("x") + 1, 100)).alias("behind"), count(F.col("r"), 1).cast("long").alias("ones")
    )


# -- choices


@query(f"""WITH {TOKENS}, c AS (SELECT a.response_id, a.pos AS j, b.pos AS i, round(a.entropy + b.entropy, 0) AS score FROM tok a JOIN tok b ON a.response_id = b.response_id AND b.pos = a.pos % 7)
SELECT response_id, j, i, score FROM (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY score DESC, j DESC, i) AS r FROM c) WHERE r = 1""")
def o3_best_splices(spark, sf_dir):
    t = tokens(spark, sf_dir).select("response_id", "pos", "entropy")
    other = t.select(F.col("response_id").alias("r"), F.col("pos").alias("i"), F.col("entropy").alias("e"))
    c = t.join(other, (F.col("response_id") == F.col("r")) & (F.col("i") == F.col("pos") % 7)).select("response_id", F.col("pos").alias("j"), "i", F.round(F.col("entropy") + F.col("e"), 0).alias("score"))
    best = c.groupBy("response_id").agg(F.max_by(F.struct("j", "i", "score"), F.struct("score", "j", -F.col("i"))).alias("x"))
    return best.select("response_id", "x.*")


@query(f"WITH {NODES} SELECT tree_id, node_id AS leaf_id FROM (SELECT tree_id, node_id, row_number() OVER (PARTITION BY tree_id ORDER BY md5('42:' || node_id), node_id) AS r FROM nodes WHERE depth = 3) WHERE r <= 8")
def o4_a11_random_paths(spark, sf_dir):
    leaves = tree_nodes(spark, sf_dir).where("depth = 3").select("tree_id", F.col("node_id").alias("leaf_id"))
    return T.random_paths(leaves, 8)


@query("SELECT name, idx FROM (SELECT 'shard_' || n_nationkey AS name, n_nationkey AS k FROM nation), (SELECT n_nationkey AS k2, row_number() OVER (ORDER BY n_nationkey) - 1 AS idx FROM nation) WHERE k = k2")
def o9_shards_in_order(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.concat(F.lit("shard_"), F.col("n_nationkey").cast("string")).alias("name"))
    number = F.regexp_extract("name", r"(\d+)$", 1).cast("long")
    listed = names.agg(F.transform(F.sort_array(F.collect_list(F.struct(number.alias("k"), "name"))), lambda x: x["name"]).alias("names"))
    return listed.select(F.posexplode("names").alias("idx", "name")).select("name", F.col("idx").cast("long").alias("idx"))


@query(f"""WITH {TOKENS}, c AS (SELECT response_id, pos, entropy, row_number() OVER (PARTITION BY response_id ORDER BY entropy DESC, pos) AS r FROM tok WHERE entropy > 150),
s AS (SELECT response_id, list(pos ORDER BY r) AS ps FROM c GROUP BY ALL)
SELECT response_id, len(list_reduce(list_prepend([0], list_transform(ps, lambda p: [p])), lambda out, p: CASE WHEN len(out) < 10 AND len(list_filter(out, lambda q: abs(q - p[1]) < 5)) = 0 THEN list_append(out, p[1]) ELSE out END)) AS chosen,
  CAST(list_sum(list_reduce(list_prepend([0], list_transform(ps, lambda p: [p])), lambda out, p: CASE WHEN len(out) < 10 AND len(list_filter(out, lambda q: abs(q - p[1]) < 5)) = 0 THEN list_append(out, p[1]) ELSE out END)) AS BIGINT) AS total FROM s""")
def o1_spaced_choices(spark, sf_dir):
    c = tokens(spark, sf_dir).where("entropy > 150").groupBy("response_id").agg(F.collect_list(F.struct("pos", F.col("entropy").alias("score"))).alias("c"))
    chosen = P.spaced_top(F.col("c"), F.lit(0), 5, 10)
    return c.select("response_id", F.size(chosen).cast("long").alias("chosen"), F.aggregate(chosen, F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


@query(f"WITH {TOKENS} SELECT t.response_id, t.pos, round(a.v, 6) AS token_advantage FROM tok t JOIN (SELECT response_id, pos // 20 AS p, avg(entropy) AS v FROM tok GROUP BY ALL) a ON a.response_id = t.response_id AND a.p = t.pos // 20")
def j5_phase_values_on_tokens(spark, sf_dir):
    t = tokens(spark, sf_dir).select("response_id", "pos", "entropy", F.floor(F.col("pos") / 20).cast("int").alias("phase_id"))
    a = t.groupBy("response_id", "phase_id").agg(F.avg("entropy").alias("v"))
    return rounded(t.join(a, ["response_id", "phase_id"]).select("response_id", "pos", F.col("v").alias("token_advantage")), "token_advantage")


@query(f"""WITH {NODES} SELECT a.tree_id, a.node_id, a.depth, concat_ws('/', d.node_id, c.node_id, b.node_id, a.node_id) AS path FROM nodes a LEFT JOIN nodes b ON b.tree_id = a.tree_id AND b.node_id = a.parent_id
LEFT JOIN nodes c ON c.tree_id = b.tree_id AND c.node_id = b.parent_id LEFT JOIN nodes d ON d.tree_id = c.tree_id AND d.node_id = c.parent_id""")
def a3_flattened_tree(spark, sf_dir):
    return T.preorder(tree_nodes(spark, sf_dir)).select("tree_id", "node_id", "depth", "path")


@query("""WITH p AS (SELECT p_partkey, CAST(p_partkey % 9 AS INTEGER) AS d, p_size / 64.0::DOUBLE AS a, CAST(p_partkey % 2 AS DOUBLE) AS c FROM part),
n AS (SELECT *, unnest(range(0, 2 * d + 1)) AS node FROM p), v AS (SELECT *, node % 2 = 0 AS mid, node // 2 AS l FROM n)
SELECT p_partkey, node, CASE WHEN node = 0 THEN -1 WHEN mid THEN node - 2 ELSE node - 1 END AS parent, CASE WHEN mid THEN 2 * d ELSE node END AS last, CAST(CASE WHEN mid THEN l ELSE l + 1 END AS INTEGER) AS depth,
  CASE WHEN mid THEN a + (c - a) * pow(0.5, d - l) ELSE a END AS value, CASE WHEN mid AND l < d THEN abs(a - (a + (c - a) * pow(0.5, d - l - 1))) / 2 ELSE 0.0 END AS value_std FROM v""")
def a3_j9_nested_trees(spark, sf_dir):
    """A nested tree of a depth of its own for each part, flattened in pre-order and folded."""
    d, a = (F.col("p_partkey") % 9).cast("int"), (F.col("p_size") / 64).cast("string")
    leaf = lambda x: F.concat(F.lit('{"score": '), x, F.lit(', "children": []}'))
    opened = F.concat(F.lit('{"children": ['), leaf(a), F.lit(", "))
    tree = F.concat(F.repeat(opened, d), leaf((F.col("p_partkey") % 2).cast("string")), F.repeat(F.lit("]}"), d))
    nodes = N.flattened(table(spark, sf_dir, "part").select("p_partkey", tree.alias("tree")), "p_partkey", "tree")
    out = N.folded(nodes, "p_partkey", F.get_json_object("fields", "$.score").cast("double"))
    return out.select("p_partkey", "node", F.coalesce("parent", F.lit(-1)).alias("parent"), "last", "depth", "value", "value_std")


@query(f"""WITH {TOKENS}, p AS (SELECT response_id, pos // 20 AS step, string_agg(token, ' ' ORDER BY pos) AS text FROM tok GROUP BY ALL)
SELECT response_id, CAST(step AS INTEGER) AS depth, length(string_agg(text, '|') OVER (PARTITION BY response_id ORDER BY step)) AS n_chars FROM p""")
def a14_spines(spark, sf_dir):
    t = tokens(spark, sf_dir).withColumn("step", F.floor(F.col("pos") / 20).cast("int"))
    text = lambda x: F.array_join(F.transform(F.sort_array(x), lambda v: v["token"]), " ")
    steps = t.groupBy("response_id", "step").agg(text(F.collect_list(F.struct("pos", "token"))).alias("text"))
    listed = steps.groupBy("response_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "text"))), lambda v: v["text"]).alias("steps"))
    return T.spine(listed, "response_id", "steps", "|").select("response_id", "depth", F.length("full_text").cast("long").alias("n_chars"))


# -- texts


@query("""SELECT o_orderkey, [NULL, 'easy|hard', '', 'level 1|level 2'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS levels, CASE WHEN o_orderkey % 3 = 0 THEN 'c' WHEN o_orderkey % 3 = 1 THEN '<think>' || chr(10) || 'r' || chr(10) || '</think>' || chr(10) || chr(10) || 'c' ELSE '' END AS solution,
  CASE WHEN o_orderkey < 1000 THEN o_orderkey || '  ' WHEN o_orderkey < 100000 THEN format('{:.1f}', o_orderkey / 1000.0) || ' K' ELSE (o_orderkey // 1000) || ' K' END AS shown FROM orders""")
def p2_p12_t39_levels_solutions_counts(spark, sf_dir):
    k = F.col("o_orderkey")
    listed = F.get(F.array(F.lit(""), F.lit(" Easy, HARD ,,easy"), F.lit(" , "), F.lit("Level 1,level 2")), (k % 4).cast("int"))
    solution = X.solution_text(F.when(k % 3 == 1, "r"), F.when(k % 3 < 2, "c"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(X.levels(listed), "|").alias("levels"), solution.alias("solution"), maths.human_count(k).alias("shown"))


@query("""SELECT conv_id, CAST(n - 1 AS INTEGER) AS k, 2 AS n_messages, md5('**Math Problem:**' || chr(10) || q || chr(10) || chr(10) || '**Correct Answer:** 7' || chr(10) || chr(10)
  || CASE WHEN n > 1 THEN '**Previous reasoning steps (from the response being evaluated):**' || chr(10) || context || chr(10) || chr(10) ELSE '' END || '**Step ' || n || ' of ' || n || ' to evaluate:**' || chr(10) || last || chr(10) || chr(10)
  || 'Evaluate this reasoning step. Consider whether it aligns with the correct answer above. Output JSON: {"score": <0.0-1.0>, "reason": "..."}') AS judge,
  md5('**Problem:** ' || q || chr(10) || chr(10) || '**Correct Answer:** 7' || chr(10) || chr(10) || 'Write a detailed step-by-step solution that arrives at this answer.') AS hint
FROM (SELECT conv_id, any_value(n) AS n, arg_min(text, turn) AS q, arg_max(text, turn) AS last, string_agg('Step ' || r || ': ' || text, chr(10) ORDER BY turn) FILTER (WHERE r < n) AS context
  FROM (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY conv_id)""")
def t16_prompts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("phases"))
    question, k = F.get("phases", F.lit(0)), F.size("phases") - 1
    messages = X.judge_prompt("Judge one step.", question, F.lit("7"), F.col("phases"), k)
    user = lambda m: F.md5(F.get(m, F.lit(1))["content"])
    return c.select("conv_id", k.alias("k"), F.size(messages).alias("n_messages"), user(messages).alias("judge"), user(X.hinted_prompt("Solve.", question, F.lit("7"))).alias("hint"))


_PUZZLES = ((1, 1, 1, 1), (3, 3, 8, 8), (1, 5, 5, 5), (4, 6, 1, 1), (1, 1, 2, 7), (13, 13, 13, 13), (2, 3, 5, 12), (1, 1, 1, 2))


@query("SELECT o_orderkey, [false, true, true, true, true, false, true, false][CAST(o_orderkey % 8 AS INTEGER) + 1] AS solvable FROM orders")
def t32_solvable_puzzles(spark, sf_dir):
    puzzle = F.get(F.array(*[F.array(*map(F.lit, p)) for p in _PUZZLES]), (F.col("o_orderkey") % 8).cast("int"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", puzzle.alias("puzzle"))
    known = o.select("puzzle").distinct().withColumn("solvable", puzzles.can_make_24("puzzle"))
    return o.join(known, "puzzle").select("o_orderkey", "solvable")


@query("""WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
u AS (SELECT conv_id, min(r) FILTER (WHERE role = 'user') AS first, 'Be brief.' || coalesce(chr(10) || string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'system'), '') AS head FROM m GROUP BY conv_id)
SELECT conv_id, md5(coalesce(string_agg(CASE WHEN r = first THEN 'user:' || head || chr(10) || chr(10) || text ELSE role || ':' || text END, '|' ORDER BY turn) FILTER (WHERE role <> 'system'), '')) AS merged,
  md5('developer:Be brief.|' || string_agg(CASE role WHEN 'system' THEN 'developer' ELSE role END || ':' || text, '|' ORDER BY turn)) AS developer, 'a' || conv_id AS content, CASE WHEN conv_id % 2 = 0 THEN 'why' END AS reasoning FROM m JOIN u USING (conv_id) GROUP BY conv_id""")
def t40_provider_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")))).alias("x"))
    plain = F.transform("x", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    messages = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit("Be brief.").alias("content"))), plain)
    shown = lambda m: F.md5(F.array_join(F.transform(m, lambda v: F.concat(v["role"], F.lit(":"), v["content"])), "|"))
    said = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("a"), F.col("conv_id").cast("string")).alias("content"), F.when(F.col("conv_id") % 2 == 0, "why").alias("reasoning_content")).alias("message"))).alias("choices")))
    out = c.select("conv_id", shown(X.adapted_messages(messages, False)).alias("merged"), shown(X.adapted_messages(messages, False, True)).alias("developer"), X.reply(said).alias("r"))
    return out.select("conv_id", "merged", "developer", "r.*")


# -- trees and components


def _siblings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 7).alias("depth"), F.floor(F.col("doc_id") / 6).alias("node"), "text")
    return d.select("doc_id", (F.col("node") % 10).alias("tree_id"), "depth", "node", "text")


@query("""WITH d AS (SELECT doc_id, doc_id // 6 % 10 AS tree_id, doc_id % 7 AS depth, doc_id // 6 AS node, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS c FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT unnest([1, 2, 3, 4]) AS k)) GROUP BY ALL),
p AS (SELECT a.tree_id, a.node, a.doc_id AS x, b.doc_id AS y, len(a.w) AS lx, len(b.w) AS ly FROM d a JOIN d b ON a.node = b.node AND a.doc_id < b.doc_id),
m AS (SELECT p.tree_id, p.node, s.k, sum(least(s.c, t.c)) AS m FROM p JOIN g s ON s.doc_id = x JOIN g t ON t.doc_id = y AND t.k = s.k AND t.g = s.g GROUP BY ALL),
q AS (SELECT tree_id, node, k, sum(greatest(lx - k + 1, 0)) AS n FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) GROUP BY ALL),
r AS (SELECT q.tree_id, q.node, exp(avg(CASE WHEN m.m > 0 THEN ln(m.m / q.n) END)) AS gm, count(m.m) AS orders FROM q LEFT JOIN m ON m.tree_id = q.tree_id AND m.node = q.node AND m.k = q.k GROUP BY ALL),
l AS (SELECT tree_id, node, sum(lx) AS a, sum(ly) AS b FROM p GROUP BY ALL)
SELECT tree_id, node, round(CASE WHEN orders < 4 THEN 0.0 ELSE gm * CASE WHEN a > b THEN 1 ELSE exp(1 - b / a) END END, 6) AS bleu FROM r JOIN l USING (tree_id, node)""")
def a23_sibling_bleu(spark, sf_dir):
    return rounded(D.sibling_bleu(_siblings(spark, sf_dir), ["tree_id", "node"], "doc_id", "text").select("tree_id", "node", "bleu"), "bleu")


@query("""WITH s AS (SELECT r_regionkey AS tree_id, n_nationkey % 3 AS depth, n_nationkey / 25.0 AS bleu FROM nation JOIN region ON n_regionkey = r_regionkey), e AS (SELECT tree_id, depth, sum(bleu) AS s, count(*) AS n FROM s GROUP BY ALL)
SELECT tree_id, round(sum(s) / sum(n), 6) AS bleu, round(avg(s / n), 6) AS bleu_by_depth FROM e GROUP BY tree_id""")
def g46_tree_diversity(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("tree_id"), (F.col("n_nationkey") % 3).alias("depth"), (F.col("n_nationkey") / 25).alias("bleu"))
    return rounded(D.tree_diversity(n, "tree_id", "depth"), "bleu", "bleu_by_depth")


@query()
def m16_o11_state_confluence(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    s = e.select((F.col("vec_id") % 20).alias("response_id"), F.col("vec_id").alias("pos"), F.floor(F.col("vec_id") / 20 % 3).cast("int").alias("phase_id"), F.col("embedding").alias("state"))
    return rounded(D.state_confluence(s, 8), "confluence")


_SQUARED = "a * a + b * b + c * c AS a, a * b + b * d + c * e AS b, a * c + b * e + c * f AS c, b * b + d * d + e * e AS d, b * c + d * e + e * f AS e, c * c + e * e + f * f AS f"


@query(f"""WITH RECURSIVE {TOKENS}, h AS (SELECT response_id, pos, pos // 20 AS qp, pos // 20 % 2 AS kp, entropy / 500 AS x, nlp / 10 AS y, (pos % 3) / 3.0::DOUBLE AS z FROM tok),
m AS (SELECT response_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM h GROUP BY ALL), o AS (SELECT h.*, mx, my, mz, x - mx AS u, y - my AS v, z - mz AS w FROM h JOIN m USING (response_id)),
it AS (SELECT response_id, 0 AS k, sum(u * u) AS a, sum(u * v) AS b, sum(u * w) AS c, sum(v * v) AS d, sum(v * w) AS e, sum(w * w) AS f FROM o GROUP BY ALL
  UNION ALL SELECT response_id, k + 1, a / t, b / t, c / t, d / t, e / t, f / t FROM (SELECT *, CASE WHEN a + d + f > 0 THEN a + d + f ELSE 1 END AS t FROM (SELECT response_id, k, {_SQUARED} FROM it WHERE k < 40))),
p AS (SELECT * FROM it WHERE k = 40), s AS (SELECT response_id, qp, kp, greatest((a * u + b * v + c * w + b * u + d * v + e * w + c * u + e * v + f * w + mx + my + mz) / 3, 0) AS s FROM o JOIN p USING (response_id))
SELECT response_id, CAST(qp AS INTEGER) AS q_phase, CAST(kp AS INTEGER) AS k_phase, round(avg(s), 6) AS w FROM s GROUP BY ALL""")
def m17_denoised_attention(spark, sf_dir):
    t = tokens(spark, sf_dir).select("response_id", "pos", "entropy", "nlp")
    phase = F.floor(F.col("pos") / 20).cast("int")
    cells = t.select("response_id", F.col("pos").alias("q"), F.col("pos").alias("k"), phase.alias("q_phase"), (phase % 2).alias("k_phase"), F.array(F.col("entropy") / 500, F.col("nlp") / 10, (F.col("pos") % 3) / 3).alias("heads"))
    return rounded(D.denoised_attention(cells), "w")


@query("SELECT CAST(n_nationkey AS BIGINT) AS iteration, 'ckpt--iter_' || n_nationkey AS checkpoint, 'episodes__iter' || n_nationkey AS episodes FROM nation WHERE n_nationkey % 2 = 0")
def j16_checkpoints_with_episodes(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"))
    path = lambda head, df: df.select(F.concat(F.lit(head), "k").alias("path"))
    out = J.checkpoints_with_episodes(path("ckpt--iter_", n), path("episodes__iter", n.where("k % 2 = 0")))
    return out.select("iteration", "checkpoint", "episodes")


# -- sources, sinks, sets


@query("SELECT doc_id, 'aime_2025' AS data_source, lang AS answer, CASE WHEN doc_id % 2 = 0 THEN 'I' ELSE 'II' END AS config, CAST(CASE WHEN doc_id % 2 = 0 THEN r ELSE r + e END AS VARCHAR) AS idx FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) - 1 AS r, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS e FROM documents)")
def s9_evaluation_sets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("question"), F.array("lang").alias("answer"))
    d = d.withColumn("i", F.row_number().over(W.partitionBy(F.col("doc_id") % 2).orderBy("doc_id")) - 1)
    r = readers.load_evaluation("aime_2025", ("I", d.where("doc_id % 2 = 0")), ("II", d.where("doc_id % 2 = 1")), index="i")
    info = F.col("extra_info")
    return r.select(X.first_user_message(F.col("prompt")).cast("long").alias("doc_id"), "data_source", F.col("reward_model.ground_truth").alias("answer"), info["config"].alias("config"), info["index"].alias("idx"))


@query("SELECT r_regionkey, n_files FROM (SELECT r_regionkey, 1::BIGINT AS n_files FROM region)")
def s7_s10_k6_folder_of_checkpoints(spark, sf_dir):
    folder = writers.scratch(spark, "checkpoints")
    table(spark, sf_dir, "region").select("r_regionkey", "r_name").repartition(1).write.partitionBy("r_regionkey").parquet(f"{folder}/deep/down")
    files = readers.read_folder(spark, folder)
    there = readers.read_first(spark, [f"{folder}/missing", f"{folder}/deep/down"]).select("r_regionkey")
    number = F.regexp_extract("path", r"r_regionkey=(\d+)", 1).cast("int")
    return files.groupBy(number.alias("r_regionkey")).agg(F.count("*").alias("n_files")).join(there.distinct(), "r_regionkey")


@query("SELECT dataset, n, mean_score, error FROM (VALUES ('bad', NULL::BIGINT, NULL::DOUBLE, 'ValueError')) v(dataset, n, mean_score, error) UNION ALL SELECT 'orders', count(*), round(avg(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'P' THEN 0.5 ELSE 0.0 END), 6), NULL FROM orders")
def k3_results_and_summary(spark, sf_dir):
    def bad():
        raise ValueError("no such dataset")

    out = writers.write_evaluations({"orders": lambda: rollouts(spark, sf_dir), "bad": bad}, writers.scratch(spark, "evaluations"), spark)
    return rounded(out, "mean_score")


@query(f"WITH {ROLLOUTS} SELECT problem_id, idx, CASE WHEN answer = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM roll")
def k4_g5_rescored(spark, sf_dir):
    path = writers.scratch(spark, "results")
    rollouts(spark, sf_dir).withColumn("old_scores", F.col("score")).write.parquet(path)
    writers.rewrite(spark, path, lambda df: df.withColumn("score", F.when(F.col("answer") == "O", 1.0).otherwise(0.0)).drop("old_scores"))
    return spark.read.parquet(path).select("problem_id", "idx", "score")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 0")
def u6_intersection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id"))


# -- loops


@query("SELECT o_orderkey AS edge_id FROM orders ORDER BY md5('0:' || o_orderkey), o_orderkey LIMIT 512")
def z2_pooled_edges(spark, sf_dir):
    return loops.pooled(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge_id")))


@query("SELECT n_nationkey, CAST(n_nationkey + 0 + 1 + 3 AS BIGINT) AS total FROM nation")
def z5_s14_resumed_loop(spark, sf_dir):
    start = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").cast("long").alias("total"))
    folder = writers.scratch(spark, "loop")

    def step(state, k):
        if k == 4:
            raise loops.EarlyStop
        return None if k == 2 else state.withColumn("total", F.col("total") + k)

    loops.iterate(spark, folder, start, step, 6, stop_at=2)
    return loops.iterate(spark, folder, start.where("false"), step, 6)


@query("WITH b AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) AS r FROM orders) SELECT o_orderkey AS episode_id, r > 300 AS carried FROM b")
def z6_leftover_episodes(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode_id"))
    now, later = loops.with_leftovers(e.where("episode_id % 5 = 0"), e.where("episode_id % 5 <> 0"), 300, seed=7)
    return now.withColumn("carried", F.lit(False)).unionByName(later.withColumn("carried", F.lit(True)))


@query("""WITH q AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(c_custkey % 5 AS VARCHAR) END AS answer FROM customer), a AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS attempt, CAST(o_orderkey % 5 AS VARCHAR) AS text FROM orders)
SELECT c_custkey AS question_id, 'cached' AS text FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT c_custkey, arg_min(text, attempt) FROM q JOIN a ON o_custkey = c_custkey WHERE c_custkey % 10 <> 0 AND answer <> '' AND attempt < 3 AND text = answer GROUP BY c_custkey""")
def z7_golden_cache(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"))
    answer = F.when(F.col("question_id") % 7 == 0, "").otherwise((F.col("question_id") % 5).cast("string"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question_id"), "o_orderkey")
    attempts = o.select("question_id", (F.row_number().over(W.partitionBy("question_id").orderBy("o_orderkey")) - 1).alias("attempt"), (F.col("o_orderkey") % 5).cast("string").alias("text"))
    cache = customers.where("question_id % 10 = 0").withColumn("text", F.lit("cached"))
    return loops.answered(cache, customers.withColumn("answer", answer), attempts, F.col("text") == F.col("answer"))

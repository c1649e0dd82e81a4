"""Queries on tokens, phases and advantages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import advantages as A
from ..operators import episodes as E
from ..operators import phases as P
from ..operators import rewards as R
from .rollouts import OUTCOMES, TOKENS, outcomes, tokens

WIDTH, PERCENTILE, GAP, MOST = 5, 80.0, 5, 6
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


def _joined(boundaries):
    return boundaries.select("response_id", F.array_join(F.transform("boundaries", lambda b: b.cast("string")), ",").alias("boundaries"))


_GREEDY = """
{name}_r AS (SELECT response_id, pos, row_number() OVER (PARTITION BY response_id ORDER BY score DESC, pos) AS r FROM {cand}),
{name}_g AS (
  SELECT response_id, 0::BIGINT AS r, [0] AS chosen FROM (SELECT DISTINCT response_id FROM tok)
  UNION ALL
  SELECT g.response_id, c.r, CASE WHEN len(g.chosen) < {most} AND list_min(list_transform(g.chosen, lambda b: abs(b - c.pos))) >= {gap} THEN list_append(g.chosen, c.pos) ELSE g.chosen END
  FROM {name}_g g JOIN {name}_r c ON c.response_id = g.response_id AND c.r = g.r + 1),
{name} AS (SELECT response_id, list_sort(arg_max(chosen, r)) AS boundaries FROM {name}_g GROUP BY response_id)"""

_SLIDING = f"""
win AS (SELECT *, CASE WHEN count(*) OVER w = {WIDTH} THEN avg(entropy) OVER w END AS score FROM tok WINDOW w AS (PARTITION BY response_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING)),
lim AS (SELECT response_id, quantile_cont(score, {PERCENTILE / 100}) AS lim FROM win GROUP BY response_id),
cand AS (SELECT w.response_id, w.pos, w.score FROM win w JOIN lim l USING (response_id) WHERE w.score > l.lim),
{_GREEDY.format(name='bnd', cand='cand', most=MOST, gap=GAP)}"""

_PHASED = f"""{_SLIDING},
opens AS (SELECT response_id, unnest(boundaries) AS pos FROM bnd),
phased AS (
  SELECT t.*, count(o.pos) OVER (PARTITION BY t.response_id ORDER BY t.pos) - 1 AS phase_id
  FROM tok t LEFT JOIN opens o ON o.response_id = t.response_id AND o.pos = t.pos)"""

_PHASES = f"""{_PHASED},
ph AS (
  SELECT group_id, response_id, phase_id, sum(entropy * pow(0.95, pos - first)) AS phase_entropy
  FROM (SELECT *, min(pos) OVER (PARTITION BY response_id, phase_id) AS first FROM phased) GROUP BY ALL),
lim2 AS (
  SELECT ph.group_id, max(phase_entropy) AS highest, coalesce(max(CASE WHEN outcome >= 1 THEN phase_entropy END), quantile_cont(phase_entropy, 0.9)) AS lim
  FROM ph JOIN outc USING (response_id) GROUP BY ph.group_id),
raw AS (
  SELECT ph.*, outcome, least(1.0, (lim - phase_entropy) / (highest - lim + 1e-8)) AS raw, count(*) OVER (PARTITION BY response_id) AS n,
    CASE WHEN outcome >= 1 THEN 1.0 WHEN outcome > 0 THEN 0.1 ELSE -1.0 END AS total
  FROM ph JOIN outc USING (response_id) JOIN lim2 ON lim2.group_id = ph.group_id),
rew AS (SELECT group_id, response_id, phase_id, phase_entropy, outcome, CASE WHEN n <= 1 THEN total ELSE raw + total / n - avg(raw) OVER (PARTITION BY response_id) END AS phase_reward FROM raw),
loc AS (
  SELECT *, CASE WHEN count(*) OVER r > 1 THEN (phase_reward - avg(phase_reward) OVER r) / (sqrt(var_pop(phase_reward) OVER r + 1e-8) + 1e-8) ELSE 0.0 END AS local
  FROM rew WINDOW r AS (PARTITION BY response_id)),
glo AS (
  SELECT response_id, (score - avg(score) OVER g) / (coalesce(stddev_samp(score) OVER g, 0) + 1e-8) AS global
  FROM (SELECT group_id, response_id, avg(phase_reward) AS score FROM rew GROUP BY ALL) WINDOW g AS (PARTITION BY group_id)),
adv AS (SELECT loc.*, global, local + global AS advantage FROM loc JOIN glo USING (response_id))"""


def _boundaries(spark, sf_dir):
    return P.sliding_boundaries(tokens(spark, sf_dir), "entropy", WIDTH, PERCENTILE, GAP, MOST)


def _phases(spark, sf_dir):
    t = tokens(spark, sf_dir)
    phased = P.assign(t, _boundaries(spark, sf_dir))
    return phased, R.discounted_entropy(phased).join(outcomes(spark, sf_dir).select("response_id", "outcome"), "response_id")


def _rewarded(spark, sf_dir):
    phased, phases = _phases(spark, sf_dir)
    return phased, R.entropy_credit(phases)


@query(f"WITH RECURSIVE {TOKENS}, {_SLIDING} SELECT response_id, pos, round(score, 6) AS mean FROM win WHERE score IS NOT NULL")
def w1_sliding_window_means(spark, sf_dir):
    return rounded(P.sliding_means(tokens(spark, sf_dir), "entropy", WIDTH).where("mean is not null").select("response_id", "pos", "mean"), "mean")


@query(f"WITH RECURSIVE {TOKENS}, {_SLIDING} SELECT response_id, array_to_string(boundaries, ',') AS boundaries FROM bnd")
def w2_sliding_boundaries(spark, sf_dir):
    return _joined(_boundaries(spark, sf_dir))


@query(f"""WITH RECURSIVE {TOKENS},
thr_r AS (SELECT response_id, pos, row_number() OVER (PARTITION BY response_id ORDER BY pos) AS r FROM tok WHERE nlp > 4.0),
thr_g AS (
  SELECT response_id, 0::BIGINT AS r, [0] AS chosen FROM (SELECT DISTINCT response_id FROM tok)
  UNION ALL
  SELECT g.response_id, c.r, CASE WHEN c.pos - g.chosen[-1] >= 5 THEN list_append(g.chosen, c.pos) ELSE g.chosen END FROM thr_g g JOIN thr_r c ON c.response_id = g.response_id AND c.r = g.r + 1)
SELECT response_id, array_to_string(arg_max(chosen, r), ',') AS boundaries FROM thr_g GROUP BY response_id""")
def w3_threshold_boundaries(spark, sf_dir):
    return _joined(P.threshold_boundaries(tokens(spark, sf_dir), "nlp", 4.0, 5))


@query(f"""WITH RECURSIVE {TOKENS},
nb AS (SELECT *, lag(nlp) OVER w AS before, lead(nlp) OVER w AS after FROM tok WINDOW w AS (PARTITION BY response_id ORDER BY pos)),
lim AS (SELECT response_id, quantile_cont(nlp, 0.7) AS lim FROM tok GROUP BY response_id),
cand AS (SELECT n.response_id, n.pos, n.nlp AS score FROM nb n JOIN lim USING (response_id) WHERE nlp > lim AND nlp >= before AND nlp >= after),
{_GREEDY.format(name='bnd', cand='cand', most=10, gap=5)}
SELECT response_id, array_to_string(boundaries, ',') AS boundaries FROM bnd""")
def w4_peak_boundaries(spark, sf_dir):
    return _joined(P.peak_boundaries(tokens(spark, sf_dir), "nlp", 70.0, 5, 10))


_THINK = f"""WITH RECURSIVE {TOKENS},
te AS (SELECT response_id, min(pos) + 1 AS think_end FROM tok WHERE token = 'signup' GROUP BY response_id),
span AS (SELECT t.response_id, min(pos) AS start, max(pos) + 1 AS fin, any_value(think_end) AS think_end FROM tok t LEFT JOIN te USING (response_id) GROUP BY ALL),
sp AS (SELECT *, CASE WHEN think_end > start THEN think_end ELSE fin END AS stop FROM span),
th AS (SELECT t.*, coalesce(sum(CASE WHEN token = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY response_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM tok t JOIN sp USING (response_id) WHERE pos < stop),
spans AS (SELECT response_id, sent, min(pos) AS a, max(pos) + 1 AS b, row_number() OVER (PARTITION BY response_id ORDER BY sent) AS r FROM th GROUP BY response_id, sent),
mg AS (
  SELECT response_id, r, a, b, 1::BIGINT AS nr FROM spans WHERE r = 1
  UNION ALL
  SELECT m.response_id, s.r, CASE WHEN s.a - m.a < 3 THEN m.a ELSE s.a END, s.b, CASE WHEN s.a - m.a < 3 THEN m.nr ELSE m.nr + 1 END FROM mg m JOIN spans s ON s.response_id = m.response_id AND s.r = m.r + 1),
sents AS (SELECT response_id, nr - 1 AS nr, min(a) AS a, max(b) AS b FROM mg GROUP BY response_id, nr),
sc AS (SELECT s.response_id, s.nr, s.a, avg(t.entropy) AS mean FROM sents s JOIN th t ON t.response_id = s.response_id AND t.pos >= s.a AND t.pos < s.a + greatest(1, (s.b - s.a) // 3) GROUP BY ALL),
lm AS (SELECT response_id, quantile_cont(mean, 0.6) AS lim FROM sc GROUP BY response_id),
rk AS (SELECT sc.response_id, a, row_number() OVER (PARTITION BY sc.response_id ORDER BY mean DESC, a) AS rank FROM sc JOIN lm USING (response_id) WHERE nr > 0 AND mean > lim)"""


@query(f"{_THINK} SELECT response_id, nr, a, b FROM sents")
def w8_sentence_spans(spark, sf_dir):
    t = tokens(spark, sf_dir)
    ends = P.think_ends(t, marker="signup")
    last = t.groupBy("response_id").agg((F.max("pos") + 1).cast("int").alias("end"))
    stop = last.join(ends, "response_id", "left").select("response_id", F.coalesce("think_end", "end").alias("stop"))
    s = P.sentences(t.join(stop, "response_id").where("pos < stop"), F.col("token") == "error", 3)
    return s.select("response_id", F.posexplode("sentences").alias("nr", "s")).select("response_id", F.col("nr").cast("long").alias("nr"), "s.a", "s.b")


_PICK = """{think} SELECT sp.response_id, array_to_string(list_sort(list_distinct(list_concat([sp.start],
  coalesce((SELECT list(a) FROM rk WHERE rk.response_id = sp.response_id AND rk.rank <= {room}), []),
  CASE WHEN think_end > start AND think_end < fin THEN [think_end] ELSE [] END))), ',') AS boundaries FROM sp"""


@query(_PICK.format(think=_THINK, room="6 - 1 - CASE WHEN think_end > start AND think_end < fin THEN 1 ELSE 0 END"))
def w6_entropy_sentence_boundaries(spark, sf_dir):
    return _joined(P.sentence_boundaries(tokens(spark, sf_dir), F.col("token") == "error", "entropy", 60.0, 3, 6, "signup"))


@query(_PICK.format(think=_THINK, room="6 - 1 - CASE WHEN think_end IS NOT NULL THEN 1 ELSE 0 END"))
def w5_adaptive_sentence_boundaries(spark, sf_dir):
    return _joined(P.sentence_boundaries(tokens(spark, sf_dir), F.col("token") == "error", "entropy", 60.0, 3, 6, "signup", reserve=False))


@query(f"WITH {TOKENS} SELECT response_id, CAST(min(pos) + 1 AS INTEGER) AS think_end FROM tok WHERE token = 'signup' GROUP BY response_id")
def w9_think_boundary(spark, sf_dir):
    return P.think_ends(tokens(spark, sf_dir), marker="signup")


@query(f"WITH RECURSIVE {TOKENS}, {_PHASED} SELECT response_id, pos, CAST(phase_id AS INTEGER) AS phase_id FROM phased")
def w10_j4_token_phases(spark, sf_dir):
    return P.assign(tokens(spark, sf_dir), _boundaries(spark, sf_dir)).select("response_id", "pos", "phase_id")


@query(f"""WITH RECURSIVE {TOKENS}, {_SLIDING}, e AS (SELECT response_id, max(pos) + 1 AS fin FROM tok GROUP BY response_id)
SELECT b.response_id, CAST(i - 1 AS INTEGER) AS phase_id, boundaries[i] AS phase_start, CAST(coalesce(boundaries[i + 1], fin) AS INTEGER) AS phase_end
FROM (SELECT *, unnest(range(1, len(boundaries) + 1)) AS i FROM bnd) b JOIN e USING (response_id)""")
def a1_phase_segments(spark, sf_dir):
    return P.segments(_boundaries(spark, sf_dir)).select("response_id", "phase_id", "phase_start", "phase_end")


@query(f"WITH RECURSIVE {TOKENS}, {OUTCOMES}, {_PHASES} SELECT group_id, response_id, CAST(phase_id AS INTEGER) AS phase_id, round(phase_entropy, 3) AS phase_entropy FROM ph")
def g22_discounted_phase_entropy(spark, sf_dir):
    return rounded(_phases(spark, sf_dir)[1].select("group_id", "response_id", "phase_id", "phase_entropy"), "phase_entropy", digits=3)


@query(f"WITH RECURSIVE {TOKENS}, {OUTCOMES}, {_PHASES} SELECT response_id, CAST(phase_id AS INTEGER) AS phase_id, round(phase_reward, 4) AS phase_reward FROM rew")
def g23_entropy_credit_rewards(spark, sf_dir):
    return rounded(_rewarded(spark, sf_dir)[1].select("response_id", "phase_id", "phase_reward"), "phase_reward", digits=4)


@query(f"WITH RECURSIVE {TOKENS}, {OUTCOMES}, {_PHASES} SELECT response_id, CAST(phase_id AS INTEGER) AS phase_id, round(local, 4) AS local, round(global, 4) AS global, round(advantage, 4) AS advantage FROM adv")
def phase_advantages(spark, sf_dir):
    out = A.phase_advantages(_rewarded(spark, sf_dir)[1])
    return rounded(out.select("response_id", "phase_id", "local", "global", "advantage"), "local", "global", "advantage", digits=4)


@query(f"WITH RECURSIVE {TOKENS}, {OUTCOMES}, {_PHASES} SELECT response_id, CAST(phase_id AS INTEGER) AS phase_id, round(0.3 * local + 0.7 * global, 4) AS advantage FROM adv")
def g15_blended_phase_advantages(spark, sf_dir):
    return rounded(A.phase_advantages(_rewarded(spark, sf_dir)[1], alpha=0.3).select("response_id", "phase_id", "advantage"), "advantage", digits=4)


@query(f"""WITH RECURSIVE {TOKENS}, {OUTCOMES}, {_PHASES}, n AS (SELECT response_id, count(*) AS n FROM adv GROUP BY response_id)
SELECT p.response_id, p.pos, round((a.advantage / 3 + a.advantage / 2 * pow(0.9, row_number() OVER (PARTITION BY p.response_id, p.phase_id ORDER BY p.pos) - 1)) / n.n, 4) AS token_advantage
FROM phased p JOIN adv a ON a.response_id = p.response_id AND a.phase_id = p.phase_id JOIN n ON n.response_id = p.response_id""")
def w11_w12_token_advantages(spark, sf_dir):
    phased, rewarded = _rewarded(spark, sf_dir)
    out = A.to_tokens(phased, A.phase_advantages(rewarded))
    return rounded(out.select("response_id", "pos", "token_advantage"), "token_advantage", digits=4)


_JUDGED = f"""WITH RECURSIVE {TOKENS}, {OUTCOMES}, {_PHASES},
j AS (SELECT *, response_id % 3 <> 0 AS has_gold, avg(phase_reward) OVER (PARTITION BY response_id) AS judged FROM rew),
gm AS (SELECT group_id, avg(judged) AS m FROM (SELECT DISTINCT group_id, response_id, judged FROM j) GROUP BY group_id)"""


@query(f"""{_JUDGED} SELECT response_id, CAST(phase_id AS INTEGER) AS phase_id, round(
  CASE WHEN has_gold AND outcome >= 1 THEN greatest(phase_reward, 0.5)
       ELSE phase_reward * CASE WHEN has_gold THEN 0.3 WHEN judged >= m - 1e-12 THEN 0.5 ELSE 0.1 END END - 0.25, 4) AS phase_reward
FROM j JOIN gm USING (group_id)""")
def g21_judge_scaling(spark, sf_dir):
    rows = _rewarded(spark, sf_dir)[1].withColumn("has_gold", F.col("response_id") % 3 != 0).withColumn("overlong", F.lit(-0.25))
    return rounded(R.judge_scaled(rows).select("response_id", "phase_id", "phase_reward"), "phase_reward", digits=4)


@query(f"""WITH {OUTCOMES} SELECT response_id, round((outcome - avg(outcome) OVER g) / (stddev_pop(outcome) OVER g + 1e-8), 6) AS grpo,
  round(outcome - coalesce((sum(outcome) OVER g - outcome) / nullif(count(*) OVER g - 1, 0), 0), 6) AS rloo,
  round(CASE WHEN stddev_samp(outcome) OVER g > 1e-8 THEN (outcome - avg(outcome) OVER g) / (stddev_samp(outcome) OVER g + 1e-8) ELSE outcome - avg(outcome) OVER g END, 6) AS grpo_sample
FROM outc WINDOW g AS (PARTITION BY group_id)""")
def g16_g17_g18_group_advantages(spark, sf_dir):
    o = outcomes(spark, sf_dir)
    x = F.col("outcome")
    return rounded(o.select("response_id", A.grpo(x).alias("grpo"), A.leave_one_out(x).alias("rloo"), A.grpo_or_centred(x).alias("grpo_sample")), "grpo", "rloo", "grpo_sample")


@query(f"""WITH {OUTCOMES}, o2 AS (SELECT group_id, response_id, CASE WHEN group_id < 3 THEN least(outcome, 0.1) ELSE outcome END AS outcome FROM outc),
r AS (SELECT *, bool_or(outcome >= 1) OVER g AS right_, avg(outcome) OVER g AS m, coalesce(stddev_samp(outcome) OVER g, 0) AS s FROM o2 WINDOW g AS (PARTITION BY group_id))
SELECT response_id, CASE WHEN right_ THEN 'outcome' ELSE 'phase' END AS route, round(CASE WHEN right_ THEN (outcome - m) / (s + 1e-10) ELSE 0.0 END, 6) AS outcome_advantage FROM r""")
def g19_g20_hybrid_router(spark, sf_dir):
    o = outcomes(spark, sf_dir).withColumn("outcome", F.when(F.col("group_id") < 3, F.least("outcome", F.lit(0.1))).otherwise(F.col("outcome")))
    return rounded(A.hybrid(o).select("response_id", "route", "outcome_advantage"), "outcome_advantage")


@query(f"WITH {TOKENS} SELECT response_id, pos, round(nlp / greatest(sum(nlp) OVER (PARTITION BY response_id), 1e-8), 8) AS weight FROM tok")
def w14_token_weights(spark, sf_dir):
    return rounded(A.token_weights(tokens(spark, sf_dir)).select("response_id", "pos", "weight"), "weight", digits=8)


@query(f"""WITH {TOKENS}, {OUTCOMES},
r AS (SELECT t.response_id, pos, entropy / 100 AS v, -0.1 * nlp + CASE WHEN pos = max(pos) OVER p THEN outcome ELSE 0 END AS r FROM tok t JOIN outc USING (response_id) WINDOW p AS (PARTITION BY t.response_id)),
d AS (SELECT response_id, pos, r + 0.99 * coalesce(lead(v) OVER (PARTITION BY response_id ORDER BY pos), 0) - v AS d FROM r)
SELECT a.response_id, a.pos, round(sum(b.d * pow(0.99 * 0.9, b.pos - a.pos)), 5) AS advantage FROM d a JOIN d b ON a.response_id = b.response_id AND b.pos >= a.pos GROUP BY ALL""")
def w16_w17_generalised_advantages(spark, sf_dir):
    t = tokens(spark, sf_dir).join(outcomes(spark, sf_dir).select("response_id", "outcome"), "response_id")
    t = E.token_rewards(t.select("response_id", "pos", "entropy", F.col("nlp").alias("kl"), F.col("outcome").alias("score")), 0.1)
    rows = t.groupBy("response_id").agg(F.sort_array(F.collect_list(F.struct("pos", "reward", (F.col("entropy") / 100).alias("value")))).alias("x"))
    gae = A.generalised(F.transform("x", lambda y: y["reward"]), F.transform("x", lambda y: y["value"]), 0.99, 0.9)
    return rows.select("response_id", F.posexplode(gae).alias("pos", "advantage")).select("response_id", "pos", F.round("advantage", 5).alias("advantage"))


_PROB = f"WITH {TOKENS}, pr AS (SELECT response_id, pos, 1 / (1 + entropy / 10) AS prob FROM tok)"


def _probabilities(spark, sf_dir):
    return tokens(spark, sf_dir).select("response_id", "pos", (1 / (1 + F.col("entropy") / 10)).alias("prob"))


@query(f"""{_PROB} SELECT response_id, CAST(pos AS BIGINT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY pos) - 1 AS r FROM pr WHERE prob < 0.5) WHERE r % 3 = 0
UNION ALL SELECT DISTINCT response_id, CAST(-1 AS BIGINT) FROM pr""")
def w18_cut_points(spark, sf_dir):
    return E.cut_points(_probabilities(spark, sf_dir), 0.5, 3)


@query(f"""{_PROB}, v AS (SELECT response_id, pos, prob, CASE WHEN pos % 4 = 3 THEN prob * 2 END AS value FROM pr),
k AS (SELECT response_id, pos, coalesce(value - lag(value) OVER (PARTITION BY response_id ORDER BY pos), 0) AS step FROM v WHERE value IS NOT NULL)
SELECT v.response_id, v.pos, round(CASE WHEN prob > 0.9 THEN 0.0 ELSE coalesce((SELECT step FROM k WHERE k.response_id = v.response_id AND k.pos >= v.pos ORDER BY k.pos LIMIT 1), 0) END, 6) AS advantage FROM v""")
def w19_cut_point_advantages(spark, sf_dir):
    t = _probabilities(spark, sf_dir).withColumn("value", F.when(F.col("pos") % 4 == 3, F.col("prob") * 2))
    return rounded(A.from_cutpoints(t).select("response_id", "pos", "advantage"), "advantage")


@query(f"WITH {TOKENS}, n AS (SELECT response_id, pos, ntile(4) OVER (PARTITION BY response_id ORDER BY pos) AS tile FROM tok) SELECT response_id, CAST(tile AS INTEGER) AS tile, max(pos) AS pos FROM n WHERE tile < 4 GROUP BY ALL")
def w20_chunk_ends(spark, sf_dir):
    return E.chunk_ends(tokens(spark, sf_dir))


@query(f"WITH {TOKENS}, n AS (SELECT *, lead(token) OVER (PARTITION BY response_id ORDER BY pos) AS nx FROM tok) SELECT response_id, pos, token FROM n WHERE nx IS NULL OR nx <> token")
def w22_run_ends(spark, sf_dir):
    return E.run_ends(tokens(spark, sf_dir), "token").select("response_id", "pos", "token")


@query(f"""WITH RECURSIVE {TOKENS}, s AS (SELECT response_id, pos AS step, logprob / 10 AS reward, CASE WHEN pos % 3 < 2 THEN entropy / 50 END AS value, row_number() OVER (PARTITION BY response_id ORDER BY pos DESC) AS r FROM tok),
f AS (SELECT response_id, r, coalesce(value, reward) AS filled FROM s WHERE r = 1 UNION ALL SELECT s.response_id, s.r, coalesce(s.value, s.reward + f.filled) FROM f JOIN s ON s.response_id = f.response_id AND s.r = f.r + 1)
SELECT s.response_id, s.step, round(s.reward + coalesce(n.filled, 0) - f.filled, 6) AS advantage FROM s JOIN f ON f.response_id = s.response_id AND f.r = s.r LEFT JOIN f n ON n.response_id = s.response_id AND n.r = s.r - 1""")
def w21_step_advantages(spark, sf_dir):
    t = tokens(spark, sf_dir).select("response_id", F.col("pos").alias("step"), (F.col("logprob") / 10).alias("reward"), F.when(F.col("pos") % 3 < 2, F.col("entropy") / 50).alias("value"))
    return rounded(A.step_advantages(t).select("response_id", "step", "advantage"), "advantage")


@query(f"""WITH {TOKENS}, {OUTCOMES} SELECT t.response_id, pos, round(CASE WHEN pos < 20 THEN entropy / 100 ELSE 1.5 * outcome * pow(0.9, pos - 20) END, 6) AS advantage FROM tok t JOIN outc USING (response_id)""")
def w13_stitched_advantages(spark, sf_dir):
    t = tokens(spark, sf_dir).join(outcomes(spark, sf_dir).select("response_id", "outcome"), "response_id")
    value = R.stitched(1.5 * F.col("outcome"), F.col("pos"), F.lit(20), 0.9, F.col("entropy") / 100)
    return t.select("response_id", "pos", F.round(value, 6).alias("advantage"))


@query(f"""WITH RECURSIVE {TOKENS}, {OUTCOMES}, {_PHASES}, c AS (SELECT response_id, count(*) AS n FROM rew GROUP BY response_id)
SELECT response_id, CAST(phase_id AS INTEGER) AS phase_id, round(outcome / n, 6) AS uniform, CASE WHEN phase_id = n - 1 THEN outcome ELSE 0.5 END AS by_rule, round(outcome * CASE WHEN phase_id < 1 THEN 0 ELSE pow(0.9, phase_id - 1) END, 6) AS stitched
FROM rew JOIN c USING (response_id)""")
def a20_a21_a22_simple_phase_rewards(spark, sf_dir):
    p = _phases(spark, sf_dir)[1].withColumn("n", F.count("*").over(W.partitionBy("response_id")))
    return p.select(
        "response_id", "phase_id", F.round(R.uniform(F.col("outcome"), F.col("n")), 6).alias("uniform"), R.by_rule(F.col("outcome"), F.col("phase_id"), F.col("n")).alias("by_rule"),
        F.round(R.stitched(F.col("outcome"), F.col("phase_id"), F.lit(1)), 6).alias("stitched"),
    )


_ATT = f"WITH {TOKENS}, att AS (SELECT response_id, pos // 20 AS q_phase, k AS k_phase, avg(entropy * (k + 1)) AS w FROM tok, LATERAL (SELECT unnest(range(0, pos // 20 + 1)) AS k) GROUP BY ALL)"


@query(f"""{_ATT}, i AS (SELECT response_id, q_phase - 1 AS i, k_phase AS j, w FROM att WHERE q_phase >= 1 AND k_phase <= q_phase - 1)
SELECT response_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(w / sum(w) OVER (PARTITION BY response_id, i), 6) AS a FROM i""")
def m14_influence_matrix(spark, sf_dir):
    t = tokens(spark, sf_dir).withColumn("q_phase", F.floor(F.col("pos") / 20).cast("int"))
    att = t.withColumn("k_phase", F.explode(F.sequence(F.lit(0), "q_phase")))
    att = att.groupBy("response_id", "q_phase", "k_phase").agg(F.avg(F.col("entropy") * (F.col("k_phase") + 1)).alias("w"))
    return rounded(R.influence(att, "row").select("response_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "a"), "a")

"""Advantages of responses, phases and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import let


def _group():
    return W.partitionBy("group_id")


def _response():
    return W.partitionBy("response_id")


def grpo(score: Column, over=None, eps: float = 1e-8) -> Column:
    """z-score in the group, population deviation."""
    over = over or _group()
    return (score - F.avg(score).over(over)) / (F.stddev_pop(score).over(over) + eps)


def leave_one_out(score: Column, over=None) -> Column:
    """score less the mean of the others of the group (0 if there are none)."""
    over = over or _group()
    others = F.count(score).over(over) - 1
    return score - F.coalesce((F.sum(score).over(over) - score) / F.nullif(others, F.lit(0)), F.lit(0.0))


def grpo_or_centred(score: Column, by_deviation: bool = True, over=None, eps: float = 1e-8) -> Column:
    """z-score by the sample deviation where it exceeds eps, else only centred."""
    over = over or _group()
    deviation = F.stddev_samp(score).over(over)
    centred = score - F.avg(score).over(over)
    return F.when(F.lit(by_deviation) & (F.coalesce(deviation, F.lit(0.0)) > eps), centred / (deviation + eps)).otherwise(centred)


def local_advantages(phases: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Phase reward against the other phases of its response."""
    r = F.col("phase_reward")
    z = (r - F.avg(r).over(_response())) / (F.sqrt(F.var_pop(r).over(_response()) + eps) + eps)
    return phases.withColumn("local", F.when(F.count(r).over(_response()) > 1, z).otherwise(0.0))


def global_advantages(phases: DataFrame, eps: float = 1e-8) -> DataFrame:
    """The response's mean phase reward against its group; phases is read once, the group sees a row a response."""
    score = phases.groupBy("group_id", "response_id").agg(F.avg("phase_reward").alias("score"))
    deviation = F.coalesce(F.stddev_samp("score").over(_group()), F.lit(0.0))
    z = (F.col("score") - F.avg("score").over(_group())) / (deviation + eps)
    return phases.join(score.select("response_id", z.alias("global")), "response_id")


def phase_advantages(phases: DataFrame, alpha: float | None = None, eps: float = 1e-8) -> DataFrame:
    """local + global, or alpha * local + (1 - alpha) * global."""
    both = global_advantages(local_advantages(phases, eps), eps)
    blend = F.col("local") + F.col("global") if alpha is None else alpha * F.col("local") + (1 - alpha) * F.col("global")
    return both.withColumn("advantage", blend)


def decayed(advantage: Column, offset: Column, gamma: float = 0.9, divide_by: Column | None = None) -> Column:
    """A third of the phase's advantage for each token, and a half that decays from the phase's start."""
    out = advantage / 3 + advantage / 2 * F.pow(F.lit(gamma), offset)
    return out if divide_by is None else out / divide_by


def to_tokens(phased: DataFrame, advantages: DataFrame, gamma: float = 0.9, divide: bool = True) -> DataFrame:
    """phased tokens with their advantage; 0 outside all phases."""
    offset = F.row_number().over(W.partitionBy("response_id", "phase_id").orderBy("pos")) - 1
    joined = phased.withColumn("offset", offset).join(advantages.select("response_id", "phase_id", "advantage", F.count("*").over(_response()).alias("n")), ["response_id", "phase_id"], "left")
    value = decayed(F.col("advantage"), F.col("offset"), gamma, F.col("n") if divide else None)
    return joined.withColumn("token_advantage", F.coalesce(value, F.lit(0.0))).drop("offset", "advantage", "n")


def hybrid(responses: DataFrame, threshold: float = 1.0, eps: float = 1e-10) -> DataFrame:
    """responses(group_id, response_id, outcome) with route ('outcome' if the group has a correct one, else 'phase')
    and the outcome advantage of the first kind."""
    right = F.coalesce(F.bool_or(F.col("outcome") >= threshold).over(_group()), F.lit(False))
    deviation = F.coalesce(F.stddev_samp("outcome").over(_group()), F.lit(0.0))
    z = (F.col("outcome") - F.avg("outcome").over(_group())) / (deviation + eps)
    return responses.withColumn("route", F.when(right, "outcome").otherwise("phase")).withColumn("outcome_advantage", F.when(right, z).otherwise(0.0))


def token_weights(tokens: DataFrame, beta: float = 1.0, eps: float = 1e-8) -> DataFrame:
    """(-logprob)**beta as a share of its response."""
    w = F.pow(F.greatest(-F.col("logprob"), F.lit(0.0)), F.lit(beta)) if beta else F.lit(1.0)
    return tokens.withColumn("weight", w / F.greatest(F.sum(w).over(_response()), F.lit(eps)))


#: Numbers that one fold takes: each of its steps copies what it has so far.
SCAN_BLOCK = 128


def decayed_sums(values: Column, decay: float) -> Column:
    """out[i] = values[i] + decay * out[i - 1] of an array: folds over blocks, and each block shifted by what the ones before leave it."""
    empty = "cast(array() as array<double>)"
    state = lambda last, out: F.struct(last.alias("last"), out.alias("out"))

    def scan(v: Column) -> Column:
        step = lambda s, d: state(d + decay * s["last"], F.concat(s["out"], F.array(d + decay * s["last"])))
        return F.aggregate(v, state(F.lit(0.0), F.expr(empty)), step, lambda s: s["out"])

    def carried(blocks: Column) -> Column:
        """What the blocks before leave each block."""
        step = lambda s, y: state(F.element_at(y, -1) + F.pow(F.lit(decay), F.size(y)) * s["last"], F.concat(s["out"], F.array(s["last"])))
        return F.aggregate(blocks, state(F.lit(0.0), F.expr(empty)), step, lambda s: s["out"])

    def shifted(blocks: Column) -> Column:
        whole = F.zip_with(blocks, carried(blocks), lambda y, before: F.transform(y, lambda x, i: x + F.pow(F.lit(decay), i + 1) * before))
        return F.flatten(whole)

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(SCAN_BLOCK)), lambda k: scan(F.slice(v, k + 1, F.lit(SCAN_BLOCK))))
    return let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), shifted)).otherwise(v))


def generalised(rewards: Column, values: Column, gamma: float = 1.0, lam: float = 0.95) -> Column:
    """Generalised advantage estimates of arrays, by one backward scan."""
    deltas = F.transform(rewards, lambda r, i: (r + gamma * F.coalesce(F.get(values, i + 1), F.lit(0.0)) - F.get(values, i)).cast("double"))
    return F.reverse(decayed_sums(F.reverse(deltas), gamma * lam))


def returns(rewards: Column, gamma: float = 1.0) -> Column:
    """Discounted rewards to go."""
    return generalised(rewards, F.transform(rewards, lambda _: F.lit(0.0)), gamma, 1.0)


def from_cutpoints(tokens: DataFrame, sure: float = 0.9, zero_sure: bool = True) -> DataFrame:
    """tokens(response_id, pos, prob, value; value known at cut points) with advantage: the step to the next known
    value, given to all tokens up to it; the first known value gives no step; 0 where prob exceeds sure."""
    ordered = W.partitionBy("response_id").orderBy("pos")
    known = tokens.where("value is not null").withColumn("step", F.col("value") - F.lag("value").over(ordered))
    known = known.select("response_id", "pos", F.coalesce("step", F.lit(0.0)).alias("step"))
    back = ordered.rowsBetween(0, W.unboundedFollowing)
    out = tokens.join(known, ["response_id", "pos"], "left").withColumn("step", F.first("step", ignorenulls=True).over(back))
    value = F.coalesce("step", F.lit(0.0))
    return out.withColumn("advantage", F.when(F.col("prob") > sure, 0.0).otherwise(value) if zero_sure else value).drop("step")


def step_advantages(steps: DataFrame) -> DataFrame:
    """steps(response_id, step, reward, value) with advantage reward + next value - value; null values at the tail are
    filled from behind by reward + next value, after the last comes 0."""
    after = W.partitionBy("response_id").orderBy("step").rowsBetween(0, W.unboundedFollowing)
    to_go = F.sum("reward").over(after)
    steps = steps.withColumn("_to_go", to_go)
    # up to the next known value only rewards count: what is to go here less what is to go there, plus that value
    known = F.first(F.when(F.col("value").isNotNull(), F.struct("_to_go", "value")), ignorenulls=True).over(after)
    steps = steps.withColumn("_known", known)
    filled = F.coalesce("value", F.col("_to_go") - F.coalesce("_known._to_go", F.lit(0.0)) + F.coalesce("_known.value", F.lit(0.0)))
    out = steps.withColumn("filled", filled)
    nxt = F.coalesce(F.lead("filled").over(W.partitionBy("response_id").orderBy("step")), F.lit(0.0))
    return out.withColumn("advantage", F.col("reward") + nxt - F.col("filled")).drop("_to_go", "_known")

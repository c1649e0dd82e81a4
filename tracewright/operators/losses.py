"""Losses and summaries of training episodes as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import kl


def direct_value_loss(episodes: DataFrame, beta: float, heaviest: float = 10.0) -> DataFrame:
    """episodes(log_ratio_ref, log_ratio_old, advantage), one row each with the summed log ratios: the mean of
    0.5 * weight * (beta * log_ratio_ref - advantage)**2, where the weight exp(log_ratio_old) is capped."""
    weight = F.exp("log_ratio_old")
    capped = F.least(weight, F.lit(heaviest))
    error = beta * F.col("log_ratio_ref") - F.col("advantage")
    return episodes.agg(
        F.avg(0.5 * capped * error * error).alias("loss"), F.avg("log_ratio_ref").alias("log_ratio"), F.avg("advantage").alias("advantage"),
        F.avg(capped).alias("weight"), F.avg((weight > heaviest).cast("double")).alias("clip_fraction"),
    )


def weighted_likelihood(tokens: DataFrame, key: str, reduction: str = "tokens", upscale: bool = False) -> DataFrame:
    """tokens(key, logprob, advantage), padding left out: the advantage-weighted negative log-likelihood.

    reduction "tokens" divides by all tokens, "instances" takes the mean over tokens of each instance and then over
    instances, "batch" divides the sum by the number of instances. upscale makes each instance's mean advantage 1.
    """
    each = tokens.groupBy(key).agg(F.count("*").alias("n"), F.sum("advantage").alias("a"), F.sum(-F.col("logprob") * F.col("advantage")).alias("nll"))
    if upscale:
        each = each.withColumn("nll", F.col("nll") * F.col("n") / F.col("a"))
    loss = {"tokens": F.sum("nll") / F.sum("n"), "instances": F.avg(F.col("nll") / F.col("n")), "batch": F.sum("nll") / F.count("*")}[reduction]
    return each.agg(loss.alias("loss"))


def adaptive_kl(divergences: Column, start: float, target: float, horizon: float, steps: float) -> Column:
    """The coefficients after each observed divergence, in order: each moves by the clipped relative error."""
    error = lambda d: F.greatest(F.lit(-0.2), F.least(F.lit(0.2), d / target - 1))
    return F.slice(F.aggregate(divergences, F.array(F.lit(start)), lambda out, d: F.concat(out, F.array(F.element_at(out, -1) * (1 + error(d) * steps / horizon)))), F.lit(2), F.greatest(F.size(divergences), F.lit(0)))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _after_query(x: Column, query_length: Column, drop_last: int = 0) -> Column:
    return F.slice(x, query_length, F.greatest(F.size(x) - query_length + 1 - drop_last, F.lit(0)))


def _flat_moments(name: str, x: Column) -> list[Column]:
    """Mean and population deviation over the elements of all arrays, from sums a row."""
    n, s, q = F.sum(F.size(x)), F.sum(_total(x)), F.sum(_total(F.transform(x, lambda v: v * v)))
    return [(s / n).alias(f"{name}_mean"), F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias(f"{name}_std")]


def episode_metrics(episodes: DataFrame) -> DataFrame:
    """episodes(leaf, score, query_length, actor, reference, advantages, values): one row of metrics.

    actor, reference and values are arrays over the whole sequence but its first token; the response starts at
    query_length. Scores count at leaves only, divergences over the whole sequence.
    """
    q = F.col("query_length")
    actor, reference = (_after_query(F.col(c), q) for c in ("actor", "reference"))
    length = F.size(actor)
    leaf = F.when(F.col("leaf"), F.col("score"))
    sums = lambda kind: _total(F.zip_with("actor", "reference", lambda a, b: kl(kind, a, b)))
    return episodes.agg(
        F.avg(leaf).alias("score_mean"), F.stddev_pop(leaf).alias("score_std"), F.avg(length).alias("length_mean"), F.stddev_pop(length).alias("length_std"),
        F.avg(_total(actor)).alias("actor_logprob"), F.avg(F.try_divide(_total(actor), length)).alias("actor_logprob_per_token"), F.avg(_total(reference)).alias("reference_logprob"),
        F.avg(F.try_divide(_total(reference), length)).alias("reference_logprob_per_token"), F.avg(sums("kl")).alias("kl_mean"), F.avg(sums("control_variate")).alias("control_variate_mean"),
        *_flat_moments("advantage", F.col("advantages")), *_flat_moments("value", _after_query(F.col("values"), q, 1)),
    )


def global_statistics(rows: DataFrame, value: str, mask: Column, unbiased: bool = False) -> DataFrame:
    """Mean, variance and count of the masked values over all partitions: partial sums, then one merge."""
    x = F.when(mask, F.col(value))
    return rows.agg(F.avg(x).alias("mean"), (F.var_samp(x) if unbiased else F.var_pop(x)).alias("variance"), F.count(x).alias("n"))


def character_to_token_advantages(texts: Column, advantages: Column, starts: Column, chopped: Column) -> Column:
    """Advantages of tokens by the node that holds their first character; the first token goes, the end token copies the last.

    Lines are put around nodes as the tree has them: a line break before the first node, and after all but the last.
    """
    n = F.size(texts)
    shown = F.transform(texts, lambda t, i: F.concat(F.when(i == 0, "\n").otherwise(""), t, F.when(i < n - 1, "\n").otherwise("")))
    ends = F.aggregate(shown, F.expr("cast(array() as array<int>)"), lambda out, t: F.concat(out, F.array(F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), out), -1), F.lit(0)) + F.length(t))))
    node = lambda s: F.size(F.filter(ends, lambda e: e <= s))
    tokens = F.transform(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), lambda s: F.get(advantages, node(s)))
    return F.when(chopped, tokens).otherwise(F.concat(tokens, F.array(F.element_at(tokens, -1))))


def shifted_logprobs(logprobs: Column, query_length: Column, longest: int, pad: float) -> Column:
    """Log-probabilities of the response in the frame of a padded batch: pads over the query, and up to longest - 1."""
    pads = lambda k: F.array_repeat(F.lit(pad), k.cast("int"))
    return F.concat(pads(query_length - 1), _after_query(logprobs, query_length), pads(longest - 1 - F.size(logprobs)))


def rectangle(values: Column, width: int, pad: float) -> Column:
    """A ragged row as (padded values, mask) of one width."""
    rest = F.greatest(width - F.size(values), F.lit(0))
    return F.struct(F.concat(F.slice(values, F.lit(1), F.lit(width)), F.array_repeat(F.lit(pad), rest)).alias("values"), F.concat(F.array_repeat(F.lit(1), F.least(F.size(values), F.lit(width))), F.array_repeat(F.lit(0), rest)).alias("mask"))

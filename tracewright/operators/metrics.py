"""Evaluation metrics of sampled responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.maths import pass_at_k
from .ranks import concordant

KS = (1, 2, 4, 8, 16, 32, 64)


def per_problem(rollouts: DataFrame, correct_above: float = 0.5) -> DataFrame:
    """rollouts(problem_id, score): n, n_correct and mean score of each problem."""
    return rollouts.groupBy("problem_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") > correct_above).alias("n_correct"), F.avg("score").alias("mean_score"))


def evaluation(problems: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row: accuracy, avg_at_n, maj_at_n, and pass_at_k and pass_at_k_unbiased of every k, over the problems with k samples."""
    n, c = F.col("n"), F.col("n_correct")
    out = [
        F.count("*").alias("n_problems"),
        F.avg((c > 0).cast("double")).alias("accuracy"),
        F.avg("mean_score").alias("avg_at_n"),
        F.avg((c > n / 2).cast("double")).alias("maj_at_n"),
    ]
    for k in ks:
        out.append(F.avg(F.when(n >= k, pass_at_k(n, c, k))).alias(f"pass_at_{k}"))
        out.append(F.avg(F.when(n >= k, pass_at_k(n, c, k, unbiased=True))).alias(f"pass_at_{k}_unbiased"))
    return problems.agg(*out)


def answer_votes(answers: DataFrame) -> DataFrame:
    """answers(problem_id, idx, answer, correct), per problem: once_hit, correct_frac, majority_correct (of the most
    frequent answer, null among them, first seen on ties, by its first occurrence), unique_answers (null counts) and
    none_frac (null or empty)."""
    same = ["problem_id", "answer"]
    votes = answers.groupBy(*same).agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.min_by("correct", "idx").alias("correct"), F.sum(F.col("correct").cast("int")).alias("hits"))
    blank = F.coalesce(F.col("answer") == "", F.lit(True))
    return votes.groupBy("problem_id").agg(
        F.max((F.col("hits") > 0).cast("int")).alias("once_hit"),
        (F.sum("hits") / F.sum("n")).alias("correct_frac"),
        F.max_by(F.col("correct").cast("int"), F.struct(F.col("n"), -F.col("first"))).alias("majority_correct"),
        F.count("*").alias("unique_answers"),
        (F.sum(F.when(blank, F.col("n")).otherwise(0)) / F.sum("n")).alias("none_frac"),
    )


def frequency_table(rows: DataFrame, value: str, first_seen: str, top: int = 20) -> DataFrame:
    """(value, n, percent) of the most frequent values, ties by first occurrence, and a row "others" for the rest."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(first_seen).alias("_first"))
    total = counts.agg(F.sum("n").alias("total"))
    best = counts.orderBy(F.desc("n"), "_first").limit(top)
    rest = counts.join(best.select(F.col(value).alias("_v")), F.col(value).eqNullSafe(F.col("_v")), "left_anti")
    others = rest.agg(F.sum("n").alias("n")).where("n is not null").select(F.lit("others").alias(value), "n")
    both = best.select(F.col(value).cast("string").alias(value), "n").unionByName(others)
    return both.crossJoin(F.broadcast(total)).select(value, "n", (100 * F.col("n") / F.col("total")).alias("percent"))


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of several columns in one pass, empty values skipped."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    return rows.select(pairs).select("p.*").where("value is not null and value <> ''").groupBy("field", "value").agg(F.count("*").alias("n"))


def summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, population deviation, extremes and interpolated quantiles by keys."""
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"),
        *[F.percentile(value, F.lit(p / 100)).alias(f"p{p}") for p in (5, 25, 50, 75, 95)],
    )


def moments(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, covariance, correlation) of every pair of columns, sample statistics."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = rows.agg(*[F.covar_samp(a, b).alias(f"v{i}") for i, (a, b) in enumerate(pairs)], *[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows_ = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"v{i}").alias("covariance"), F.col(f"r{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows_))


def welch(rows: DataFrame, label: str, value: str) -> DataFrame:
    """t and degrees of freedom of the difference of means between label true and false."""
    yes, no = F.when(F.col(label), F.col(value)), F.when(~F.col(label), F.col(value))
    s = rows.agg(*[f(x).alias(f"{name}{k}") for k, x in enumerate((yes, no)) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    a, b = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    return s.where("n0 >= 2 and n1 >= 2").select(
        ((F.col("m0") - F.col("m1")) / F.sqrt(a + b)).alias("t"), (F.pow(a + b, F.lit(2.0)) / (a * a / (F.col("n0") - 1) + b * b / (F.col("n1") - 1))).alias("df")
    )


def ranking_accuracy(rows: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    """(keys, pairs, accuracy): how many pairs a key's rows make, and the share of the pairs of rows with both values that these order alike.

    Pairs are counted, never made; keys with fewer than two rows have none. accuracy is null if no two rows have both values.
    """
    pairs = rows.groupBy(*keys).agg((F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("pairs")).where("pairs > 0")
    alike = concordant(rows, keys, truth, predicted)
    share = F.try_divide(F.col("concordant"), F.col("n") * (F.col("n") - 1) / 2)
    return pairs.join(alike, keys, "left").select(*keys, "pairs", share.alias("accuracy"))


def masked_moments(rows: DataFrame, value: str, mask: Column) -> DataFrame:
    kept = F.when(mask, F.col(value))
    return rows.agg(F.avg(kept).alias("mean"), F.var_samp(kept).alias("variance"))


def whitened(rows: DataFrame, value: str, mask: Column) -> DataFrame:
    """value standardised by the mean and variance of the masked rows of the whole frame."""
    m = masked_moments(rows, value, mask)
    return rows.crossJoin(F.broadcast(m)).withColumn("whitened", (F.col(value) - F.col("mean")) / F.sqrt(F.col("variance") + 1e-8)).drop("mean", "variance")


def anomalies(rows: DataFrame, value: str) -> DataFrame:
    """Counts of NaN, infinite, beyond three deviations, and nearly zero values."""
    x = F.col(value)
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    s = rows.agg(F.avg(finite).alias("_m"), F.stddev_pop(finite).alias("_s"))
    far = F.abs(finite - F.col("_m")) > 3 * F.col("_s")
    return rows.crossJoin(F.broadcast(s)).agg(
        F.count_if(F.isnan(x)).alias("n_nan"), F.count_if(F.abs(x) == float("inf")).alias("n_inf"), F.count_if(far).alias("n_far"), (100 * F.avg((F.abs(finite) < 1e-6).cast("double"))).alias("zero_percent")
    )


def two_level_mean(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean over the keys of the sums of value."""
    return rows.groupBy(*keys).agg(F.sum(value).alias("s")).agg(F.avg("s").alias("mean"))


def rank_in(keys: list[str], *order) -> Column:
    return F.row_number().over(W.partitionBy(*keys).orderBy(*order))

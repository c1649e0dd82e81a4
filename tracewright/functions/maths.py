"""Arithmetic on columns and arrays: entropies, divergences, weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let


def log_softmax(logits: Column) -> Column:
    def of(x: Column) -> Column:
        top = F.array_max(x)
        total = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top))
        return let(F.log(total) + top, lambda z: F.transform(x, lambda v: v - z))

    return let(logits, of)


def entropy(logits: Column) -> Column:
    """Shannon entropy in nats of softmax(logits)."""
    return let(log_softmax(logits), lambda lp: F.aggregate(lp, F.lit(0.0), lambda s, v: s - F.exp(v) * v))


def token_entropy(logits: Column | None, logprob: Column | None) -> Column:
    """Exact from logits if given, else the proxy -logprob."""
    if logits is None and logprob is None:
        raise ValueError("token_entropy needs logits or logprob")
    if logits is None:
        return -logprob
    return entropy(logits) if logprob is None else F.when(logits.isNotNull(), entropy(logits)).otherwise(-logprob)


def top_k_entropy(logprobs: Column) -> Column:
    """Entropy of the listed log probabilities, the rest of the mass being one further outcome."""
    listed = F.aggregate(logprobs, F.lit(0.0), lambda s, v: s - F.exp(v) * v)
    rest = F.lit(1.0) - F.aggregate(logprobs, F.lit(0.0), lambda s, v: s + F.exp(v))
    return listed + F.when(rest > 1e-10, -rest * F.log(rest)).otherwise(0.0)


def kl(kind: str, logprob: Column, reference: Column) -> Column:
    """Per-token estimates of KL(policy || reference)."""
    d = logprob - reference
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return 0.5 * d * d
    if kind == "control_variate":
        r = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), -d))
        return F.exp(r) - 1 - r
    raise ValueError(f"unknown kind {kind!r}")


def overlong_penalty(length: Column, limit: int, buffer: int, factor: float = 1.0) -> Column:
    return F.least(-(length - (limit - buffer)) / buffer * factor, F.lit(0.0))


def best_of_k(value: Column, k: int = 4) -> Column:
    return 1 - F.pow(1 - value, F.lit(float(k)))


def importance_weight(depth: Column, deepest: Column, base: int) -> Column:
    return F.greatest(F.pow(F.lit(float(base)), deepest - depth), F.lit(1.0))


def confidence_length(p: Column, n: Column) -> Column:
    """Length of the 95 % interval of a share p of n."""
    return 2 * 1.96 * F.sqrt(p * (1 - p) / n)


def pass_at_k(n: Column, c: Column, k: int, unbiased: bool = False) -> Column:
    """1 if c >= k or fewer than k are wrong, else 1 - C(n-c,k)/C(n,k); unbiased omits the first rule."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda s, i: s * (1 - F.lit(float(k)) / i))
    rule = n - c < k if unbiased else (c >= k) | (n - c < k)
    return F.when(rule, 1.0).when(c == 0, 0.0).otherwise(1 - product)


def forward_substitution(influence: Column, last: Column, first: Column) -> Column:
    """Phase rewards r with r[0] = first and r[i] = sum(influence[i-1][j] * r[j], j < i), the last plus the outcome;
    clipped to ten times the larger of both, 5 at least."""
    n = F.size(influence)
    bound = F.greatest(F.abs(first) * 10, F.abs(last) * 10, F.lit(5.0))
    product = lambda r, i: F.aggregate(F.zip_with(r, F.slice(F.get(influence, i - 1), F.lit(1), i), lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v)
    solved = F.aggregate(F.sequence(F.lit(1), n), F.array(first), lambda r, i: F.concat(r, F.array(product(r, i) + F.when(i == n, last).otherwise(0.0))))
    return F.transform(F.when(n > 0, solved).otherwise(F.array(last)), lambda v: F.greatest(-bound, F.least(bound, v)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _least_squares(influence: pd.Series, last: pd.Series) -> pd.Series:
    """Shortest least-squares solution of the shifted system, for rows whose system is singular; null for the rest."""
    out = []
    for rows, r in zip(influence, last, strict=True):
        if rows is None:
            out.append(None)
            continue
        n = len(rows)
        b = np.zeros((n, n))
        for i, row in enumerate(rows):
            b[i, : i + 1] = row[: i + 1]
            if i + 1 < n:
                b[i, i + 1] -= 1
        c = np.zeros(n)
        c[-1] = r
        out.append(np.linalg.lstsq(b, c, rcond=None)[0].tolist())
    return pd.Series(out, dtype=object)


def rewards_to_outcome(influence: Column, last: Column) -> Column:
    """Phase rewards r with r[i] = sum(influence[i-1][j] * r[j], j < i) that end in r[n] = last; clipped as above.

    All are multiples of the first: those of first = 1 come by forward substitution, and the last equation gives the
    factor. Where it vanishes the system is singular, and the shortest least-squares solution is taken.
    """
    n = F.size(influence)
    bound = F.greatest(F.abs(last) * 10, F.lit(5.0))
    product = lambda r, i: F.aggregate(F.zip_with(r, F.slice(F.get(influence, i - 1), F.lit(1), i), lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v)
    units = F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(1.0)), lambda r, i: F.concat(r, F.array(product(r, i))))
    determinant = F.element_at(units, -1)
    singular = F.abs(determinant) < 1e-12
    shortest = _least_squares(F.when((n > 0) & singular, influence), last)
    solved = F.when(singular, shortest).otherwise(F.transform(F.slice(units, F.lit(1), n), lambda u: u * last / determinant))
    return F.transform(F.when(n > 0, F.concat(solved, F.array(last))).otherwise(F.array(last)), lambda v: F.greatest(-bound, F.least(bound, v)))


def human_count(x: Column) -> Column:
    """A count with K, M, B or T: one decimal below 100 of a unit, none above, thousands parted.

    From a million on the count is multiplied by 1e-6, 1e-9 or 1e-12 as in the original, where
    1,350,000 becomes 1.3499999999999999 and so 1.3 M; thousands are divided by 1000.
    """
    digits = F.when(x > 0, F.floor(F.log10(x.cast("double"))) + 1).otherwise(1)
    group = F.least(F.ceil(digits / 3), F.lit(5)).cast("int")
    unit = F.element_at(F.array(*map(F.lit, (" ", "K", "M", "B", "T"))), group)
    scaled = F.when(group < 3, x / F.pow(F.lit(1000.0), group - 1)).otherwise(x * F.element_at(F.array(*map(F.lit, (1.0, 1e-3, 1e-6, 1e-9, 1e-12))), group))
    whole = (group == 1) | (scaled >= 100)
    return F.concat_ws(" ", F.when(whole, F.format_number(F.floor(scaled), 0)).otherwise(F.format_number(scaled, 1)), unit)

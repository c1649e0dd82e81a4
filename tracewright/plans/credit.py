"""Credit assignment from end to end: a splitter, a reward and an advantage by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import advantages as A
from ..operators import phases as P
from ..operators import rewards as R

#: tokens -> boundaries
SPLITTERS: dict[str, Callable[..., DataFrame]] = {
    "sliding": P.sliding_boundaries,
    "threshold": P.threshold_boundaries,
    "peak": P.peak_boundaries,
    "sentence": P.sentence_boundaries,
}


def _entropy_credit(phases: DataFrame, **options) -> DataFrame:
    return R.entropy_credit(phases, **options)


def _uniform(phases: DataFrame) -> DataFrame:
    return phases.withColumn("phase_reward", R.uniform(F.col("outcome"), F.count("*").over(W.partitionBy("response_id"))))


def _by_rule(phases: DataFrame) -> DataFrame:
    return phases.withColumn("phase_reward", R.by_rule(F.col("outcome"), F.col("phase_id"), F.count("*").over(W.partitionBy("response_id"))))


#: phases(group_id, response_id, phase_id, phase_entropy, outcome) -> with phase_reward
REWARDS: dict[str, Callable[..., DataFrame]] = {"entropy_credit": _entropy_credit, "uniform": _uniform, "rule": _by_rule}


def assign_credit(
    tokens: DataFrame, outcomes: DataFrame, splitter: str = "sliding", reward: str = "entropy_credit", advantage: str = "phase", alpha: float | None = None, gamma: float = 0.9,
    splitter_options: dict | None = None, reward_options: dict | None = None,
) -> DataFrame:
    """tokens(group_id, response_id, pos, entropy, ...) with phase_id and token_advantage.

    outcomes(response_id, outcome). advantage "phase" spreads phase advantages; "hybrid" gives groups with
    a correct response their normalised outcome instead.
    """
    if advantage not in ("phase", "hybrid"):
        raise ValueError(f"unknown advantage {advantage!r}")
    boundaries = SPLITTERS[splitter](tokens, **(splitter_options or {}))
    phased = P.assign(tokens, boundaries)
    phases = R.discounted_entropy(phased).join(outcomes.select("response_id", "outcome"), "response_id")
    rewarded = REWARDS[reward](phases, **(reward_options or {}))
    out = A.to_tokens(phased, A.phase_advantages(rewarded, alpha), gamma)
    if advantage == "phase":
        return out
    groups = tokens.select("group_id", "response_id").distinct()
    routed = A.hybrid(groups.join(outcomes.select("response_id", "outcome"), "response_id")).select("response_id", "route", "outcome_advantage")
    value = F.when(F.col("route") == "outcome", F.col("outcome_advantage")).otherwise(F.col("token_advantage"))
    return out.join(routed, "response_id").withColumn("token_advantage", value).drop("route", "outcome_advantage")

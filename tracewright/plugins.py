"""Operators by kind and name, for jobs that are put together from a configuration. register() adds one's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from .functions import graders, puzzles, text
from .operators import advantages, metrics, sampling, trees
from .plans import credit
from .sources import readers, writers

#: kind -> name -> function. A splitter maps tokens to boundaries, a phase reward maps phases to phases with phase_reward,
#: a reward scores (solution, gold) columns, a judge scores a reply, a selector picks rows, a task reads prompt records.
KINDS: dict[str, dict[str, Callable]] = {
    "splitter": credit.SPLITTERS,
    "phase_reward": credit.REWARDS,
    "advantage": {"group": advantages.grpo, "leave_one_out": advantages.leave_one_out, "phase": advantages.phase_advantages, "hybrid": advantages.hybrid},
    "reward": {"math": text.score_math, "gsm8k": text.score_gsm8k, "process": graders.process_grade, "listed": graders.listed_correct, "point24": puzzles.makes_24},
    "judge": {"reply": text.judge_score, "rule": lambda score: score, "offline": lambda _: F.lit(0.5)},
    "selector": {"random": sampling.sample, "budget": sampling.budget_prefix},
    "path_filter": trees.FILTERS,
    "path_post_processor": trees.POST_PROCESSORS,
    "path_aggregator": {"top_k_percent": trees.top_percent, "max_k_paths": trees.random_paths},
    "metric": {"evaluation": metrics.evaluation, "answer_votes": metrics.answer_votes},
    "task": {name: spec.load for name, spec in readers.EVALUATIONS.items()},
    "sink": {"prompts": writers.write_prompts, "json": writers.append_json, "csv": writers.write_csv},
}


def named(kind: str, name: str) -> Callable:
    known = KINDS.get(kind)
    if known is None or name not in known:
        raise KeyError(f"no {kind} {name!r}; there are {sorted(known or KINDS)}")
    return known[name]


def register(kind: str, name: str) -> Callable[[Callable], Callable]:
    """A decorator that adds a function under a name; a name that is taken is an error."""

    def add(f: Callable) -> Callable:
        if name in KINDS.setdefault(kind, {}):
            raise KeyError(f"{kind} {name!r} is there already")
        KINDS[kind][name] = f
        return f

    return add

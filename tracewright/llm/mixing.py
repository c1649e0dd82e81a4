"""Mixing sources to target weights by hierarchical budgeting.

The corpus is a tree: domain, then language, then source. A budget of words at
the root is passed down by weight. A child that cannot use its share (its words
times ``max_epochs``) leaves the rest to its siblings, by their weights; only
what a whole subtree cannot use goes to the siblings of its parent. As every
node gets at most what its subtree holds, one pass from the root does this:
among the children of a node, those whose capacity is below their share are
filled, and the others split the remainder.

Each leaf then reads its documents in seeded epochs: whole passes while the
budget lasts, and of the next epoch the prefix, in the order of
``md5(seed:epoch:doc_id)``, that fits the rest of the budget.

Scale. Words are counted once, into a narrow table. Leaves are summed with
partial sums, so a source with a third of all rows is no hot group. The prefix
is found in two steps: words per (leaf, 1/4096 of the order), then a running
sum inside the one slice of each leaf where the budget ends. The documents are
then selected by comparing with the cut of their leaf; texts are never shuffled.
The table of leaves is broadcast only up to ``MAX_BROADCAST_LEAVES`` leaves. All
arithmetic is on integers, all expressions are Spark's own.

Defined cases: null languages and sources are leaves of their own, under the
default weights; a null text has no words, such documents cost nothing; rows
with the same doc_id in a leaf stand together: all or none are in the prefix; a
budget above the capacity takes everything; an empty corpus gives no rows; of
equal ranks none is before the other; columns named ``domain`` or ``epoch`` are
replaced, all others kept; a text of any length counts whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import words_column, written

SEED = 17
MAX_EPOCHS = 2
#: The root's budget, in percent of the words of the corpus.
BUDGET_PERCENT = 60
DOMAINS = ("web", "books", "news", "code")
DOMAIN_WEIGHTS = {"web": 40, "books": 30, "news": 20, "code": 10}
LANGUAGE_WEIGHTS = {"en": 50, "de": 20, "fr": 20}
DEFAULT_WEIGHT = 10
MAX_BROADCAST_LEAVES = 20_000
LEVELS = ("domain", "lang", "source")
_SLICE = 3  # hexadecimal digits


def default_domain() -> Column:
    """The domain of a source: by the number at its end, modulo four; the first where there is none."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]{1,9})$", 1), F.lit(""))
    return F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), F.when(number == "", F.lit(1)).otherwise(F.pmod(number.try_cast("int"), F.lit(4)) + 1))


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def _rank_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _share(children: DataFrame, parent: list[str]) -> DataFrame:
    """children(..., weight, capacity, parent_budget) with budget: filled if short, else by weight."""
    whole = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    before = whole.orderBy((F.col("capacity") / F.col("weight")), *[c for c in LEVELS if c in children.columns]).rowsBetween(W.unboundedPreceding, -1)
    left = F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    out = children.withColumn("full", (F.col("capacity") * rest <= left * F.col("weight")).cast("long"))
    left = F.col("parent_budget") - F.sum(F.col("full") * F.col("capacity")).over(whole)
    rest = F.sum((1 - F.col("full")) * F.col("weight")).over(whole)
    out = out.withColumn("_left", left).withColumn("_rest", rest)
    return out.withColumn("budget", F.when(F.col("full") == 1, F.col("capacity")).otherwise(F.expr("_left * weight div _rest"))).drop("full", "_left", "_rest", "parent_budget")


def budgets(leaves: DataFrame, budget_percent: int, max_epochs: int, domain_weights: dict[str, int], language_weights: dict[str, int]) -> DataFrame:
    """leaves(domain, lang, source, words) with the budget of each leaf in words."""
    leaf = leaves.withColumn("capacity", F.col("words") * max_epochs).where("words > 0")
    weights = {"domain": _weight("domain", domain_weights), "lang": _weight("lang", language_weights), "source": F.lit(DEFAULT_WEIGHT).cast("long")}
    node = leaf.agg(F.least(F.sum("capacity"), F.expr(f"sum(words) * {budget_percent} div 100")).alias("parent_budget"))
    above: list[str] = []
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        children = leaf.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.sum("words").alias("words")).withColumn("weight", weights[level])
        if above:
            same = [children[k].eqNullSafe(node[f"_{k}"]) for k in above]
            children = children.join(node, same).drop(*[f"_{k}" for k in above])
        else:
            children = children.crossJoin(F.broadcast(node))
        shared = _share(children, above)
        above = keys
        node = shared.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("budget").alias("parent_budget"))
    return shared.select(*LEVELS, "words", "budget")


def mix(
    docs: DataFrame,
    budget_percent: int = BUDGET_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    domain: Column | None = None,
    domain_weights: dict[str, int] | None = None,
    language_weights: dict[str, int] | None = None,
) -> DataFrame:
    """The selected rows of docs, once an epoch, with columns domain and epoch."""
    domain = default_domain() if domain is None else domain
    narrow = docs.select(domain.alias("domain"), "lang", "source", "doc_id", F.size(words_column("text")).cast("long").alias("n"))
    narrow = written(narrow, "words")
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("n").alias("words"))
    leaves = budgets(leaves, budget_percent, max_epochs, domain_weights or DOMAIN_WEIGHTS, language_weights or LANGUAGE_WEIGHTS)
    leaves = leaves.withColumn("whole", F.expr("budget div words")).withColumn("rest", F.expr("budget % words"))
    leaves = written(leaves, "leaves")
    small = leaves.count() <= MAX_BROADCAST_LEAVES
    at_leaf = lambda left, right: left.join(F.broadcast(right) if small else right, [left[k].eqNullSafe(right[f"_{k}"]) for k in LEVELS])
    renamed = lambda df: df.select(*[F.col(k).alias(f"_{k}") if k in LEVELS else F.col(k) for k in df.columns])

    ranked = at_leaf(narrow, renamed(leaves.select(*LEVELS, "whole", "rest"))).withColumn("rank", _rank_key(F.col("doc_id"), F.col("whole"), seed))
    ranked = ranked.select(*LEVELS, "rest", "rank", "n", F.left("rank", F.lit(_SLICE)).alias("slice"))
    slices = ranked.groupBy(*LEVELS, "rest", "slice").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*LEVELS).orderBy("slice").rowsBetween(W.unboundedPreceding, 0))
    slices = slices.withColumn("upto", upto).where("upto > rest")
    last = slices.groupBy(*LEVELS).agg(F.min("slice").alias("last"), F.min_by(F.col("rest") - (F.col("upto") - F.col("n")), "slice").alias("room"))
    last = written(last, "last")
    inside = at_leaf(ranked, renamed(last)).where("slice = last").groupBy(*LEVELS, "room", "rank").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*LEVELS).orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    fits = inside.withColumn("upto", upto).where("upto <= room").groupBy(*LEVELS).agg(F.max("rank").alias("fit"))
    last, fits = renamed(last.drop("room")), fits.select(*[F.col(k).alias(f"f_{k}") for k in LEVELS], "fit")
    cuts = last.join(fits, [last[f"_{k}"].eqNullSafe(fits[f"f_{k}"]) for k in LEVELS], "left").select(*[f"_{k}" for k in LEVELS], F.coalesce("fit", "last").alias("cut"))
    cuts = leaves.join(cuts, [leaves[k].eqNullSafe(cuts[f"_{k}"]) for k in LEVELS], "left").select(*LEVELS, "whole", F.coalesce("cut", F.lit("")).alias("cut"))
    cuts = written(renamed(cuts), "cuts")

    rows = docs.select(F.struct("*").alias("_row"), domain.alias("domain"), "lang", "source", "doc_id")
    rows = at_leaf(rows, cuts).withColumn("part", (_rank_key(F.col("doc_id"), F.col("whole"), seed) <= F.col("cut")).cast("long"))
    rows = rows.select("_row", "domain", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") + F.col("part"))).alias("epoch"), F.expr("whole + part").alias("end")).where("epoch < end")
    own = [c for c in docs.columns if c not in ("domain", "epoch")]
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in own], "domain", "epoch")


def digest(docs: DataFrame) -> DataFrame:
    out = mix(docs.select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "domain", "lang", "source", "epoch", F.size(words_column("text")).cast("long").alias("n_words"))


_LEVEL = """
{name}_c AS (
  SELECT {keys}, sum(l.capacity) AS capacity, {weight} AS weight, any_value(p.budget) AS pb
  FROM leaf l JOIN {parent} p ON {on} GROUP BY {keys}),
{name}_f AS (
  SELECT *, CASE WHEN capacity * (sum(weight) OVER w - coalesce(sum(weight) OVER b, 0)) <= (pb - coalesce(sum(capacity) OVER b, 0)) * weight THEN 1 ELSE 0 END AS fl
  FROM {name}_c WINDOW w AS (PARTITION BY {above}), b AS (PARTITION BY {above} ORDER BY capacity / weight, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_b AS (
  SELECT *, CASE WHEN fl = 1 THEN capacity ELSE (pb - sum(fl * capacity) OVER w) * weight // nullif(sum((1 - fl) * weight) OVER w, 0) END AS budget
  FROM {name}_f WINDOW w AS (PARTITION BY {above}))"""


def _sql() -> str:
    case = lambda c, ws: f"CASE l.{c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ws.items()) + f" ELSE {DEFAULT_WEIGHT} END"
    levels, parent, above = [], "root", "1"
    weights = (case("domain", DOMAIN_WEIGHTS), case("lang", LANGUAGE_WEIGHTS), str(DEFAULT_WEIGHT))
    for depth, level in enumerate(LEVELS):
        keys = ", ".join(f"l.{k}" for k in LEVELS[: depth + 1])
        on = " AND ".join(f"l.{k} IS NOT DISTINCT FROM p.{k}" for k in LEVELS[:depth]) or "TRUE"
        order = ", ".join(f"{k} NULLS FIRST" for k in LEVELS[: depth + 1])
        levels.append(_LEVEL.format(name=level, keys=keys, weight=weights[depth], parent=parent, on=on, above=above, order=order))
        parent, above = f"{level}_b", ", ".join(LEVELS[: depth + 1])
    names = ", ".join(f"'{d}'" for d in DOMAINS)
    same = " AND ".join(f"d.{k} IS NOT DISTINCT FROM s.{k}" for k in LEVELS)
    return f"""
WITH d AS (
  SELECT doc_id, lang, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n,
    ([{names}])[1 + coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INTEGER), 0) % 4] AS domain FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS words, CAST(sum(n) AS BIGINT) * {MAX_EPOCHS} AS capacity FROM d GROUP BY ALL HAVING sum(n) > 0),
root AS (SELECT least(sum(capacity), sum(words) * {BUDGET_PERCENT} // 100) AS budget FROM leaf),{",".join(levels)},
s AS (SELECT domain, lang, source, budget // (capacity // {MAX_EPOCHS}) AS whole, budget % (capacity // {MAX_EPOCHS}) AS rest FROM source_b),
r AS (SELECT d.*, s.whole, s.rest, md5('{SEED}:' || CAST(s.whole AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS rank FROM d JOIN s ON {same}),
u AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY rank) AS upto FROM r),
e AS (SELECT *, unnest(range(0, CAST(whole AS BIGINT) + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS epoch FROM u)
SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch, n AS n_words FROM e
"""


SQL = _sql()

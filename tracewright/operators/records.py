"""Records: filters, field maps, flattening, texts in running context, sets by content."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def matches(values: dict[str, object]) -> Column:
    """All columns equal their values; null where one of them is null."""
    return reduce(lambda a, b: a & b, [F.col(k) == v for k, v in values.items()], F.lit(True))


def until_scanned(rows: DataFrame, index: str, at_least: int) -> DataFrame:
    """Rows up to the first whose index is at_least or more: where a scan that keeps them stops."""
    last = rows.agg(F.min(F.when(F.col(index) >= at_least, F.col(index))).alias("_last"))
    return rows.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (F.col(index) <= F.col("_last"))).drop("_last")


def mapped(rows: DataFrame, names: dict[str, str], drop_others: bool = False) -> DataFrame:
    """Columns renamed by old name; a name that is not there is an error."""
    if missing := sorted(set(names) - set(rows.columns)):
        raise KeyError(f"no such columns: {missing}")
    keep = [c for c in rows.columns if c in names or not drop_others]
    return rows.select(*[F.col(c).alias(names.get(c, c)) for c in keep])


def without_null_columns(rows: DataFrame) -> DataFrame:
    """rows without the columns of type null; columns that happen to hold nulls stay."""
    return rows.select(*[f.name for f in rows.schema.fields if not isinstance(f.dataType, T.NullType)])


def flattened(rows: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs as top-level columns, named by their path."""

    def leaves(at: Column, name: str, kind: T.DataType) -> list[Column]:
        if not isinstance(kind, T.StructType):
            return [at.alias(name)]
        return [x for f in kind.fields for x in leaves(at.getField(f.name), f"{name}{separator}{f.name}", f.dataType)]

    return rows.select(*[x for f in rows.schema.fields for x in leaves(F.col(f"`{f.name}`"), f.name, f.dataType)])


def formatted(template: str) -> Column:
    """A template with {column} places; {{ and }} stand for braces."""
    parts = re.split(r"(\{\{|\}\}|\{\w+\})", template)
    text = lambda p: {"{{": "{", "}}": "}"}.get(p, p)
    return F.concat(*[F.col(p[1:-1]).cast("string") if re.fullmatch(r"\{\w+\}", p) else F.lit(text(p)) for p in parts if p])


def fitted(tokens: Column, room: int) -> Column:
    """The last room tokens: what is too long loses its beginning."""
    return F.slice(tokens, F.greatest(F.size(tokens) - room + 1, F.lit(1)), F.lit(room))


def content_key(*columns: str) -> Column:
    """MD5 of the columns as JSON with sorted keys; a null column has no key."""
    return F.md5(F.to_json(F.struct(*sorted(columns))))


def running_context(rows: DataFrame, keys: list[str], order: str, text: str, separator: str = "") -> DataFrame:
    """rows with context: the texts of all earlier rows of the group, joined."""
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("context", F.array_join(F.collect_list(text).over(before), separator))


def character_spans(tokens: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """tokens with first and last (exclusive): their places in the joined text."""
    upto = F.sum(F.length(text)).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return tokens.withColumn("last", upto).withColumn("first", F.col("last") - F.length(text))


def golden_for_failed(rows: DataFrame, group: str, order: str, score: str, golden: str, threshold: float = 1.0) -> DataFrame:
    """rows with golden_text: in groups without a right response, the first member's golden text for every member."""
    groups = rows.groupBy(group).agg((F.max(score) < threshold).alias("_failed"), F.min_by(golden, order).alias("_golden"))
    out = rows.join(groups, group)
    return out.withColumn("golden_text", F.when(F.col("_failed"), F.col("_golden"))).drop("_failed", "_golden")


def most_common(rows: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """The n most frequent values with their counts; of equals the one seen first."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").limit(n).drop("_first")


def sft_episodes(rows: DataFrame, query: Column, response: Column) -> DataFrame:
    """Supervised examples as episodes: reward 1, and advantage 1 for every response token (split at spaces)."""
    n = F.size(F.split(response, " "))
    return rows.select("*", query.alias("query_text"), response.alias("response_text"), F.lit(1.0).alias("scores"), F.array_repeat(F.lit(1.0), n).alias("advantages"))

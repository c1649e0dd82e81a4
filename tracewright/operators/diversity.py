"""Diversity of siblings in trees, and phases compared by principal components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

ORDERS = 4


#: Characters of a family that one task counts at once; the n-grams of larger families are shuffled.
FAMILY = 1 << 22
_SUMS = ["n", "_pred", "_ref", *(f"_{s}{k}" for s in "pm" for k in range(1, ORDERS + 1))]


def _clipped(gram: np.ndarray, sibling: np.ndarray, n: int) -> int:
    """The sum of min(c_i, c_j) over all pairs of siblings, of the counts c of each n-gram: ascending, each counts once for every larger one."""
    place, c = np.unique(gram * n + sibling, return_counts=True)
    g = place // n
    at = np.lexsort((c, g))
    g, c = g[at], c[at]
    end = np.append(np.flatnonzero(np.diff(g)) + 1, len(g))
    larger = np.repeat(end, np.diff(end, prepend=0)) - 1 - np.arange(len(g))
    return int((c * larger).sum())


def _family(texts: list[str]) -> list[int]:
    """The values of _SUMS for siblings in order. An n-gram is the number of its first words and its last word, numbered again: exact."""
    words = [re.findall(r"\S+", x, re.ASCII) for x in texts]
    n, size = len(words), np.array([len(w) for w in words], dtype=np.int64)
    later = np.arange(n - 1, -1, -1)
    possible, matched = [int((np.maximum(size - k + 1, 0) * later).sum()) for k in range(1, ORDERS + 1)], []
    number: dict[str, int] = {}
    word = np.array([number.setdefault(x, len(number)) for w in words for x in w], dtype=np.int64)
    sibling = np.repeat(np.arange(n), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(word))
    gram, start = word, np.arange(len(word))
    for k in range(1, ORDERS + 1):
        if k > 1:
            whole = left[start] >= k
            start = start[whole]
            gram = np.unique(gram[whole] * len(number) + word[start + k - 1], return_inverse=True)[1]
        matched.append(_clipped(gram, sibling[start], n) if len(start) else 0)
    return [n, int((size * later).sum()), int((size * np.arange(n)).sum()), *possible, *matched]


def _by_family(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _SUMS) of rows(keys, n, _i, _text) whose families lie each in one partition; a family waits only for its own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, list] = {}
        for batch in batches:
            done = []
            for *key, n, i, x in zip(*(c.to_pylist() for c in batch.columns)):
                family = waiting.setdefault(tuple(key), [])
                family.append((i, x))
                if len(family) == n:
                    done.append([*key, *_family([x for _, x in sorted(waiting.pop(tuple(key)))])])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)

    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(s, T.LongType()) for s in _SUMS])
    out = to_arrow_schema(schema)
    return rows.select(*keys, "n", "_i", "_text").mapInArrow(run, schema)


def _by_gram(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _SUMS) of rows(keys, n, _i, _text): every n-gram of every sibling is a row, and counts are ranked by window."""
    rows = rows.select(*keys, "n", "_i", F.filter(F.split("_text", r"\s+"), lambda x: x != "").alias("_w"))
    later, size = F.col("n") - 1 - F.col("_i"), F.size("_w")
    possible = [F.sum(F.greatest(size - k + 1, F.lit(0)) * later).alias(f"_p{k}") for k in range(1, ORDERS + 1)]
    sums = rows.groupBy(*keys).agg(F.first("n").alias("n"), F.sum(size * later).alias("_pred"), F.sum(size * F.col("_i")).alias("_ref"), *possible)
    grams = lambda k: F.transform(F.sequence(F.lit(0), size - k), lambda i: F.struct(F.lit(k).alias("k"), F.xxhash64(F.slice("_w", i + 1, F.lit(k))).alias("g")))
    none = F.expr("cast(array() as array<struct<k: int, g: bigint>>)")
    every = rows.select(*keys, "_i", F.explode(F.concat(*[F.when(size >= k, grams(k)).otherwise(none) for k in range(1, ORDERS + 1)])).alias("x"))
    counts = every.groupBy(*keys, "x", "_i").agg(F.count("*").alias("c"))
    rank = F.row_number().over(W.partitionBy(*keys, "x").orderBy("c", "_i"))
    larger = F.count("*").over(W.partitionBy(*keys, "x")) - rank
    clipped = counts.select(*keys, "x.k", (F.col("c") * larger).alias("m"))
    matched = clipped.groupBy(*keys).agg(*[F.sum(F.when(F.col("k") == k, F.col("m"))).alias(f"_m{k}") for k in range(1, ORDERS + 1)])
    both = sums.alias("x").join(matched.alias("y"), [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys], "left")
    return both.select(*[F.col(f"x.{k}") for k in keys], *[F.col(s).cast("long").alias(s) for s in _SUMS])


def sibling_bleu(children: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, n, bleu): corpus BLEU of every sibling, by order, against every later one; groups of one are left out.

    No pair is built. A sibling is a prediction once for each later one and a reference once for each earlier one, so
    lengths and totals are sums weighted by its place. The clipped matches of an n-gram over all pairs are the sum of
    min(c_i, c_j): with its counts ascending, each counts once for every larger one. Words are split at white space.

    Texts are shuffled once, and a family of up to FAMILY characters is counted where it lies, exactly. In larger ones
    n-grams travel as 64-bit hashes: two of one family are taken for one with probability 2^-64.
    """
    w = W.partitionBy(*keys)
    rows = children.select(*keys, order, F.coalesce(text, F.lit("")).alias("_text"))
    placed = {"_i": F.row_number().over(w.orderBy(order)) - 1, "n": F.count("*").over(w), "_chars": F.sum(F.length("_text")).over(w)}
    rows = rows.withColumns(placed).where("n > 1")
    sums = _by_family(rows.where(F.col("_chars") <= FAMILY), keys).unionByName(_by_gram(rows.where(F.col("_chars") > FAMILY), keys))
    share = lambda k: F.coalesce(F.try_divide(F.col(f"_m{k}"), F.col(f"_p{k}")), F.lit(0.0))
    mean_log = sum(F.log(share(k)) for k in range(1, ORDERS + 1)) / ORDERS
    brevity = F.when(F.col("_pred") > F.col("_ref"), 1.0).otherwise(F.exp(1 - F.try_divide(F.col("_ref"), F.col("_pred"))))
    bleu = F.when(F.least(*[share(k) for k in range(1, ORDERS + 1)]) > 0, brevity * F.exp(mean_log)).otherwise(0.0)
    return sums.select(*keys, "n", bleu.alias("bleu"))


def tree_diversity(bleus: DataFrame, tree: str, depth: str) -> DataFrame:
    """The mean BLEU of a tree's nodes, and the mean over depths of the means at each depth."""
    each = bleus.groupBy(tree, depth).agg(F.sum("bleu").alias("_s"), F.count("*").alias("_n"))
    return each.groupBy(tree).agg((F.sum("_s") / F.sum("_n")).alias("bleu"), F.avg(F.col("_s") / F.col("_n")).alias("bleu_by_depth"))


def _spans(pdf: pd.DataFrame) -> list[tuple[int, np.ndarray]]:
    phase = pdf["phase_id"].to_numpy()
    return [(int(p), np.flatnonzero(phase == p)) for p in np.unique(phase)]


def state_confluence(states: DataFrame, components: int = 32) -> DataFrame:
    """states(response_id, pos, phase_id, state), state an array: (response_id, a, b, confluence) from 0 to 1.

    The centred states of a response are reduced to their principal components, scores are averaged over each phase, and
    phases are compared by cosine. A response is a group: its length bounds the matrix.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x = np.stack(pdf["state"].to_numpy()).astype(np.float64)
        x = x - x.mean(axis=0)
        k = max(min(components, len(x) - 1, x.shape[1]), 0)
        scores = np.linalg.svd(x, full_matrices=False)[0][:, :k]
        spans = _spans(pdf)
        means = np.array([scores[at].mean(axis=0) for _, at in spans]).reshape(len(spans), k)
        unit = means / np.linalg.norm(means, axis=1, keepdims=True).clip(min=1e-12)
        like = (unit @ unit.T + 1) / 2
        return pd.DataFrame([(pdf["response_id"].iloc[0], a, b, like[i, j]) for i, (a, _) in enumerate(spans) for j, (b, _) in enumerate(spans)], columns=["response_id", "a", "b", "confluence"])

    return states.groupBy("response_id").applyInPandas(run, f"response_id {states.schema['response_id'].dataType.simpleString()}, a int, b int, confluence double")


def denoised_attention(cells: DataFrame, components: int = 1) -> DataFrame:
    """cells(response_id, q, k, q_phase, k_phase, heads), heads an array: (response_id, q_phase, k_phase, w).

    Each cell is a point with a coordinate a head. Projected onto the principal components of all cells of the response
    and averaged over heads, not below zero, it is averaged over its block of phases.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["heads"].to_numpy()).astype(np.float64)
        mean = x.mean(axis=0)
        _, vectors = np.linalg.eigh((x - mean).T @ (x - mean) / max(len(x) - 1, 1))
        top = vectors[:, ::-1][:, :components]
        smooth = (((x - mean) @ top) @ top.T + mean).mean(axis=1).clip(min=0)
        out = pd.DataFrame({"q_phase": pdf["q_phase"], "k_phase": pdf["k_phase"], "w": smooth}).groupby(["q_phase", "k_phase"], as_index=False)["w"].mean()
        return out.assign(response_id=pdf["response_id"].iloc[0])[["response_id", "q_phase", "k_phase", "w"]]

    return cells.groupBy("response_id").applyInPandas(run, f"response_id {cells.schema['response_id'].dataType.simpleString()}, q_phase int, k_phase int, w double")

"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters (lower case, white space collapsed) has an error
budget of ``n // CHARS_PER_ERROR`` edits, k. It is cut into k + 1 pieces: where
the item occurs with at most k edits, one piece at least occurs unchanged. All
pieces of a block of items are sought at once with an Aho-Corasick automaton
over the whole text; around each hit the item is verified with Myers'
bit-parallel distance, which finds the least number of edits of the item
against any stretch of the text.

Scale. One pass over the documents a block of items, with no shuffle. A block
has at most ``BLOCK_ITEMS`` items of ``BLOCK_CHARS`` characters in all, counted
before it is collected, and is sent with the task. A larger benchmark takes more
blocks, one after the other: each is a job of its own that writes its result, so
neither the driver, a plan nor a task holds two. Hits of an item that lie
together are verified once.

Defined cases: a null or empty text has no hits; null or empty items match
nothing; an item of fewer than ``CHARS_PER_ERROR`` characters has no budget and
must occur exactly, at word edges; items that share an item_id are each tried, the
least distance counts, of equal ones that of the shorter item; repeated documents
each give their rows; an empty table of documents gives no rows, one of items
finds nothing; other columns are ignored, or kept as they are by ``clean``
(``_row`` and ``_hits`` too); a text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

CHARS_PER_ERROR = 14
BLOCK_ITEMS, BLOCK_CHARS = 5_000, 10_000_000
_HITS = "array<struct<item_id: bigint, distance: int, n_chars: int>>"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """k + 1 pieces of a string of n characters, as equal as can be."""
    cuts = [n * j // (k + 1) for j in range(k + 2)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def distance(item: str, masks: dict[str, int], text: str, limit: int) -> int:
    """The least edit distance of item to any substring of text (Myers, 1999), or limit + 1."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, limit + 1
    get = masks.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best = score
            if not best:
                break
    return best


class Matcher:
    """The automaton of a block of items."""

    def __init__(self, items: list[tuple[int, str]], chars_per_error: int):
        self.items, by_piece = [], {}
        for item_id, text in items:
            if not text:
                continue
            k = len(text) // chars_per_error
            masks: dict[str, int] = {}
            for j, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << j
            for a, b in pieces(len(text), k):
                by_piece.setdefault(text[a:b], []).append((len(self.items), b))
            self.items.append((item_id, text, k, masks))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in by_piece.items():
            self.automaton.add_word(piece, owners)
        if by_piece:
            self.automaton.make_automaton()

    def hits(self, raw: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, length of the item) of all items that occur in the text."""
        text = normal(raw)
        if not text or not self.items:
            return []
        starts: dict[int, list[int]] = {}
        for end, owners in self.automaton.iter(text):
            for item, b in owners:
                starts.setdefault(item, []).append(end + 1 - b)
        best: dict[int, tuple[int, int, int]] = {}
        for item, at in starts.items():
            item_id, pattern, k, masks = self.items[item]
            found = k + 1
            if k == 0:
                found = 0 if any(self._alone(text, s, len(pattern)) for s in at) else 1
            else:
                for a, b in self._stretches(sorted(at), len(pattern), k):
                    part = text[max(a, 0) : b]
                    found = min(found, 0 if pattern in part else distance(pattern, masks, part, k))
                    if not found:
                        break
            if found <= k and (item_id not in best or (found, len(pattern)) < best[item_id][1:]):
                best[item_id] = (item_id, found, len(pattern))
        return sorted(best.values())

    @staticmethod
    def _alone(text: str, start: int, n: int) -> bool:
        return (start == 0 or text[start - 1] == " ") and (start + n == len(text) or text[start + n] == " ")

    @staticmethod
    def _stretches(at: list[int], n: int, k: int) -> Iterator[tuple[int, int]]:
        """Stretches of text that hold every alignment of the item that starts near one of at."""
        a, b = at[0] - k, at[0] + n + k
        for s in at[1:]:
            if s - k <= b:
                b = s + n + k
            else:
                yield a, b
                a, b = s - k, s + n + k
        yield a, b


def _hits_udf(items: list[tuple[int, str]], chars_per_error: int):
    @F.pandas_udf(_HITS)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(items, chars_per_error)
        for batch in texts:
            yield batch.map(lambda t: [{"item_id": i, "distance": d, "n_chars": n} for i, d, n in matcher.hits(t)])

    return find


def blocks(benchmark: DataFrame, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The distinct items, block by block: none has more than block_items items or block_chars characters, unless one item_id has."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct()
    n = 1
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(n))
        size = items.groupBy(block.alias("block")).agg(F.count("*").alias("items"), F.sum(F.length("text")).alias("chars"), F.count_distinct("item_id").alias("ids"))
        if size.where(f"(items > {block_items} or chars > {block_chars}) and ids > 1").isEmpty():
            break
        n *= 2
    for k in range(n):
        yield sorted((r[0], normal(r[1])) for r in items.where(block == k).collect())


def contaminated(docs: DataFrame, benchmark: DataFrame, chars_per_error: int = CHARS_PER_ERROR, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, distance, n_chars): every document and test item found in it."""
    parts = []
    last = None
    for items in blocks(benchmark, block_items):
        if last is not None:
            parts.append(written(last, "hits", narrow=True))
        found = docs.select("doc_id", F.explode(_hits_udf(items, chars_per_error)("text")).alias("h"))
        last = found.select("doc_id", "h.*")
    return reduce(DataFrame.unionByName, [*parts, last])


def clean(docs: DataFrame, benchmark: DataFrame, chars_per_error: int = CHARS_PER_ERROR, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The documents in which no test item occurs, with the columns of docs."""
    left = None
    for items in blocks(benchmark, block_items):
        left = docs if left is None else written(left, "clean")
        found = left.select(F.struct("*").alias("_row"), _hits_udf(items, chars_per_error)("text").alias("_hits"))
        left = found.where(F.size("_hits") == 0).select("_row.*")
    return left

"""Periodic runs of words, found on the grammar of each text.

A run is a stretch of consecutive words with smallest period q and at least
max(MIN_WORDS, 2 q) words that no neighbouring word extends with period q.

Grammar. Re-Pair replaces a pair of symbols that occurs twice in a text by a new symbol,
the most frequent pair first, until no pair repeats. Texts of a chunk are reduced side by
side in rounds: where two repeated pairs share a symbol the more frequent one goes first
(ties: the pair of greater number), and pairs that do not meet are replaced in the same
round. A symbol stands for one pair of one text, and its places are all its derivations.

Runs. Every run crosses the boundary of the lowest symbol of the derivation that holds
it, or a boundary of the text's last sequence. Runs are computed once a symbol, at its
boundary and inside its first place: with period q, a run that crosses m repeats either
the word at m - q or the one at m + q, and along with it a stretch of at least half its
period. Such stretches are found by rank (the numbers of all sequences of 2^k words,
doubled level by level, exact), for each power of two their occurrences at a distance
that fits, and extended to both sides by the same ranks. The runs of a symbol are then
moved to all its places, and pieces inside a longer one of the same period go.

Scale. One pass of the documents without a shuffle; a task holds one chunk of WORDS
words or one text. Work follows the boundaries of the grammar, not the length of runs:
a word repeated n times has log n of them.

Defined cases: null, empty and blank texts have no words and no runs; repeated rows and
ids come out as often as they come in; a null doc_id is kept; texts of any length are
taken whole; runs of equal length are told apart by start, then period; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
#: Words of a chunk; a longer text is a chunk of its own.
WORDS = 1 << 18
#: Candidates extended at a time.
BLOCK = 1 << 20
#: Periods below are tried one by one.
SHORT = 8


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its number among the different keys, and how often each number occurs."""
    order = np.argsort(keys)
    first = np.ones(len(keys), dtype=bool)
    ordered = keys[order]
    first[1:] = ordered[1:] != ordered[:-1]
    number = np.cumsum(first) - 1
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = number
    return out, np.bincount(number)


def _pair_keys(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """One integer for a pair of numbers below size in a text."""
    if (int(text[-1]) + 1 if len(text) else 1) * size * size >= 1 << 63:
        raise OverflowError("a chunk of so many words must hold fewer texts")
    return (text * size + a) * size + b


def grammar(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Re-Pair symbols of texts whose words are words[first[t]:first[t + 1]], numbers below len(words).

    (places, cuts, sizes): for every derivation (symbol, begin, boundary, end) by places in words; the
    boundaries inside the sequence that is left of each text; their number a text.
    """
    n = len(words)
    symbol, begin = words.astype(np.int64), np.arange(n, dtype=np.int64)
    text = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
    end = begin + 1
    fresh = n
    places, cuts = [np.zeros((0, 4), dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    while len(symbol) > 1:
        at = np.flatnonzero(text[:-1] == text[1:])
        number, times = numbered(_pair_keys(text[at], symbol[at], symbol[at + 1], fresh))
        rank = np.full(len(symbol) + 1, -1, dtype=np.int64)
        often = times[number]
        # the last place of rank is a neighbour of both ends that never wins
        rank[at] = np.where(often > 1, often * len(times) + number, -1)
        mine = rank[:-1]
        wins = (mine >= 0) & (mine >= rank[1:]) & (mine >= np.concatenate(([-1], rank[:-2])))
        i = np.flatnonzero(wins)
        # neighbours that both win are the same pair, a symbol repeated: every other one counts
        starts = np.ones(len(i), dtype=bool)
        starts[1:] = i[1:] != i[:-1] + 1
        since = np.arange(len(i)) - np.maximum.accumulate(np.where(starts, np.arange(len(i)), 0))
        i = i[since % 2 == 0]
        changed = np.zeros(len(first) - 1, dtype=bool)
        changed[text[i]] = True
        still = changed[text]
        done = ~still
        done[1:] &= text[1:] == text[:-1]
        done[:1] = False
        cuts.append(begin[done])
        if not len(i):
            break
        kind, times = numbered(mine[i])
        places.append(np.column_stack([fresh + kind, begin[i], begin[i + 1], end[i + 1]]))
        symbol[i] = fresh + kind
        end[i] = end[i + 1]
        fresh += len(times)
        still[i + 1] = False
        symbol, begin, text, end = symbol[still], begin[still], text[still], end[still]
    left = np.sort(np.concatenate(cuts))
    return np.concatenate(places), left, np.diff(np.searchsorted(left, first))


class Ranks:
    """level[k][i] is the number of the 2^k words at i among those of its text, -1 where they pass its end."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        self.n = len(words)
        self.text = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
        self.level = [words.astype(np.int64)]
        self.times = [np.bincount(words)]

    def double(self) -> np.ndarray:
        """Adds a level; how often each of its numbers occurs."""
        have, width = self.level[-1], 1 << len(self.level) - 1
        out = np.full(self.n, -1, dtype=np.int64)
        i = np.flatnonzero((have[: max(0, self.n - width)] >= 0) & (have[width:] >= 0))
        i = i[self.text[i] == self.text[i + width]]
        number, times = numbered(_pair_keys(self.text[i], have[i], have[i + width], self.n + 1))
        out[i] = number
        self.level.append(out)
        self.times.append(times)
        return times

    def stretch(self, i: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest [s, e) around i with word x equal to word x + q for all its x, low <= s and e + q <= high."""
        s, e = i.copy(), i.copy()
        for k in range(len(self.level) - 1, -1, -1):
            rank, width = self.level[k], 1 << k
            ok = np.flatnonzero(e + q + width <= high)
            ok = ok[rank[e[ok]] == rank[e[ok] + q[ok]]]
            e[ok] += width
            ok = np.flatnonzero(s - width >= low)
            ok = ok[rank[s[ok] - width] == rank[s[ok] - width + q[ok]]]
            s[ok] -= width
        return s, e


def _candidates(ranks: Ranks, low: np.ndarray, cut: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(boundary, place, period) in blocks: word place + x and word place + period + x are equal for the first x, and a run may cross there."""
    words = ranks.level[0]
    for q in range(1, SHORT):
        for shift in (-q, 0):
            i = cut + shift
            b = np.flatnonzero((i >= low) & (i + q < high))
            b = b[words[i[b]] == words[i[b] + q]]
            yield b, i[b], np.full(len(b), q)
    for k in range(2, len(ranks.level)):
        rank, width, near, far = ranks.level[k], 1 << k, 2 << k, 4 << k
        fits = np.flatnonzero(high - low >= 2 * near)
        if not len(fits):
            break
        # the places of each number in order, as one ascending row
        there = np.flatnonzero(rank >= 0)
        row = np.sort(rank[there] * ranks.n + there)
        for shift in (0, 1 - width):
            g = cut[fits] + shift
            ok = (g >= low[fits]) & (g + width <= high[fits])
            b, g = fits[ok], g[ok]
            ok = ranks.times[k][rank[g]] > 1
            b, g = b[ok], g[ok]
            base = rank[g] * ranks.n
            for a, z in ((np.maximum(g - far + 1, low[b]), g - near), (g + near, np.minimum(g + far - 1, high[b] - width))):
                begin = np.searchsorted(row, base + a, side="left")
                number = np.maximum(np.searchsorted(row, base + z, side="right") - begin, 0)
                number[z < a] = 0
                upto = np.cumsum(number)
                at = 0
                while at < len(number):
                    stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, side="right")))
                    some = number[at:stop]
                    of = np.repeat(np.arange(at, stop), some)
                    place = row[begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(some) - some, some)] - base[of]
                    yield b[of], np.minimum(place, g[of]), np.abs(place - g[of])
                    at = stop


def _crossing(ranks: Ranks, owner: np.ndarray, low: np.ndarray, cut: np.ndarray, high: np.ndarray, least: int) -> np.ndarray:
    """(owner, start, end, period) of the runs inside [low, high) that cross cut, each once an owner with its smallest period."""
    found = [np.zeros((0, 4), dtype=np.int64)]
    for b, i, q in _candidates(ranks, low, cut, high):
        s, e = ranks.stretch(i, q, low[b], high[b])
        size = e + q - s
        ok = (size >= least) & (size >= 2 * q)
        found.append(_smallest(np.column_stack([owner[b], s, e + q, q])[ok]))
    return _smallest(np.concatenate(found))


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of rows (owner, start, end, period) with the same first three, the one of the smallest period."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    keep = np.ones(len(rows), dtype=bool)
    keep[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    return rows[keep]


def _maximal(rows: np.ndarray, n: int) -> np.ndarray:
    """Rows (text, start, end, period) that lie in no other of the same text and period."""
    rows = rows[np.lexsort((-rows[:, 2], rows[:, 1], rows[:, 3], rows[:, 0]))]
    group = np.concatenate(([0], np.cumsum((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 3] != rows[:-1, 3])))) if len(rows) else np.zeros(0, dtype=np.int64)
    reach = np.maximum.accumulate(group * (n + 1) + rows[:, 2]) if len(rows) else group
    keep = np.ones(len(rows), dtype=bool)
    keep[1:] = (group[1:] != group[:-1]) | (group[1:] * (n + 1) + rows[1:, 2] > reach[:-1])
    return rows[keep]


def find_runs(words: np.ndarray, first: np.ndarray, least: int = MIN_WORDS) -> np.ndarray:
    """(text, start, length, period) of every run, by text, start and period; least is 12 or more.

    words are numbers below their count, those of text t at first[t]:first[t + 1]; starts count from there.
    """
    places, cuts, n_cuts = grammar(words, first)
    ranks = Ranks(words, first)
    ranks.double()
    times = ranks.double()
    # a run of 12 words or more repeats some four words: other texts have none, whatever their grammar
    four = ranks.level[2]
    there = np.flatnonzero(four >= 0)
    repeats = np.zeros(len(first) - 1, dtype=bool)
    repeats[ranks.text[there[times[four[there]] > 1]]] = True
    if not repeats.any():
        return np.zeros((0, 4), dtype=np.int64)
    # from here on only these texts, moved together
    size = np.diff(first)
    moved = np.concatenate(([0], np.cumsum(np.where(repeats, size, 0))))
    back = np.flatnonzero(repeats)
    shift = moved[:-1] - first[:-1]
    text_of = ranks.text
    kept = repeats[text_of]
    _, short = np.unique(words[kept], return_inverse=True)
    ranks = Ranks(short, np.concatenate((moved[:-1][repeats], moved[-1:])))
    while (1 << len(ranks.level)) <= int(size[repeats].max()):
        if ranks.double().max(initial=0) < 2:
            break
    # boundaries: of symbols with enough words at their first place, and of what is left of each text
    places = places[(places[:, 3] - places[:, 1] >= least)]
    places = places[repeats[text_of[places[:, 1]]]]
    places[:, 1:] += shift[text_of[places[:, 1]]][:, None]
    places = places[np.lexsort((places[:, 1], places[:, 0]))]
    one = np.ones(len(places), dtype=bool)
    one[1:] = places[1:, 0] != places[:-1, 0]
    one = np.flatnonzero(one)
    cut_text = np.repeat(np.arange(len(size)), n_cuts)
    use = repeats[cut_text] & (size[cut_text] >= least)
    cuts, cut_text = cuts[use], cut_text[use]
    owner = np.concatenate((np.arange(len(one)), len(one) + cut_text))
    low = np.concatenate((places[one, 1], moved[cut_text]))
    high = np.concatenate((places[one, 3], moved[cut_text + 1]))
    found = _crossing(ranks, owner, low, np.concatenate((places[one, 2], cuts + shift[cut_text])), high, least)
    # every run of a symbol, moved to each of its places
    inner, rest = found[found[:, 0] < len(one)], found[found[:, 0] >= len(one)]
    number = np.diff(np.append(one, len(places)))[inner[:, 0]]
    of = np.repeat(np.arange(len(inner)), number)
    place = one[inner[of, 0]] + np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    by = places[place, 1] - places[one[inner[of, 0]], 1]
    pieces = np.column_stack([inner[of, 1] + by, inner[of, 2] + by, inner[of, 3]])
    rows = np.concatenate((pieces, rest[:, 1:]))
    text = back[ranks.text[rows[:, 0]]] if len(rows) else np.zeros(0, dtype=np.int64)
    rows = _maximal(np.column_stack([text, rows]), len(words))
    out = np.column_stack([rows[:, 0], rows[:, 1] - moved[rows[:, 0]], rows[:, 2] - rows[:, 1], rows[:, 3]])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


# documents


def cyclic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The rule of the registered query: a tenth of the documents repeat a stretch of words to their end."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _chunks(batches: Iterator[pa.RecordBatch], change) -> Iterator[tuple[list, list[list[bytes]]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            words = change(i, (t.as_py() or b"").split())
            if size and size + len(words) > WORDS:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(words)
            size += len(words)
    if ids:
        yield ids, texts


def _runs_of(texts: list[list[bytes]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of texts of words, and the bounds of each text's rows."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    words = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(first[-1]))
    runs = find_runs(words, first, least)
    return runs, np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))


def _same(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    return words


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run has after its first period."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(gone, runs[:, 1] + runs[:, 3], 1)
    np.add.at(gone, runs[:, 1] + runs[:, 2], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]


def runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """One row a run: (doc_id, start, length, period), by word numbers of the text."""
    if least < MIN_WORDS:
        raise ValueError(f"runs have {MIN_WORDS} words or more")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches, _same):
            found, _ = _runs_of(texts, least)
            doc_id = pa.array([ids[t] for t in found[:, 0].tolist()], pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": doc_id} | {c: pa.array(found[:, k]) for k, c in enumerate(("start", "length", "period"), 1)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """docs with each run in text cut to its first period; only texts that have a run change, their words then joined by one space."""
    if least < MIN_WORDS:
        raise ValueError(f"runs have {MIN_WORDS} words or more")
    at = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(at)
            out: list[bytes | None] = []
            rows = pa.RecordBatch.from_pydict({"doc_id": pa.nulls(len(whole), pa.int64()), "text": whole})
            for _, texts in _chunks(iter([rows]), _same):
                found, bound = _runs_of(texts, least)
                out += [b" ".join(collapsed(t, found[bound[k] : bound[k + 1]])) if bound[k] < bound[k + 1] else None for k, t in enumerate(texts)]
            new = pa.array([w.as_py() if x is None else x.decode() for x, w in zip(out, whole, strict=True)], whole.type)
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(cut, docs.schema)


_DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: its number of runs, the longest, and digests of all runs and of the words kept; texts changed by `cyclic`."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches, cyclic):
            found, bound = _runs_of(texts, MIN_WORDS)
            rows = []
            for k, (i, words) in enumerate(zip(ids, texts, strict=True)):
                mine = found[bound[k] : bound[k + 1]]
                best, listed, kept = (None,) * 4, "", words
                if len(mine):
                    _, s, n, q = mine[np.lexsort((mine[:, 3], mine[:, 1], -mine[:, 2]))[0]].tolist()
                    best = (s, n, q, 1000 * n // q)
                    listed = "".join(f"{a},{b},{c}\n" for _, a, b, c in mine.tolist())
                    kept = collapsed(words, mine)
                rows.append((i, len(mine), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in _DIGEST.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, _DIGEST)

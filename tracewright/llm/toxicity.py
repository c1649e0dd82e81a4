"""Toxic passages by maximum-scoring segment search.

Training. Labelled documents (never those held out) give, for each word, the
number of toxic and of other documents that have it. A Dirichlet prior of mass
``PRIOR`` a word, centred on the background share of toxic text, shrinks the log
odds of rare words towards zero. A word scores its log odds less ``DRIFT``, be it
a toxic word or one of clean text; words without evidence score ``-DRIFT``, so the
expected score of clean text is negative and segments that stand out are local.

Search. Ruzzo and Tompa's algorithm finds all maximal scoring segments of a
document in linear time: each is a toxic passage with its score S.

Calibration. By extreme-value theory the number of segments of score S or more in
n clean words is about K * n * exp(-lambda * S), where lambda solves
sum(p * exp(lambda * s)) = 1 over the words of clean text. A document's passages
add up to E = sum(exp(lambda * S) / n), and K is read from the ``QUANTILE`` of E
among clean training documents by the limit law P(E <= e) = exp(-K / e). The
statistic T = log(1 + E / K) goes through a logistic curve to a score from 0 to 1.
K and the curve come from documents whose words were not counted: each of
``FOLDS`` parts of the training rows is scored by the counts of the others.

Scale. Word counts are pre-aggregated by task. The table holds words whose log odds
reach ``MIN_LOG_ODDS`` either way and that ``MIN_SHARE`` of the toxic or of the clean
training documents have: a document of w different words on average leaves at most
2 * w / MIN_SHARE of them, whatever the corpus. At most ``MAX_LABELLED`` labelled
rows, by the hash of their ids, take part in training and are broadcast. K and the
curve are fitted on a histogram of E. Scoring is one pass without shuffle.

Defined cases: null and empty texts have T = 0 and get the score of that;
without labels of both classes every score is 0; a doc_id with several labels is
toxic if one says so; a null doc_id is not held out and has no label; repeated
rows are scored alike; an empty table gives no rows; of segments with equal scores
the first is found first; columns named ``score`` or ``passages`` are replaced, all
others kept; a text of any length is read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIOR = 5.0
DRIFT = 1.5
MAX_LABELLED = 200_000
MIN_LOG_ODDS = 0.25
MIN_SHARE = 1 / 2000
FOLDS = 4
QUANTILE = 0.9
BIN = 0.25
#: The bin of documents without any passage.
_NONE = -1_000_000
_WORD = re.compile(r"[^\W_]+")


def held_out() -> Column:
    """The fold that training never sees: crc32 of the doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def maximal_segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence in which position i of
    hits scores its value and any other position scores -drift (Ruzzo and Tompa, 1999)."""
    found: list[list[float]] = []  # start, end, sum before, sum up to the end
    total, at = 0.0, 0
    for i, value in hits:
        total -= drift * (i - at)
        at = i + 1
        if value <= 0:
            total += value
            continue
        now = [i, i + 1, total, total + value]
        total += value
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j -= 1
            if j < 0 or found[j][3] >= now[3]:
                found.append(now)
                break
            now = [found[j][0], now[1], found[j][2], now[3]]
            del found[j:]
    return [(int(a), int(b), r - l) for a, b, l, r in found]


class Model:
    """Word scores and the constants of the calibration."""

    def __init__(self, table: dict[str, float], rate: float, scale: float = 1.0, curve: tuple[float, float] | None = None):
        self.table, self.rate, self.scale, self.curve = table, rate, scale, curve
        self.positive = frozenset(w for w, s in table.items() if s > 0)

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        tokens, get = words(text), self.table.get
        if self.positive.isdisjoint(tokens):
            return [], len(tokens)
        return maximal_segments([(i, s) for i, w in enumerate(tokens) if (s := get(w)) is not None]), len(tokens)

    def log_evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """log E, or minus infinity without passages."""
        if not segments:
            return -math.inf
        top = max(s for _, _, s in segments)
        return self.rate * top + math.log(sum(math.exp(self.rate * (s - top)) for _, _, s in segments) / n)

    def statistic(self, log_evidence: float) -> float:
        x = log_evidence - math.log(self.scale)
        return x if x > 30 else math.log1p(math.exp(x))

    def score(self, t: float) -> float:
        if self.curve is None:
            return 0.0
        z = self.curve[0] + self.curve[1] * t
        return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


def training_labels(labels: DataFrame, column: str = "toxic") -> DataFrame:
    rows = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col(column) == 1).cast("int")).alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents by word, fold and label, partial sums; the word null counts the documents themselves."""
    for batch in batches:
        counts: dict[str | None, list[int]] = {}
        for text, label, fold in zip(batch["text"], batch["label"], batch["fold"], strict=True):
            at = 2 * fold + label
            for w in {None, *words(text)}:
                if w not in counts:
                    counts[w] = [0] * (2 * FOLDS)
                counts[w][at] += 1
        columns = {f"n{k}": [c[k] for c in counts.values()] for k in range(2 * FOLDS)}
        yield pd.DataFrame({"word": pd.Series(list(counts), dtype=object), **columns})


def _evidence(models: list[Model]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins: Counter = Counter()
            for text, label, fold in zip(batch["text"], batch["label"], batch["fold"], strict=True):
                e = models[fold].log_evidence(*models[fold].passages(text))
                bins[_NONE if e == -math.inf else round(e / BIN), label] += 1
            yield pd.DataFrame([(*k, n) for k, n in bins.items()], columns=["bin", "label", "n"])

    return run


def _solve_rate(table: dict[str, float], share: dict[str, float]) -> float:
    """lambda > 0 with sum(p * exp(lambda * s)) = 1 over clean words."""
    rest = max(0.0, 1 - sum(share.values()))
    excess = lambda x: rest * math.exp(-x * DRIFT) + sum(p * math.exp(min(x * table[w], 700.0)) for w, p in share.items()) - 1
    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def _fit_curve(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Logistic regression of the label on T over (T, label, documents), by Newton's method with a slight ridge."""
    a, b = 0.0, 0.0
    for _ in range(50):
        ga, gb, haa, hab, hbb = -1e-3 * a, -1e-3 * b, 1e-3, 0.0, 1e-3
        for t, y, n in points:
            z = max(-30.0, min(30.0, a + b * t))
            p = 1 / (1 + math.exp(-z))
            ga, gb, h = ga + n * (y - p), gb + n * (y - p) * t, n * p * (1 - p)
            haa, hab, hbb = haa + h, hab + h * t, hbb + h * t * t
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da) / 2, abs(db) / 2)
        a, b = a + da / size, b + db / size
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def _log_odds(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    share = n_toxic / (n_toxic + n_clean)
    return math.log((toxic + PRIOR * share) / (clean + PRIOR * (1 - share))) - math.log(share / (1 - share))


def _model(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int, clean_words: float) -> Model:
    """Scores and lambda from (word, toxic, clean) documents; clean_words: different words of all clean documents, summed."""
    if not n_toxic or not n_clean:
        return Model({}, 1.0)
    table, share = {}, {}
    for w, toxic, clean in counts:
        odds = _log_odds(toxic, clean, n_toxic, n_clean)
        if abs(odds) >= MIN_LOG_ODDS and (toxic and toxic >= MIN_SHARE * n_toxic or clean and clean >= MIN_SHARE * n_clean):
            table[w] = odds - DRIFT
            share[w] = (clean + PRIOR * 0.01) / max(1.0, clean_words)
    return Model(table, _solve_rate(table, share) if table else 1.0)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents outside the held-out fold."""
    known = training_labels(labels)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("text", "label", fold)
    columns = [f"n{k}" for k in range(2 * FOLDS)]
    counts = rows.mapInPandas(_tally, "word string, " + ", ".join(f"{c} long" for c in columns)).groupBy("word").agg(*[F.sum(c).alias(c) for c in columns])
    clean, toxic = (sum(F.col(c) for c in columns[y::2]) for y in (0, 1))
    counts = counts.withColumn("clean", clean).withColumn("toxic", toxic)
    total = counts.agg(*[F.sum(F.when(F.col("word").isNull(), F.col(c))).alias(c) for c in columns], F.sum(F.when(F.col("word").isNotNull(), F.col("clean"))).alias("words")).first()
    each = [total[c] or 0 for c in columns]
    n_clean, n_toxic, clean_words = sum(each[0::2]), sum(each[1::2]), total["words"] or 0
    if not n_clean or not n_toxic:
        return Model({}, 1.0)
    # a fold less has less evidence still: whatever any of the tables may hold
    least = (F.col("toxic") > 0) & (F.col("toxic") >= 0.5 * MIN_SHARE * n_toxic) | (F.col("clean") >= max(1.0, 0.5 * MIN_SHARE * n_clean))
    share = n_toxic / (n_toxic + n_clean)
    odds = F.log((F.col("toxic") + PRIOR * share) / (F.col("clean") + PRIOR * (1 - share))) - math.log(share / (1 - share))
    found = counts.where(F.col("word").isNotNull() & least & (F.abs(odds) >= MIN_LOG_ODDS / 2)).select("word", *columns).toArrow()
    name, n = found.column("word").to_pylist(), [found.column(c).to_pylist() for c in columns]

    def without(fold: int | None) -> Model:
        use = [k for k in range(FOLDS) if k != fold]
        per_word = lambda y: [sum(x) for x in zip(*(n[2 * k + y] for k in use), strict=True)] if name else []
        one = lambda y: sum(each[2 * k + y] for k in use)
        return _model(list(zip(name, per_word(1), per_word(0), strict=True)), one(1), one(0), clean_words * one(0) / n_clean)

    bins = rows.mapInPandas(_evidence([without(k) for k in range(FOLDS)]), "bin long, label int, n long").groupBy("bin", "label").agg(F.sum("n").alias("n")).collect()
    model = without(None)
    model.scale = _scale([(r["bin"], r["n"]) for r in bins if r["label"] == 0])
    t = lambda b: 0.0 if b == _NONE else model.statistic(b * BIN)
    model.curve = _fit_curve([(t(r["bin"]), r["label"], r["n"]) for r in bins])
    return model


def _scale(bins: list[tuple[int, int]]) -> float:
    """K by the limit law, from the QUANTILE of E among clean documents."""
    total, below = sum(n for _, n in bins), 0
    for b, n in sorted(bins):
        below += n
        if b != _NONE and below >= QUANTILE * total:
            return min(max(-math.log(min(below / total, 0.999)) * math.exp(max(min(b * BIN, 30.0), -30.0)), 1e-9), 1e3)
    return 1e-9


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (double, 0 to 1) and passages (start, end in words, score), those that a clean document of its length is not expected to show."""
    passage = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(passage))])

    @F.pandas_udf(kind)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            scores, found = [], []
            for text in batch:
                segments, n = model.passages(text)
                e = model.log_evidence(segments, n)
                scores.append(model.score(model.statistic(e) if segments else 0.0))
                # significant: fewer than one such passage is expected in a clean document of this length
                found.append([{"start": a, "end": b, "score": s} for a, b, s in segments if model.rate * s > math.log(model.scale * n)])
            yield pd.DataFrame({"score": scores, "passages": pd.Series(found, dtype=object)})

    kept = [c for c in docs.columns if c not in ("score", "passages")]
    row = docs.select(F.struct("*").alias("_row"), "text").select("_row", of("text").alias("_s"))
    return row.select(*[F.col("_row").getField(c).alias(c) for c in kept], "_s.score", "_s.passages")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))

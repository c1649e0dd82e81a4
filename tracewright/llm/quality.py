"""Quality rules, then a hashed n-gram log-likelihood ratio of every document.

Base rules reject short texts and texts made of repeated three-word windows.
The verdict on the others compares two multinomials over ``2**bits`` hashed
word unigrams and bigrams: one counted over trusted documents (label
``quality`` = 1), one over the whole corpus, both with additive smoothing. A
document's score is the sum of log(p_target / p_raw) over its n-grams, divided
by their number; it is kept if that is at least ``threshold``. Nothing is drawn
at random: each document gets its verdict from the counts alone.

The ratio is near zero for text like the trusted text and falls far below for
text of another kind, so the threshold (-0.15 nats an n-gram) asks for a clear
difference. Without trusted n-grams there is no verdict: base rules alone decide.

Buckets that mix more n-grams draw all scores towards zero. So their number
grows with the characters of the corpus, from ``2**BITS`` to ``2**MAX_BITS``, and
the threshold follows the scores of trusted documents: their lowest percentile
less ``SPREADS`` times its distance from the median, where that is above -0.15.
That takes ``MIN_SCORES`` different scores; with fewer it is -0.15.

Scale. Counts are partial sums over ``2**bits`` buckets before their shuffle, so
a task ships at most that many rows. The table of ratios has ``2**bits``
numbers whatever the corpus, and every row reads it as a scalar. Texts are read
twice by ``digest``, which takes the threshold from the numbers that it has written, and
trusted texts once more by ``judge``, which writes no texts. The target is
counted over all trusted documents, the corpus over all documents. Up to
``MAX_BROADCAST`` trusted ids are broadcast, and texts and n-grams never leave a
task; with more, documents meet the ids in a shuffle of the texts. The threshold's
percentiles are exact: bounds from a sketch, then the few scores between them.
All expressions are Spark's own.

Defined cases: a null or empty text has no words, is base_failed and not kept;
a doc_id with several labels is trusted if any label is 1; a null doc_id or a
document without label is not trusted but counts as corpus; repeated rows count
as often as they occur; a score equal to the threshold is kept; an empty table
gives no rows; columns of the results' names are replaced (``filter_documents``
keeps every column as it is); a text of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, words_column, written

BITS, MAX_BITS = 14, 18
CHARS_A_BUCKET = 256
SMOOTHING = 1.0
THRESHOLD = -0.15
SPREADS, MIN_SCORES = 3, 1000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: So many trusted ids are broadcast; more are joined by a shuffle. All are used either way.
MAX_BROADCAST = 100_000
#: Accuracy of the sketch that bounds a percentile.
SKETCH = 10_000
#: So many different windows that occur twice are sought one by one, more by sorting: the same places either way.
FEW = 64
SYMBOLS = "#*$%&|<>"


def _next(words: str | Column) -> Column:
    """The words after the first."""
    return F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))


def _buckets(a: Column, b: Column, bits: int) -> tuple[Column, Column]:
    """Buckets of a word and of the bigram with its successor, null after the last word."""
    width = F.lit((1 << bits) - 1)
    return F.xxhash64(a).bitwiseAND(width), F.when(b.isNotNull(), F.xxhash64(a, b).bitwiseAND(width))


def _covered(places: Column, width: int) -> Column:
    """Words covered by windows of that width that begin at the ascending places."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
    step = F.aggregate(places, start, lambda s, p: F.struct((s["n"] + F.least(F.lit(width), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])
    return step.cast("long")


def _repeated(hashes: Column) -> Column:
    """The ascending places of the numbers that an array holds twice or more."""

    def among(twice: Column) -> Column:
        few = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        run = lambda x: F.filter(x, lambda y, k: (y["h"] == F.get(x, k - 1)["h"]).eqNullSafe(True) | (y["h"] == F.get(x, k + 1)["h"]).eqNullSafe(True))
        many = F.sort_array(F.transform(let(by_hash, run), lambda y: y["i"]))
        return F.when(F.size(twice) <= FEW, few).otherwise(many)

    twice = let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda h, i: h.eqNullSafe(F.get(s, i - 1)))))
    # most texts repeat no window, and a set is cheaper than sorting
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.array().cast("array<int>")).otherwise(let(twice, among))


def base_rules(docs: DataFrame) -> DataFrame:
    """docs with words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("words", words_column("text"))
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    places = lambda w: F.when(F.size(w) >= 3, let(hashes(w), _repeated))
    repeats = F.coalesce(_covered(let(F.col("words"), places), 3), F.lit(0).cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_words = F.size("words").cast("long")
    out = out.withColumns(
        {
            "n_words": n_words,
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeats,
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def bits_for(docs: DataFrame) -> int:
    """Buckets of about CHARS_A_BUCKET characters of the corpus each, within bounds."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(max(BITS, (chars // CHARS_A_BUCKET).bit_length() - 1), MAX_BITS)


def _trusted(labels: DataFrame) -> DataFrame:
    """Every trusted id once, hinted for its join."""
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    many = ids.count() > MAX_BROADCAST
    return ids.withColumn("trusted", F.lit(1)).hint("merge" if many else "broadcast")


def _narrow(docs: DataFrame, trusted: DataFrame, how: str) -> DataFrame:
    """docs joined with the trusted ids, then cut into words: a shuffle moves texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(trusted, "doc_id", how).select("doc_id", "trusted", words_column("text").alias("words"))


def ratios(docs: DataFrame, labels: DataFrame, bits: int = BITS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row, ``ratio``: log(p_target / p_raw) of each of the 2**bits buckets; all null without trusted text."""
    counted = _count_by_document_class(_narrow(docs, _trusted(labels), "left"), bits)
    size = 1 << bits
    every = counted.sparkSession.range(size).withColumnRenamed("id", "bucket").join(counted, "bucket", "left").na.fill(0)
    total = every.agg(F.sum("target").alias("nt"), F.sum("raw").alias("nr"))
    ratio = F.when(F.col("nt") > 0, F.log((F.col("target") + smoothing) / (F.col("nt") + smoothing * size)) - F.log((F.col("raw") + smoothing) / (F.col("nr") + smoothing * size)))
    each = every.crossJoin(F.broadcast(total)).select("bucket", ratio.alias("ratio"))
    ordered = F.sort_array(F.collect_list(F.struct("bucket", "ratio")))
    return each.agg(F.transform(ordered, lambda x: x["ratio"]).alias("ratio"))


def _count_by_document_class(marked: DataFrame, bits: int) -> DataFrame:
    """(bucket, target, raw) over all documents."""
    words = marked.withColumn("next", _next("words")).select("trusted", F.inline(F.arrays_zip("words", "next")).alias("a", "b"))
    grams = words.select("trusted", F.explode(F.array(*_buckets(F.col("a"), F.col("b"), bits))).alias("bucket")).where("bucket is not null")
    return grams.groupBy("bucket").agg(F.count("trusted").alias("target"), F.count("*").alias("raw"))


def _scored(out: DataFrame, table: DataFrame, bits: int) -> DataFrame:
    """out(words) with score."""

    def mean(words: Column, ratio: Column) -> Column:
        def both(a: Column, b: Column) -> Column:
            one, two = (F.get(ratio, bucket.cast("int")) for bucket in _buckets(a, b, bits))
            return F.when(b.isNull(), one).otherwise(one + two)

        total = F.aggregate(F.zip_with(words, _next(words), both), F.lit(0.0), lambda s, x: s + x)
        return F.when(F.size(words) > 0, total / (2 * F.size(words) - 1))

    # one mention of each column: the optimiser then puts the table itself in its place and no row gets a copy
    score = let(F.col("words"), lambda w: let(F.col("_ratio"), lambda r: mean(w, r)))
    return out.withColumn("_ratio", table.scalar()).withColumn("score", score).drop("_ratio")


def _percentiles(rows: DataFrame, value: str, shares: list[float]) -> tuple[int, list[float]]:
    """The number of rows and the exact interpolated percentiles of a column without nulls.

    A sketch bounds each; the values within its bounds, some 8 / SKETCH of all, and the number of those below give the place.
    """
    n = rows.count()
    if not n:
        return 0, []
    room = 3 / SKETCH + 2 / n
    sketch = rows.agg(*[F.percentile_approx(value, [max(p - room, 0.0), min(p + room, 1.0)], SKETCH) for p in shares]).first()
    x = F.col(value)
    inside = [c for low, high in sketch for c in (F.count_if(x < low), F.sort_array(F.collect_list(F.when(x.between(low, high), x))))]
    found = rows.agg(*inside).first()
    out = []
    for k, p in enumerate(shares):
        at, (below, near) = p * (n - 1), found[2 * k : 2 * k + 2]
        low = int(at)
        a, b = near[low - below], near[min(low + 1, n - 1) - below] if at > low else near[low - below]
        out.append(a if a == b else (low + 1 - at) * a + (at - low) * b)
    return n, out


def _least(scores: DataFrame) -> float:
    """The threshold by a written table of the different scores of trusted documents; THRESHOLD at least, 0 at most."""
    n, (low, median) = _percentiles(scores, "score", [0.01, 0.5]) if not scores.isEmpty() else (0, (0.0, 0.0))
    return max(THRESHOLD, min(low - SPREADS * (median - low), 0.0)) if n >= MIN_SCORES else THRESHOLD


def least_score(docs: DataFrame, labels: DataFrame, table: DataFrame, bits: int) -> float:
    """The threshold by the scores of all trusted documents, copies once."""
    rows = _narrow(docs, _trusted(labels), "inner").where(F.size("words") >= MIN_WORDS)
    return _least(written(_scored(rows, table, bits).select("score").where("score is not null").distinct(), "scores"))


def _kept(threshold: float) -> Column:
    return ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, bits: int | None = None, threshold: float | None = None, smoothing: float = SMOOTHING) -> DataFrame:
    """docs with the base counts, base_failed, score and kept; bits and threshold by the corpus where not given."""
    bits = bits_for(docs) if bits is None else bits
    table = written(ratios(docs, labels, bits, smoothing), "ratios")
    threshold = least_score(docs, labels, table, bits) if threshold is None else threshold
    out = _scored(base_rules(docs), table, bits)
    return out.withColumn("kept", _kept(threshold)).drop("words")


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The kept documents, with the columns of docs."""
    judged = judge(docs.select(F.struct("*").alias("_row"), "doc_id", "text"), labels).select("_row", "kept")
    # a predicate is not pushed below a column of no fixed value: the verdict is computed once
    return judged.withColumn("_place", F.monotonically_increasing_id()).where("kept and _place >= 0").select("_row.*")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row of numbers for each document: written before there is a threshold, which takes its scores from them."""
    bits = bits_for(docs)
    table = written(ratios(docs, labels, bits), "ratios")
    counts = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    measured = written(_scored(base_rules(docs.select("doc_id", "text")), table, bits).select("doc_id", *counts, "score"), "measured")
    trusted = measured.withColumn("doc_id", F.col("doc_id").cast("long")).join(_trusted(labels), "doc_id").where(F.col("n_words") >= MIN_WORDS)
    threshold = _least(written(trusted.select("score").where("score is not null").distinct(), "scores"))
    return measured.select("doc_id", *counts, _kept(threshold).alias("kept"), "score")

import random
import re

import pytest

from tracewright.llm import ngram_join

SCHEMA = "doc_id long, text string"


def brute(docs, n_words, percent):
    sets = {}
    for i, t in docs:
        if i is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[k : k + n_words]) for k in range(len(w) - n_words + 1)} if len(w) >= n_words else ({tuple(w)} if w else set())
        if i not in sets or len(s) > len(sets[i]):
            sets[i] = s
    ids = sorted(sets)
    label = {i: i for i in ids}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(a), top(b)
                label[max(p, q)] = min(p, q)
    return {(i, len(sets[i]), top(i)) for i in ids}


def family(rng, start, size, words, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
        out.append((start + k, " ".join(w)))
    return out


@pytest.mark.parametrize(("n_words", "percent", "family_limit", "block"), [(3, 90, 4096, 256), (3, 90, 10, 16), (5, 80, 10, 16), (5, 80, 4096, 32)])
def test_components_equal_brute_force(spark, monkeypatch, n_words, percent, family_limit, block):
    rng = random.Random(n_words * percent)
    monkeypatch.setattr(ngram_join, "FAMILY", family_limit)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = family(rng, 0, 60, 120, 4) + family(rng, 100, 40, 60, 3) + family(rng, 200, 5, 300, 8) + family(rng, 300, 3, 40, 1)
    passage = " ".join(f"p{k}" for k in range(60))
    docs += [(400 + k, passage + " " + " ".join(f"u{k}-{j}" for j in range(k % 5))) for k in range(40)]
    docs += [(i + 500, t) for i, t in docs[:30]]
    docs += [(900, None), (901, ""), (902, " \t\n "), (903, "One two"), (904, "one TWO"), (905, "one"), (None, "x y z a b c"), (906, "É é a b"), (907, "é é a b")]
    got = ngram_join.near_duplicates(spark.createDataFrame(docs, SCHEMA).repartition(3), n_words, percent)
    assert {tuple(r) for r in got.collect()} == brute(docs, n_words, percent)


def test_repeated_ids_empty_table_and_other_columns(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None)]
    frame = spark.createDataFrame([(*d, 7, "x") for d in docs], SCHEMA + ", n long, sig string")
    assert {tuple(r) for r in ngram_join.near_duplicates(frame, 3, 90).collect()} == {(1, 6, 1), (2, 6, 1), (3, 0, 3)}
    kept = ngram_join.keep_one(frame, 3, 90)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 3]
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join.near_duplicates(empty).count() == 0
    assert ngram_join.keep_one(empty).count() == 0


def test_a_row_that_begins_many_partitions(spark):
    rng = random.Random(12)
    own = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    docs = []
    for k in range(12):
        text = own(30 + k)
        docs += [(500, "the same row in every partition of this table"), (600 + 2 * k, text), (601 + 2 * k, f"{text} more")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(docs, 12), SCHEMA)
    assert {tuple(r) for r in ngram_join.near_duplicates(df, 3, 90).collect()} == brute(docs, 3, 90)

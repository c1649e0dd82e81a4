"""Runs by grammar against all periods of all texts, the query's digests, and odd tables."""

import hashlib
import random
import re
import zlib

from tracewright.llm import periodic_runs as P

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=12):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                out.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def some_texts(rng, number):
    for _ in range(number):
        letters = [f"w{k}" for k in range(rng.choice([1, 2, 3, 8, 90]))]
        pick = lambda n: [rng.choice(letters) for _ in range(n)]  # noqa: B023, E731
        kind, n = rng.randrange(6), rng.choice([0, 1, 11, 12, 13, 40, 150])
        if kind == 0:
            t = pick(n)
        elif kind == 1:
            t = (pick(rng.randrange(1, 30)) * 150)[:n]
        elif kind == 2:
            t = pick(n) + pick(1) * rng.randrange(30) + pick(n)
        elif kind == 3:
            t = fibonacci(n)
        elif kind == 4:
            t = ["x"]
            while len(t) < n:
                t += ["y" if c == "x" else "x" for c in t]
        else:
            p, t = pick(rng.randrange(1, 12)), []
            while len(t) < n:
                t += p * rng.randrange(1, 5) + pick(rng.randrange(4))
                t += t if rng.random() < 0.3 else []
        yield t


def test_runs_of_many_texts_in_one_chunk():
    rng = random.Random(4)
    for size in (1, 7, 200):
        texts = [[w.encode() for w in t] for t in some_texts(rng, size)]
        found, bound = P._runs_of(texts, 12)
        for k, t in enumerate(texts):
            assert [tuple(r[1:]) for r in found[bound[k] : bound[k + 1]].tolist()] == brute(t)


def test_grammar_gives_the_text_back():
    rng = random.Random(5)
    texts = list(some_texts(rng, 60))
    names, first = {}, [0]
    words = []
    for t in texts:
        words += [names.setdefault(w, len(names)) for w in t]
        first.append(len(words))
    import numpy as np

    words, first = np.array(words), np.array(first)
    places, cuts, sizes = P.grammar(words, first)
    body = {}
    for symbol, a, m, b in places.tolist():
        assert a < m < b
        spelled = tuple(words[a:b].tolist()), m - a
        # a symbol is the same words, cut at the same place, wherever it stands
        assert body.setdefault(symbol, spelled) == spelled
    assert len(sizes) == len(texts) and sizes.sum() == len(cuts)
    at = 0
    for t, n in enumerate(sizes.tolist()):
        bounds = [int(first[t]), *cuts[at : at + n].tolist(), int(first[t + 1])]
        at += n
        left = [tuple(words[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
        pairs = list(zip(left, left[1:]))
        # nothing that is left repeats, but for three equal symbols in a row
        assert all(pairs.count(p) == 1 or p[0] == p[1] for p in pairs)
    once = np.array([0] * 4096)
    assert len(np.unique(P.grammar(once, np.array([0, 4096]))[0][:, 0])) == 11


def brute_digest(rows):
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        found = brute(w)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        out.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_digest_and_odd_tables(spark, monkeypatch):
    rng = random.Random(6)
    odd = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id " * 30), (None, None), (5, "é\xa0x é\xa0x " * 9 + "\x1c"), (2**60, "ab " * 12)]
    rows = odd + [(k, " ".join(t)) for k, t in enumerate(some_texts(rng, 400), 10)] + [(7, " ".join(f"long{k % 700}" for k in range(9000)))]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as start", "2 as words", "'x' as period").repartition(3)
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(brute_digest(rows), key=key)
    assert sorted(map(tuple, P.digest(docs).collect()), key=key) == want
    assert P.digest(docs.where("false")).count() == 0
    assert any(r[1] for r in want if r[0] and zlib.crc32(str(r[0]).encode()) % 10 == 0)


def test_runs_and_collapse(spark):
    rows = [(1, "a b  " + "x y " * 10 + "z"), (1, "q w"), (2, None), (3, " ".join("k" * 1 for _ in range(12)))]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("'p' as start", "text", "doc_id")
    assert sorted(tuple(r) for r in P.runs(docs).collect()) == [(1, 2, 20, 2), (3, 0, 12, 1)]
    out = P.collapse(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, "a b x y z"), (1, "q w"), (2, None), (3, "k")], key=str)

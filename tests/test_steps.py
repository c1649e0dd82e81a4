"""Solutions as steps, against an index-based twin, and texts that come back whole."""

import random
import re

from pyspark.sql import functions as F

from tracewright.functions import steps

FORMULA = re.compile(
    r"\[asy\].*?\[/asy\]|\$\\begin\{tabular\}.*?\\end\{tabular\}\$|\\begin\{tabular\}.*?\\end\{tabular\}|\\\(.*?\\\)|\\\[.*?\\\]|\$\$.*?\$\$|(?<!\\)\$.*?[^\\]\$(?!\$)|\\begin\{([^}]*)\}.*?\\end\{\1\}", re.S
)
CLOSE = (".$", ".$$", ".\\)", ".\\]")


def spans(t):
    return [m.span() for m in FORMULA.finditer(t)]


def inside(at, sp):
    return any(a < at < b for a, b in sp)


def hidden(t, sp, a, b):
    """Length of t[a:b] with each formula that lies in it as 60 characters."""
    return b - a - sum(min(y, b) - max(x, a) for x, y in sp if a <= x and y <= b) + 60 * sum(a <= x and y <= b for x, y in sp)


def join_on(cuts, goes_on, last_back):
    """Bounds after joining pieces that go on to the next, and the last to its predecessor."""
    out, k = list(cuts), 0
    while k + 1 < len(out):
        if goes_on(out[k], out[k + 1]):
            if k + 2 < len(out):
                del out[k + 1]
                continue
            if last_back and k > 0:
                del out[k]
                break
        k += 1
    return out


def halve(p, sp, signs, least, size):
    for sign, n in signs:
        at = [m.start() + n for m in re.finditer(sign, p) if not inside(m.start(), sp) and not any(a <= m.start() < b for a, b in sp)]
        at = [x for x in at if 0 < x < len(p)]
        if at:
            total = size(0, len(p))
            best = min(at, key=lambda x: (abs(2 * size(0, x) - total), x))
            if min(best, len(p) - best) >= least:
                return best
    return None


LANGUAGE = [(",", 1), (r"\sand(?=\s)", 4), (":", 1), (r"\sto(?=\s)", 3)]
MATHS = [(r",\$", 2), (r",\\\)", 3), (r",\\\]", 3), ("=", 1), (r"\\equiv", 6), (r"\+", 1), (r"\\cancelto", 9)]


def twin(t):
    if not t:
        return []
    sp = spans(t)
    stops = {m.start() for m in re.finditer(r"(?<!\b[A-Za-z]\.)(?<!\s[A-Za-z][A-Za-z]\.)(?<=\.)(?=\s+[A-Z])", t, re.A)} | {m.start() for m in re.finditer("\n", t)}
    cuts = [0] + sorted(x for x in stops if x and not inside(x, sp)) + [len(t)]
    ends = lambda a, b: t[a:b].endswith(".") and not any(y == b for _, y in sp)
    cuts = join_on(cuts, lambda a, b: hidden(t, sp, a, b) < 20 and not ends(a, b), False)
    closed = lambda a, b: t[a:b].endswith(CLOSE)
    cuts = sorted(set(cuts) | {b for a, b in sp if t[a:b].endswith(CLOSE)})
    cuts = join_on(cuts, lambda a, b: b - a < 20 and not closed(a, b), True)
    cuts = sorted(set(cuts) | {m.start() for m in re.finditer("\n", t) if inside(m.start(), sp)})
    lone = re.compile(r"\$|\$\$|\\\(|\\\[|\\begin\{[^}]*\}|\[asy\]")
    cuts = join_on(cuts, lambda a, b: b - a < 3 or lone.fullmatch(t[a:b].strip()), True)
    out = []
    for a, b in zip(cuts, cuts[1:]):
        todo, low, high = [(t[a:b], 0)], -1, 0
        while todo:
            p, start = todo.pop(0)
            at = None
            if len(p) > 100:
                inner = spans(p)
                if not low <= start < high:
                    at = halve(p, inner, LANGUAGE, 40, lambda x, y, p=p, inner=inner: hidden(p, inner, x, y))
                if at is None:
                    at = halve(p, [], MATHS, 20, lambda x, y: y - x)
                    if at is not None:
                        low, high = (at if low == -1 else min(low, at)), max(high, len(p))
            if at is None:
                out.append(p)
            else:
                todo[:0] = [(p[:at], start), (p[at:], start + at)]
    return out


CASES = [
    "", "x", "short one", "We have $x = 2.$ Then $y = 3.$\nSo the answer is \\boxed{5}.", "By Mr. A. Smith. He said so. And J. K. did.",
    "\\[\na + b = c\n\\]\nHence it holds, and we go on to the next part: " + "word " * 30, "$$" + "x + " * 60 + "y$$", "[asy]\ndraw((0,0));\n[/asy]\n\nThe area is $4$.", "open $ never closed. But. Then it goes, on and on, and on to the end " * 4,
    "\\begin{align*}\nx &= 1 \\\\\ny &= 2\n\\end{align*}\nDone.", "a, " * 80, "one\n\n\ntwo", "First $a, b,$ " + "then more words follow here and " * 8 + "$c=d$.", "price is \\$5. Then \\$6. Now " + "é" * 30 + ". Ä. Bc. Da.",
]


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in df.select("i", steps.solution_pieces(F.col("t"))).orderBy("i").collect()]


def test_pieces_like_the_twin(spark):
    rng = random.Random(8)
    bits = ["Thus we get ", "so it is. ", "Now ", "A. ", "\n", "$x$", "$x = y.$", "\\(a+b\\)", "\\[\nu = v + w\n\\]", "$$p=q.$$", ", ", " and ", ": ", " to ", "=", "+", "the value of the whole thing ", "\\begin{cases}\n1\\\\2\n\\end{cases}", ".", " ", "$", "\\$"]
    texts = CASES + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400)]
    got = run(spark, [*texts, None])
    assert got[-1] is None
    for t, g in zip(texts, got):
        assert "".join(g) == t
        assert g == twin(t), t


def test_plain_texts_take_the_short_way_to_the_same_pieces(spark, monkeypatch):
    rng = random.Random(9)
    bits = ["Thus we get ", "so it is. ", "Now ", "A. ", "\n", ", ", ",", " and ", "\tand\n", ": ", " to ", "to", "=", "+", "😀 ", "the value of the whole thing ", ".", " "]
    texts = ["", ",", "\n", "\n\nA", "x" * 99 + "," + "x" * 99, "x" * 50 + "," + "x" * 49, "x" * 60 + ",y," + "x" * 60, "x=" * 300]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(400)]
    monkeypatch.setattr(steps, "units", None)  # before, every text went by its units
    x = F.col("t")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    short = [r[0] for r in df.orderBy("i").select(steps._plain_pieces(x)).collect()]
    monkeypatch.undo()
    long = [r[0] for r in df.orderBy("i").select(steps._pieces_with_formulas(x)).collect()]
    assert short == long == [twin(t) for t in texts] == run(spark, texts)


def test_very_long_texts(spark):
    texts = ["word, and more = " * 4000, "\\(" * 3000, "x" * 60_000, "A b. " * 8000]
    assert ["".join(g) for g in run(spark, texts)] == texts

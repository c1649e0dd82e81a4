"""Equality of expressions: known pairs, random polynomials written two ways, reading and precedence."""

import random

from pyspark.sql import functions as F

from tracewright.functions import expressions as E
from tracewright.operators.grading import graded

SAME = """x(x+1) = x^2+x; 2^-1 = 1/2; (x+1)^3 = x^3+3x^2+3x+1; \\frac{x^2-1}{x-1} = x+1; sqrt(8) = 2sqrt(2); \\sqrt{8} = 2\\sqrt{2}; sin(x)^2+cos(x)^2 = 1; \\sin^2 x+\\cos^2 x = 1; sin(2x) = 2sin(x)cos(x);
log(8) = 3log(2); 0.25 = 1/4; 5! = 120; -x^2 = -(x^2); 1/2x = x/2; a+b = b+a; ab = ba; x_1+x_2 = x_2+x_1; pi/4 = arctan(1); arcsin(1/2) = pi/6; arccos(0) = \\frac{\\pi}{2}; tan(pi/4) = 1; \\frac12 = 0.5; \\frac1{2} = \\frac{1}2; \\dfrac x{10} = 0.1x; \\frac{x+1}2y = 0.5xy+y/2; \\sqrt[3]{27} = 3;
x^(1/2) = sqrt(x); sqrt2 = sqrt(2); \\frac{1}{1+\\frac{1}{x}} = \\frac{x}{x+1}; exp(x+y) = exp(x)exp(y); 2--3 = 5; 2*-3 = -6; x^2^3 = x^8; \\frac{1}{\\sqrt{2}} = \\frac{\\sqrt{2}}{2}; inf = inf; sec(x) = 1/cos(x);
sqrt(3+2sqrt(2)) = 1+sqrt(2); 0^0 = 1; x/x = 1; ((x)) = x; cot(x) = 1/tan(x); csc(x)sin(x) = 1; arccot(1) = pi/4; cos(2x) = 1-2sin(x)^2; ln(exp(1)) = 1; (1+x)/(1-x) = -(x+1)/(x-1); 3!x = 6x; \\left(x+1\\right)^2 = x^2+2x+1;
2\\cdot3x = 6x; \\frac{\\frac{a}{b}}{c} = \\frac{a}{bc}; a^{n}a = a^{n+1}; \\sqrt{x}\\sqrt{x} = x; 10^{20}+1-10^{20} = 1; (x-y)(x+y) = x^2-y^2; 1.5x = \\frac{3}{2}x; abs(-3) = 3; x\\div2 = 0.5x; \\operatorname{ln}(2)+\\ln 3 = \\ln(6)"""
OTHER = """(x+1)^3 = x^3+3x^2+3x+2; sqrt(x^2) = x; 0.3333333333 = 1/3; -x^2 = (-x)^2; 10^18+1 = 10^18; 2^{100}-1 = 2^{100}; (x = x; x+ = x; # = #; 2 3 = 6; 1/0 = 1/0; x/0 = x/0; (-8)^(1/3) = -2; -inf = inf; sin(x) = cos(x); x = y; x_1 = x_2;
log(x^2) = 2log(-x); sin(x)^2 = sin(x^2); 2x = x^2; sqrt(x+y) = sqrt(x)+sqrt(y); a/b/c = a/(b/c); 2^3^2 = 64; x! = x; (1,2) = (1,2); 5%=5; tan(x) = sin(x)/x; x) = x; ()= 0; pi = 22/7; 25! = 25!+1; x^y = y^x"""


def pairs(text, verdict):
    return [(*(s.strip() for s in p.split("=", 1)), verdict) for p in text.replace("\n", " ").split(";")]


def spelled(p, rng):
    """A polynomial {(i, j): coefficient} as text, terms in any order."""
    terms = [(c, i, j) for (i, j), c in p.items() if c] or [(0, 0, 0)]
    rng.shuffle(terms)
    power = lambda v, k: "" if k == 0 else v if k == 1 else f"{v}^{k}" if rng.random() < 0.5 else f"{v}^{{{k}}}"
    return "+".join(f"{c}{power('x', i)}{power('y', j)}" for c, i, j in terms)


def times(p, q):
    out = {}
    for (a, b), c in p.items():
        for (d, e), f in q.items():
            out[a + d, b + e] = out.get((a + d, b + e), 0) + c * f
    return out


def random_pairs(n):
    rng, out = random.Random(3), []
    factor = lambda: {(rng.randrange(3), rng.randrange(2)): rng.randrange(-9, 10) for _ in range(rng.randrange(1, 4))}
    for _ in range(n):
        factors = [factor() for _ in range(rng.randrange(1, 4))]
        whole = {(0, 0): 1}
        for f in factors:
            whole = times(whole, f)
        given = "".join(f"({spelled(f, rng)})" for f in factors)
        changed = rng.random() < 0.5
        if changed:
            whole[1, 1] = whole.get((1, 1), 0) + rng.choice([1, -1, 10**12])
        out.append((given, spelled(whole, rng), not changed))
    return out


def test_known_pairs_and_random_polynomials(spark):
    rows = pairs(SAME, True) + pairs(OTHER, False) + random_pairs(130)
    assert len(rows) > 200
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    got = df.select("a", "b", "want", E.same_expression(F.col("a"), F.col("b")).alias("got"), E.same_expression(F.col("b"), F.col("a")).alias("back")).collect()
    assert [r for r in got if r["got"] != r["want"] or r["back"] != r["want"]] == []


def test_nulls_nearness_and_precedence(spark):
    df = spark.createDataFrame([("x", None), (None, "x"), ("", ""), ("0.7853", "\\frac{\\pi}{4}"), ("0.79", "\\frac{\\pi}{4}"), ("x+0.0001", "x")], "a string, b string")
    near = [r[0] for r in df.select(E.same_expression(F.col("a"), F.col("b"), near=1e-3)).collect()]
    assert near == [None, None, False, True, False, False]
    texts = {"1-2-3": "1 2 - 3 -", "2^3^2": "2 3 2 ^ ^", "-x^2": "x 2 ^ neg", "2x(y)": "2 x * y *", "sin x^2y": "x 2 ^ sin y *", "sin(x)^2": "x sin 2 ^", "2(": None, "3!^2": "3 ! 2 ^", "a-(-b)": "a b neg -"}
    rows = spark.createDataFrame([(k,) for k in texts], "x string")
    assert [r[0] for r in rows.select(F.array_join(E.postfix(E.tokens(E.plain(F.col("x")))), " ")).collect()] == list(texts.values())


def test_graded_pairs_keep_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "a", "a"), (3, None, "a"), (4, None, None), (5, "b", "a")], "i int, g string, h string")
    got = graded(df, "g", "h", lambda a, b: a == b, "same").orderBy("i").collect()
    assert [(r["i"], r["same"]) for r in got] == [(1, True), (2, True), (3, None), (4, None), (5, False)]

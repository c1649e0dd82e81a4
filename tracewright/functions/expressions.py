"""Equality of mathematical expressions as columns, by identity testing instead of algebra.

A text becomes tokens, and tokens a postfix row by precedence. A stack machine, a fold
over that row, evaluates both sides at seeded points:

- modulo the prime 2^31 - 1 where both are rational, that is numbers, letters, + - * /,
  whole powers and factorials. Different expressions agree at one point with probability
  at most d / 2^31, d the degree of their difference, so at POINTS points with at most
  (d / 2^31) ** POINTS; equal ones always agree. Decimals count as the fractions they are.
- else in complex numbers, with roots, logarithms and trigonometric functions on their
  principal branches; agreement is within TOLERANCE of the larger value at each point.

Read are numbers, single letters (with a subscript), pi, the names in FUNCTIONS, products
without a sign, powers of function names as in sin^2 x, and fractions, roots and braces of
LaTeX. 1/2x is x/2, -x^2 is -(x^2). What cannot be read equals nothing; a null gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

PRIME = (1 << 31) - 1
POINTS = 3
TOLERANCE = 1e-9

CIRCULAR = ("sin", "cos", "tan", "cot", "sec", "csc")
#: Names that are applied to what follows.
FUNCTIONS = ("sqrt", "exp", "log", "ln", "abs", *CIRCULAR, *(p + c for p in ("arc", "a") for c in ("sin", "cos", "tan", "cot")))

_CIRCULAR = rf"(?:arc|a)?(?:{'|'.join(CIRCULAR)})"
_FUNCTION = rf"(?:{_CIRCULAR}|sqrt|exp|log|ln|abs)(?:\^\(?[0-9]\)?)?"
_ATOM = r"pi|infty|inf|[a-zA-Z](?:_[a-zA-Z0-9]+)?"
_NUMBER = r"[0-9]+\.?[0-9]*|\.[0-9]+"
_TOKEN = rf"{_NUMBER}|{_CIRCULAR}\^\(?[0-9]\)?(?![0-9])|{_CIRCULAR}|sqrt|exp|log|ln|abs|{_ATOM}|[-+*/^()!]"


def plain(x: Column) -> Column:
    """LaTeX as signs, names and parentheses; pairs of braces go from the inside out."""
    steps = (
        (r"\\[dtc]?frac\{([^{}]*)\}\{([^{}]*)\}", "(($1)/($2))"), (r"\\sqrt\[([^\[\]{}]*)\]\{([^{}]*)\}", "(($2)^(1/($1)))"), (r"\\sqrt\{([^{}]*)\}", "sqrt($1)"),
        (r"\\[dtc]?frac\{([^{}]*)\}\s*([0-9a-zA-Z])", "(($1)/$2)"), (r"\^\{([^{}]*)\}", "^($1)"), (r"_\{([^{}]*)\}", "_$1"), (r"\\(?:text|mathrm|mathbf|mathit|operatorname)\{([^{}]*)\}", "$1"),
    )

    def once(s: Column) -> Column:
        for old, new in steps:
            s = F.regexp_replace(s, old, new)
        return s

    first = F.regexp_replace(x, r"\\left|\\right|\\[,;!: ]|~", "")
    for old, new in ((r"([0-9a-zA-Z])\s*([0-9a-zA-Z])", "{$1}{$2}"), (r"([0-9a-zA-Z])\s*(?=\{)", "{$1}")):
        first = F.regexp_replace(first, r"\\[dtc]?frac\s*" + old, r"\\frac" + new)
    braced = F.aggregate(F.sequence(F.lit(0), F.size(F.split(first, r"\{", -1))), first, lambda s, _: once(s))
    out = F.regexp_replace(F.regexp_replace(braced, r"\\cdot|\\times|·|×", "*"), r"\\div|÷", "/")
    out = F.replace(F.replace(F.regexp_replace(out, r"\\(?=[a-z])", ""), F.lit("**"), F.lit("^")), F.lit("√"), F.lit("sqrt"))
    out = F.replace(F.replace(out, F.lit("π"), F.lit("pi")), F.lit("−"), F.lit("-"))
    return F.translate(out, "{}", "()")


def tokens(x: Column) -> Column:
    """Tokens with every product written out and minus signs told apart; null if some character belongs to none."""
    number = lambda t: t.rlike(rf"^(?:{_NUMBER})$")
    ends = lambda t: t.rlike(rf"^(?:{_NUMBER}|{_ATOM}|[)!])$")
    begins = lambda t: t.rlike(r"^[0-9.a-zA-Z(]")
    array = lambda *t: F.array(*[F.lit(v) if isinstance(v, str) else v for v in t])

    def of(found: Column) -> Column:
        def written(t: Column, i: Column) -> Column:
            before = F.coalesce(ends(F.get(found, i - 1)), F.lit(False))
            return F.when(t.isin("+", "-") & ~before, F.when(t == "-", array("neg")).otherwise(F.slice(array(t), 1, 0))).when(before & begins(t), array("*", t)).otherwise(array(t))

        whole = F.length(F.array_join(found, "")) == F.length(F.regexp_replace(x, r"\s", ""))
        apart = F.exists(F.transform(found, lambda t, i: number(t) & F.coalesce(number(F.get(found, i - 1)), F.lit(False))), lambda v: v)
        return F.when(whole & ~apart & (F.size(found) > 0), F.flatten(F.transform(found, written)))

    return let(F.regexp_extract_all(x, F.lit(_TOKEN), F.lit(0)), of)


def postfix(row: Column) -> Column:
    """Tokens in postfix order; null if parentheses do not match."""
    none = F.expr("cast(array() as array<string>)")
    is_function = lambda t: F.coalesce(t.rlike(rf"^(?:{_FUNCTION})$"), F.lit(False))
    rest = lambda a, k: F.slice(a, k + 1, F.size(a))

    def order(t: Column) -> Column:
        return F.when(t.isin("+", "-"), 1).when(t.isin("*", "/"), 2).when(t == "neg", 3).when(t == "^", 5).when(t == "(", 0).otherwise(4)

    def state(out: Column, ops: Column) -> Column:
        return F.struct(out.alias("out"), ops.alias("ops"))

    def move(s: Column, k: Column) -> Column:
        return F.concat(s["out"], F.slice(s["ops"], F.lit(1), k))

    def step(s: Column, t: Column) -> Column:
        def closed(at: Column) -> Column:
            # up to the parenthesis, and the function that it belongs to
            inner = F.slice(s["ops"], F.lit(1), at - 1)
            applied = is_function(F.get(s["ops"], at))
            done = state(F.concat(s["out"], inner, F.when(applied, F.array(F.get(s["ops"], at))).otherwise(none)), rest(s["ops"], at + F.when(applied, 1).otherwise(0)))
            return F.when(at > 0, done).otherwise(state(F.lit(None).cast("array<string>"), s["ops"]))

        def binary(k: Column) -> Column:
            return state(move(s, k), F.concat(F.array(t), rest(s["ops"], k)))

        stays = F.transform(s["ops"], lambda o: ~((order(o) > order(t)) | ((order(o) == order(t)) & (t != "^"))))
        popped = let(F.array_position(stays, F.lit(True)), lambda k: F.when(k > 0, k - 1).otherwise(F.size(s["ops"])).cast("int"))
        pushed = state(s["out"], F.concat(F.array(t), s["ops"]))
        return (
            F.when(t.isin("(", "neg") | is_function(t), pushed)
            .when(t == ")", let(F.array_position(s["ops"], F.lit("(")).cast("int"), closed))
            .when(t.isin("+", "-", "*", "/", "^"), let(popped, binary))
            .otherwise(state(F.concat(s["out"], F.array(t)), s["ops"]))
        )

    return F.aggregate(row, state(none, none), step, lambda s: F.when(~F.array_contains(s["ops"], "("), F.concat(s["out"], s["ops"])))


def _machine(row: Column, kind: str, operand, unary: dict, binary: dict, function) -> Column:
    """The one value left of a postfix row, null if operands are missing or left over. Values are of type kind, on top of the stack first."""

    def of_both(f):
        return lambda s: f(s["a"], s["b"])

    def step(stack: Column, t: Column) -> Column:
        put = lambda v, used: F.concat(F.array(v.cast(kind)), F.slice(stack, F.lit(used + 1), F.size(stack)))
        top, below = F.get(stack, F.lit(0)), F.get(stack, F.lit(1))
        out = F.when(t.rlike(rf"^(?:{_NUMBER}|{_ATOM})$"), put(operand(t), 0))
        for name, f in unary.items():
            out = out.when(t == name, put(f(top), 1))
        both = F.struct(below.alias("a"), top.alias("b"))
        for name, f in binary.items():
            out = out.when(t == name, put(let(both, of_both(f)), 2))
        return out.otherwise(put(function(t, top), 1))

    return F.aggregate(row, F.expr(f"cast(array() as array<{kind}>)"), step, lambda s: F.when(F.size(s) == 1, F.get(s, F.lit(0))))


# modulo a prime


def _power(base: Column, exponent: Column) -> Column:
    """base ** exponent modulo PRIME, 0 <= exponent < 2**31."""
    start = F.struct(F.lit(1).cast("bigint").alias("r"), base.alias("b"), exponent.cast("bigint").alias("e"))

    def square(s: Column, _: Column) -> Column:
        odd = s["e"] % 2 == 1
        return F.struct(F.when(odd, s["r"] * s["b"] % PRIME).otherwise(s["r"]).alias("r"), (s["b"] * s["b"] % PRIME).alias("b"), F.shiftright(s["e"], 1).alias("e"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), start, square, lambda s: s["r"])


def _inverse(v: Column) -> Column:
    return F.when(v != 0, _power(v, F.lit(PRIME - 2)))


def modular(row: Column, point: Column) -> Column:
    """The value of a rational expression at a point modulo PRIME; null if it is not rational or divides by zero there."""
    exact = lambda w: F.when(F.abs(w) < 1 << 53, w)
    make = lambda v, w: F.struct(v.alias("v"), w.cast("bigint").alias("w"))
    null = F.lit(None).cast("bigint")

    def operand(t: Column) -> Column:
        decimals = F.length(F.regexp_extract(t, r"\.([0-9]*)$", 1))
        digits = F.replace(t, F.lit("."), F.lit("")).try_cast("decimal(38,0)")
        whole = F.pmod(digits, F.lit(PRIME)).cast("bigint")
        number = make(F.when(decimals == 0, whole).otherwise(whole * _inverse(_power(F.lit(10).cast("bigint"), decimals)) % PRIME), F.when(decimals == 0, exact(t.try_cast("bigint"))))
        letter = make(F.pmod(F.xxhash64(t, point), F.lit(PRIME - 2)) + 2, null)
        return F.when(t.rlike("^[0-9.]"), number).when(t == "pi", make(null, null)).otherwise(letter)

    def factorial(a: Column) -> Column:
        n = F.when((a["w"] >= 0) & (a["w"] <= 20), F.factorial(a["w"].cast("int")))
        return make(n % PRIME, exact(n))

    def power(a: Column, b: Column) -> Column:
        e = b["w"]
        raised = F.when(a["v"] == 0, F.when(e > 0, 0).when(e == 0, 1)).otherwise(_power(a["v"], F.pmod(e, F.lit(PRIME - 1))))
        small = F.when((e >= 0) & (F.pow(F.abs(a["w"]), e) < 1 << 53), F.pow(a["w"], e))
        return make(F.when(e.isNotNull(), raised.cast("bigint")), small)

    unary = {"neg": lambda a: make((PRIME - a["v"]) % PRIME, -a["w"]), "!": factorial}
    small = lambda a: F.abs(a["w"]) < 1 << 26
    binary = {
        "+": lambda a, b: make((a["v"] + b["v"]) % PRIME, exact(a["w"] + b["w"])), "-": lambda a, b: make((a["v"] - b["v"] + PRIME) % PRIME, exact(a["w"] - b["w"])),
        "*": lambda a, b: make(a["v"] * b["v"] % PRIME, F.when(small(a) & small(b), a["w"] * b["w"])), "^": power,
        "/": lambda a, b: make(a["v"] * _inverse(b["v"]) % PRIME, F.when((b["w"] != 0) & (F.try_mod(a["w"], b["w"]) == 0), F.try_divide(a["w"], b["w"]))),
    }
    return _machine(row, "struct<v: bigint, w: bigint>", operand, unary, binary, lambda t, a: make(null, null))["v"]


# complex numbers


def _c(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def _times(a: Column, b: Column) -> Column:
    return _c(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def _over(a: Column, b: Column) -> Column:
    size = b["re"] * b["re"] + b["im"] * b["im"]
    return let(size, lambda d: F.when(d != 0, _c((a["re"] * b["re"] + a["im"] * b["im"]) / d, (a["im"] * b["re"] - a["re"] * b["im"]) / d)))


def _exp(z: Column) -> Column:
    return _c(F.exp(z["re"]) * F.cos(z["im"]), F.exp(z["re"]) * F.sin(z["im"]))


def _log(z: Column) -> Column:
    # a negative zero would take the other side of the branch cut
    return F.when((z["re"] != 0) | (z["im"] != 0), _c(F.ln(F.hypot(z["re"], z["im"])), F.atan2(z["im"] + 0.0, z["re"])))


def _raised(a: Column, b: Column) -> Column:
    at_zero = F.when(b["re"] > 0, _c(F.lit(0.0), F.lit(0.0))).when((b["re"] == 0) & (b["im"] == 0), _c(F.lit(1.0), F.lit(0.0)))
    return F.when((a["re"] == 0) & (a["im"] == 0), at_zero).otherwise(let(let(_log(a), lambda u: _times(b, u)), _exp))


def _root(z: Column) -> Column:
    return _raised(z, _c(F.lit(0.5), F.lit(0.0)))


_ONE = (1.0, 0.0)


def _constant(re: float, im: float) -> Column:
    return _c(F.lit(re), F.lit(im))


def _circular(name: Column, z: Column) -> Column:
    """One of CIRCULAR as a quotient of sine, cosine and one."""
    sin = _c(F.sin(z["re"]) * F.cosh(z["im"]), F.cos(z["re"]) * F.sinh(z["im"]))
    cos = _c(F.cos(z["re"]) * F.cosh(z["im"]), -F.sin(z["re"]) * F.sinh(z["im"]))

    def of(s: Column) -> Column:
        top = F.when(name.isin("sin", "tan"), s["sin"]).when(name.isin("cos", "cot"), s["cos"]).otherwise(_constant(*_ONE))
        under = F.when(name.isin("sin", "cos"), _constant(*_ONE)).when(name.isin("tan", "sec"), s["cos"]).otherwise(s["sin"])
        return let(F.struct(top.alias("t"), under.alias("u")), lambda q: _over(q["t"], q["u"]))

    return let(F.struct(sin.alias("sin"), cos.alias("cos")), of)


def _inverse_circular(name: Column, z: Column) -> Column:
    """Inverse of sin, cos, tan or cot: the last two by one logarithm each of 1 + iz and 1 - iz, the first by that of iz + sqrt(1 - z^2)."""

    def tangent(u: Column) -> Column:
        both = F.struct(_log(_c(1 + u["im"], -u["re"])).alias("a"), _log(_c(1 - u["im"], u["re"])).alias("b"))
        return let(both, lambda s: _c(-(s["a"]["im"] - s["b"]["im"]) / 2, (s["a"]["re"] - s["b"]["re"]) / 2))

    square = _c(1 - z["re"] * z["re"] + z["im"] * z["im"], -2 * z["re"] * z["im"])
    sine = let(let(square, _root), lambda r: let(_log(_c(r["re"] - z["im"], r["im"] + z["re"])), lambda u: _c(u["im"], -u["re"])))
    of_sine = let(sine, lambda s: F.when(name == "sin", s).otherwise(_c(math.pi / 2 - s["re"], -s["im"])))
    return F.when(name.isin("sin", "cos"), of_sine).otherwise(let(F.when(name == "tan", z).otherwise(_over(_constant(*_ONE), z)), tangent))


def complex_value(row: Column, point: Column) -> Column:
    """The value of an expression at a point in complex numbers; null where it has none."""
    share = lambda t, k: F.pmod(F.xxhash64(t, point, F.lit(k)), F.lit(1_000_003)) / 1_000_003

    def operand(t: Column) -> Column:
        letter = _c((0.4 + 1.7 * share(t, 0)) * F.when(point % 2 == 0, -1).otherwise(1), 0.3 + 0.9 * share(t, 1))
        return F.when(t.rlike("^[0-9.]"), _c(t.try_cast("double"), F.lit(0.0))).when(t == "pi", _c(F.lit(math.pi), F.lit(0.0))).otherwise(letter)

    def factorial(a: Column) -> Column:
        whole = (a["im"] == 0) & (a["re"] == F.round(a["re"])) & (a["re"] >= 0) & (a["re"] <= 20)
        return F.when(whole, _c(F.factorial(F.when(whole, a["re"]).cast("int")), F.lit(0.0)))

    def function(t: Column, z: Column) -> Column:
        name, power = F.regexp_extract(t, "^([a-z]+)", 1), F.regexp_extract(t, r"\^\(?([0-9])", 1)
        of = F.when(name == "sqrt", _root(z)).when(name == "exp", _exp(z)).when(name.isin("log", "ln"), _log(z)).when(name == "abs", _c(F.hypot(z["re"], z["im"]), F.lit(0.0)))
        of = of.when(name.isin(*CIRCULAR), _circular(name, z)).otherwise(_inverse_circular(F.substring(name, F.length(name) - 2, F.lit(3)), z))
        return let(of, lambda v: F.when(power == "", v).otherwise(_raised(v, _c(power.try_cast("double"), F.lit(0.0)))))

    unary = {"neg": lambda a: _c(-a["re"], -a["im"]), "!": factorial}
    binary = {
        "+": lambda a, b: _c(a["re"] + b["re"], a["im"] + b["im"]), "-": lambda a, b: _c(a["re"] - b["re"], a["im"] - b["im"]), "*": _times, "/": _over, "^": _raised,
    }
    return _machine(row, "struct<re: double, im: double>", operand, unary, binary, lambda t, z: let(z, lambda v: function(t, v)))


# equality


def same_expression(a: Column, b: Column, near: float | None = None) -> Column:
    """Whether two texts are the same expression. near: two constants may also differ by so much."""
    rows = F.transform(F.array(a, b), lambda x: postfix(tokens(plain(x))))

    def close(v: Column) -> Column:
        x, y = F.get(v, F.lit(0)), F.get(v, F.lit(1))
        size = F.greatest(F.lit(1.0), F.hypot(x["re"], x["im"]), F.hypot(y["re"], y["im"]))
        return F.hypot(x["re"] - y["re"], x["im"] - y["im"]) <= TOLERANCE * size

    def of(s: Column) -> Column:
        # the values of both sides at each point; null where a side has none
        values = lambda f: F.transform(F.sequence(F.lit(1), F.lit(POINTS)), lambda k: F.transform(s, lambda row: f(row, k)))

        def decided(m: Column) -> Column:
            return F.when(F.forall(m, lambda v: F.forall(v, lambda c: c.isNotNull())), m)

        def numeric(m: Column) -> Column:
            agree = F.forall(m, close)
            if near is None:
                return agree
            constant = ~F.exists(F.flatten(s), lambda t: t.rlike(r"^(?:infty|inf|[a-zA-Z](?:_[a-zA-Z0-9]+)?)$"))
            x, y = (F.get(F.get(m, F.lit(0)), F.lit(k)) for k in (0, 1))
            return F.when(constant, F.hypot(x["re"] - y["re"], x["im"] - y["im"]) <= near).otherwise(agree)

        exact = let(decided(values(modular)), lambda m: F.forall(m, lambda v: F.get(v, F.lit(0)) == F.get(v, F.lit(1))))
        inexact = let(decided(values(complex_value)), numeric)
        # two constants that may differ a little are compared as numbers where they are not the same
        out = F.coalesce(exact, inexact, F.lit(False)) if near is None else F.coalesce(F.when(exact, True), inexact, F.lit(False))
        return F.when(F.exists(s, lambda r: r.isNull()), False).otherwise(out)

    return F.when(a.isNotNull() & b.isNotNull(), let(rows, of))

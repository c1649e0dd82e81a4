"""Graders of competition answers as columns: ordered rewriting to a normal form, then comparison.

Three families grade mathematical answers: the competition normal form, the
process-reward form (text, units, numbers) and the list form (several answers,
tuples, matrices, equations). Rewriting is a table of steps, so a form is data;
what depends on structure (braces, tuples, lists) is an array expression.

No computer algebra: where the original would simplify symbolically, two sides
are equal if they are the same text, have the same value, or agree as expressions
at seeded points (module ``expressions``). LaTeX becomes text for the commands of
``LATEX_TEXT`` only in the process form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import same_expression
from .text import let, strip

#: A step rewrites all occurrences: plain text (old, new), or a pattern (old, new, "re").
Step = tuple[str, ...]

# What each form rewrites or drops, in this order.
COMPETITION_FIRST: tuple[Step, ...] = (
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
)
COMPETITION_THEN: tuple[Step, ...] = (("\\%", ""), (" .", " 0."), ("{.", "{0."), (r"^\.", "0.", "re"))
ROOTS: tuple[Step, ...] = ((r"\\sqrt([^{])", r"\\sqrt{$1}", "re"),)
FRACTIONS: tuple[Step, ...] = ((r"\\frac([^{])([^{])", r"\\frac{$1}{$2}", "re"), (r"\\frac([^{])\{", r"\\frac{$1}{", "re"))
UNITS = "degree cm centimeter meter mile second minute hour day week month year foot feet inch yard".split()
PROCESS_FIRST: tuple[Step, ...] = (
    ("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "), ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12"),
    *((rf"{u}(es)?(s)? *(\^[0-9]+)?", "", "re") for u in UNITS), (r"\^ *\\circ", "", "re"),
)
LATEX_TEXT: tuple[Step, ...] = (
    ("\\tfrac", "\\frac"), ("\\dfrac", "\\frac"), ("\\frac", " \\frac"), ("\\left", ""), ("\\right", ""),
    *((r"\\sqrt\{([^{}]*)\}", "sqrt($1)", "re"), (r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "$1/$2", "re")) * 3,
    (r"\\(?:text|mathrm|mathbf)\{([^{}]*)\}", "$1", "re"), ("\\pi", "pi"), ("\\infty", "inf"), ("\\cup", "U"), ("\\cdot", "*"), ("\\times", "*"), ("\\ ", " "), (r"^\s+|\s+$", "", "re"),
)
PROCESS_LAST: tuple[Step, ...] = ((r"- *", "-", "re"), (r"([0-9]) +([0-9])", "$1+$2", "re"), (" ", ""), ("{", ""), ("}", ""))
LISTED_FIRST: tuple[Step, ...] = (("\n", ""), (r"\.+$", "", "re"), ("\\!", ""))
LISTED_FRACTIONS: tuple[Step, ...] = (("tfrac", "frac"), ("dfrac", "frac"), ("cfrac", "frac"), ("\\left", ""), ("\\right", ""))
_EDGES: Step = (r"^\s+|\s+$", "", "re")
LISTED_UNITS: tuple[Step, ...] = (
    ("^{\\circ}", ""), _EDGES, ("^\\circ", ""), _EDGES, (r"\{(c|m)?m\}(\^(2|3))?", "", "re"), _EDGES, (r"p\.m\.$", "", "re"), _EDGES, (r"(\d)\s*t$", "$1", "re"), _EDGES,
    ("\\$", ""), ("$", ""), ("x\\in", ""), ("\\%", "%"), (" .", " 0."), ("{.", "{0."), ("\\cdot", ""), ("infinity", "\\infty"),
)
LISTED_THEN: tuple[Step, ...] = (("+\\inity", "\\infty"), ("\\mathbf", ""), ("\\mathrm", ""), (r"\\mbox\{.*?\}", "", "re"))
LISTED_NUMBERS: tuple[Step, ...] = ((r"(\d+)\.0+([^\d])", "$1$2", "re"), (r"(\d+)\.0+$", "$1", "re"), (r"^\.", "0.", "re"))
TANGENTS: tuple[Step, ...] = ((r"\\tan(-?[0-9.a-zA-Z]+)", r"\\tan{$1}", "re"), (r"\\tan\s+(\w+)$", r"\\tan{$1}", "re"))
LETTER_FUNCTIONS = "sqrt frac pi inf cos sin tan cot arccos arcsin arctan arccot log ln exp".split()
NOT_EVALUATED = r"\^\{|\^\(|\^[0-9]+\^|\^-?[0-9][0-9]+|\*\*[0-9]+\*\*|\*\*-?[0-9][0-9]+|[0-9][0-9][0-9]+!"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def rewritten(x: Column, steps: tuple[Step, ...]) -> Column:
    for old, new, *kind in steps:
        x = F.regexp_replace(x, old, new) if kind else F.replace(x, F.lit(old), F.lit(new))
    return x


def unwrapped(x: Column) -> Column:
    """The inside of an answer that is one \\text{...} as a whole."""
    return F.regexp_replace(x, r"^\\text\{(.+?)\}$", "$1")


def decimal(x: Column) -> Column:
    """A double from plain digits, else null; names of numbers and suffixes do not count."""
    return F.when(x.rlike(NUMBER), F.trim(x).try_cast("double"))


def _whole(v: Column) -> Column:
    return (v.isNotNull() & (F.abs(v - F.round(v)) <= 1e-7) & (F.abs(v) < 9e15)).eqNullSafe(True)


# -- competition form


def _slash(x: Column) -> Column:
    return F.regexp_replace(x, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{$1}{$2}")


def _fractions(x: Column) -> Column:
    """Braces for \\frac12 and \\frac1{72}; nothing changes if one of several has too little after it."""
    short = F.exists(F.slice(F.split(x, r"\\frac", -1), F.lit(2), F.lit(100_000)), lambda p: ~p.startswith("{") & (F.length(p) < 2))
    return F.when(short, x).otherwise(rewritten(x, FRACTIONS))


def competition_normal(x: Column) -> Column:
    """The competition form; what it cannot read stays as it is."""

    def of(raw: Column) -> Column:
        first = rewritten(raw, COMPETITION_FIRST)

        def with_first(s: Column) -> Column:
            then = rewritten(F.substring_index(s, "\\text{ ", 1), COMPETITION_THEN)
            broken = (F.size(F.split(s, r"\\text\{ ", -1)) > 2) | s.rlike(r"\\sqrt($|\\sqrt)") | F.replace(s, F.lit(" "), F.lit("")).rlike(r"\\frac($|\\frac)")
            return F.when(broken, raw).otherwise(let(then, last))

        def last(s: Column) -> Column:
            sides = F.split(s, "=", -1)
            right = F.when((F.size(sides) == 2) & (F.length(F.get(sides, F.lit(0))) <= 2), F.get(sides, F.lit(1))).otherwise(s)
            spaced = F.replace(rewritten(right, ROOTS), F.lit(" "), F.lit(""))
            return let(let(spaced, _fractions), lambda f: F.when(f == "0.5", "\\frac{1}{2}").otherwise(_slash(f)))

        return let(first, with_first)

    return let(strip(unwrapped(strip(x))), of)


# -- process-reward form


def without_number_commas(x: Column) -> Column:
    """Commas before groups of three digits go, again and again until none does."""
    once = lambda s: F.regexp_replace(s, r"([0-9])(,)([0-9][0-9][0-9])($|[^0-9])", "$1$3$4")
    rounds = F.sequence(F.lit(0), F.size(F.split(x, ",", -1)))
    return F.aggregate(rounds, x, lambda s, _: once(s))


def is_whole(x: Column) -> Column:
    return _whole(decimal(without_number_commas(x)))


def is_fraction(x: Column) -> Column:
    return x.rlike(r"^-?[0-9]+.?/0*[1-9][0-9]*.?$")


def process_normal(x: Column) -> Column:
    def numbers(s: Column) -> Column:
        v = decimal(s)
        return F.when(_whole(v), F.round(v).cast("bigint").cast("string")).otherwise(s)

    def latex(s: Column) -> Column:
        return F.when(F.instr(s, "\\") > 0, rewritten(s, LATEX_TEXT)).otherwise(s)

    def last(s: Column) -> Column:
        v = decimal(F.replace(s, F.lit(","), F.lit("")))
        return F.when(is_whole(s), F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("bigint").cast("string")).otherwise(s)

    first = rewritten(unwrapped(x), PROCESS_FIRST)
    bare = let(first, lambda s: F.regexp_replace(F.when(s.rlike(r"^\{(?s:.*)\}$"), F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s), r",\\! *", ""))
    return let(F.lower(rewritten(let(let(bare, numbers), latex), PROCESS_LAST)), last)


def tuple_parts(x: Column) -> Column:
    """The elements of a tuple or interval; any other text is one element, an empty one none."""

    def of(s: Column) -> Column:
        inside = F.transform(F.split(F.substring(s, F.lit(2), F.length(s) - 2), ",", -1), strip)
        return F.when(F.length(s) == 0, F.expr("cast(array() as array<string>)")).when(s.rlike(r"^[()\[\]][^()\[\]]+[()\[\]]$"), inside).otherwise(F.array(s))

    return let(without_number_commas(x), of)


def unknown_letters(x: Column) -> Column:
    """How many different letters are no function or constant."""
    bare = rewritten(x, tuple((name, "") for name in LETTER_FUNCTIONS))
    return F.size(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"\p{L}"), F.lit(0))))


def may_be_evaluated(x: Column) -> Column:
    return (unknown_letters(x) <= 2) & ~x.rlike(NOT_EVALUATED)


def value(x: Column) -> Column:
    """The value of a number or of a fraction of two, in any of the forms."""
    bare = F.regexp_replace(F.regexp_replace(x, r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "$1/$2"), r"[()\s]", "")
    return let(F.split(bare, "/", -1), lambda p: F.when(F.size(p) == 1, decimal(F.get(p, F.lit(0)))).when(F.size(p) == 2, F.try_divide(decimal(F.get(p, F.lit(0))), decimal(F.get(p, F.lit(1))))))


def same_value(a: Column, b: Column) -> Column:
    both = F.struct(value(a).alias("a"), value(b).alias("b"))
    return (a == b) | let(both, lambda v: (F.abs(v["a"] - v["b"]) <= 1e-12 * F.greatest(F.abs(v["a"]), F.abs(v["b"]), F.lit(1.0))).eqNullSafe(True))


def process_grade(given: Column, gold: Column) -> Column:
    """Equal in the competition form, or in the process form, or element by element: fractions and integers strictly."""

    def element(p: Column) -> Column:
        a, b = p["gold"], p["given"]
        allowed = may_be_evaluated(F.concat(F.lit("("), a, F.lit(")-("), b, F.lit(")")))
        same = F.when(same_value(a, b), True).when(allowed, same_expression(a, b)).otherwise(False)
        return F.when(is_fraction(a) & is_fraction(b), a == b).when(is_whole(a) != is_whole(b), False).otherwise(same)

    def parts(s: Column) -> Column:
        ends = lambda f: f(s["gold"]) == f(s["given"])
        framed = (F.size(s["a"]) <= 1) | (ends(lambda t: F.left(t, F.lit(1))) & ends(lambda t: F.right(t, F.lit(1))))
        pairs = F.zip_with(s["a"], s["b"], lambda a, b: F.struct(a.alias("gold"), b.alias("given")))
        return framed & (F.size(s["a"]) == F.size(s["b"])) & F.forall(pairs, element)

    def process(s: Column) -> Column:
        split = F.struct(s["gold"].alias("gold"), s["given"].alias("given"), tuple_parts(s["gold"]).alias("a"), tuple_parts(s["given"]).alias("b"))
        return F.when(s["gold"] == s["given"], True).when(F.length(s["given"]) == 0, False).otherwise(let(split, parts))

    normal = F.struct(process_normal(gold).alias("gold"), process_normal(given).alias("given"))
    competition = competition_normal(given).eqNullSafe(competition_normal(gold))
    return F.when(given.isNull(), False).when(competition, True).otherwise(F.coalesce(let(normal, process), F.lit(False)))


# -- list form


def listed_normal(x: Column) -> Column:
    def units(s: Column) -> Column:
        without = strip(F.regexp_replace(s, r"\\text\{.*?\}$", ""))
        return let(without, lambda w: F.when((w != "") & (w != s), w).otherwise(s))

    def infinite(s: Column) -> Column:
        return F.when(F.instr(s, "\\infty") > 0, s).otherwise(F.replace(s, F.lit("inf"), F.lit("\\infty")))

    def imaginary(s: Column) -> Column:
        return F.when(s.contains("j") & ~s.contains("i"), F.replace(s, F.lit("j"), F.lit("i"))).otherwise(s)

    text = lambda s: F.when(s.startswith("\\text{") & s.endswith("}"), F.substring(s, F.lit(7), F.length(s) - 7)).otherwise(s)
    out = rewritten(let(rewritten(strip(x), LISTED_FIRST), text), LISTED_FRACTIONS)
    out = let(rewritten(let(out, units), LISTED_UNITS), infinite)
    out = rewritten(let(rewritten(out, LISTED_THEN), imaginary), LISTED_NUMBERS)
    out = F.replace(rewritten(rewritten(out, ROOTS), TANGENTS), F.lit(" "), F.lit(""))
    return F.regexp_replace(_slash(let(out, _fractions)), r"(\\|,|\.)+$", "")


def boxed_answers(x: Column) -> Column:
    """What every box holds up to its brace; a box that never closes gives nothing, and a % behind the brace keeps the brace."""

    def closing(piece: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.lit(-1).alias("at"))
        deeper = lambda s, c: s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        step = lambda s, c: F.struct(deeper(s, c).alias("depth"), (s["i"] + 1).alias("i"), F.when((s["at"] < 0) & (deeper(s, c) < 0), s["i"]).otherwise(s["at"]).alias("at"))
        return F.aggregate(F.split(piece, ""), start, step, lambda s: s["at"])

    def content(piece: Column) -> Column:
        return let(closing(piece), lambda at: F.when(at >= 0, F.substring(piece, F.lit(1), at + F.when(F.substring(piece, at + 2, F.lit(1)) == "%", 1).otherwise(0))))

    pieces = F.slice(F.split(x, r"boxed\{", -1), F.lit(2), F.lit(1_000_000))
    return F.filter(F.transform(pieces, content), lambda a: a.isNotNull())


def program_output(x: Column) -> Column:
    """Between the last ```output and the next fence; empty without one."""
    return F.when(x.contains("```output"), strip(F.substring_index(F.substring_index(x, "```output", -1), "```", 1))).otherwise("")


def listed_answers(x: Column) -> Column:
    """All answers of a solution, in list form: final answer, boxes, "the answer is", program output, or the last number."""
    final = F.array(strip(F.substring_index(F.get(F.split(x, r"final answer is \$", 2), F.lit(1)), "$. I hope", 1)))
    last = F.try_element_at(F.regexp_extract_all(F.replace(x, F.lit(","), F.lit("")), F.lit(r"-?[0-9]*\.?[0-9]+"), F.lit(0)), F.lit(-1))
    said = F.array(strip(F.substring_index(x, "he answer is", -1)))
    some = lambda a: F.filter(F.array(a), lambda v: v.isNotNull() & (v != ""))
    output = let(program_output(x), lambda o: F.when(o != "", F.array(o)).otherwise(some(last)))
    found = F.when(x.contains("final answer is $") & x.contains("$. I hope"), final).when(x.contains("boxed"), boxed_answers(x)).when(x.contains("he answer is"), said).otherwise(output)
    cut = lambda a: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring_index(strip(a), "\n", 1), "^:+", ""), r"\.+$", ""), "/+$", "")
    return F.transform(found, lambda a: listed_normal(cut(a)))


def question_answers(question: Column, reasoning: Column) -> Column:
    """Answers of a solution, taken apart where the question asks for a list or the answer says "and"."""
    both = r"\\text\{\s*and\s*\}"
    one = lambda a: (
        F.when(question.contains("separated by commas") & ~a.rlike(r"[()\[\]]"), F.transform(F.split(a, ",", -1), strip)).when(a.rlike(both), F.transform(F.split(a, both, -1), strip)).otherwise(F.array(strip(a)))
    )
    return F.flatten(F.transform(listed_answers(reasoning), one))


def percentage_or_number(x: Column) -> Column:
    bare = F.replace(x, F.lit(","), F.lit(""))
    return F.coalesce(decimal(bare), F.when(bare.endswith("%"), decimal(F.regexp_replace(bare, r"\\?%$", "")) / 100))


def _near(a: Column, b: Column) -> Column:
    larger = F.greatest(F.abs(a), F.abs(b))
    return (a == b) | ((larger < float("inf")) & (F.abs(a - b) <= F.greatest(F.lit(1e-3), 1e-9 * larger)))


_PAIRS = "array<struct<p: string, r: string>>"


def _parts(s: Column) -> Column:
    """The ways to take two answers apart into pairs: as tuples, as matrices, or by one side of an equation."""
    pair = lambda x, y: F.struct(x.alias("p"), y.alias("r"))
    same_size = lambda a, b: F.size(a) == F.size(b)
    inside = lambda t: F.split(F.substring(t, F.lit(2), F.length(t) - 2), ",", -1)
    framed, matrix = r"^[(\[].+[)\]]", r"^\\begin\{[pb]matrix\}(?s:.*)\\end\{[pb]matrix\}$"
    lines = lambda t: F.transform(F.filter(F.transform(F.split(F.regexp_replace(t, r"^\\begin\{[pb]matrix\}|\\end\{[pb]matrix\}$", ""), r"\\\\", -1), strip), lambda v: v != ""), lambda v: F.split(v, "&", -1))

    def of(x: Column) -> Column:
        tuples = F.when(s["p"].rlike(framed) & s["r"].rlike(framed) & same_size(x["tp"], x["tr"]), F.zip_with(x["tp"], x["tr"], pair))
        shape = same_size(x["mp"], x["mr"]) & F.forall(F.zip_with(x["mp"], x["mr"], same_size), lambda v: v)
        matrices = F.when(s["p"].rlike(matrix) & s["r"].rlike(matrix) & shape, F.flatten(F.zip_with(x["mp"], x["mr"], lambda u, v: F.zip_with(u, v, pair))))
        short = lambda v: (F.size(v) == 2) & (F.length(F.get(v, F.lit(0))) <= 2)
        right = lambda v: F.get(v, F.lit(1))
        sides = F.when(short(x["ep"]) & (F.size(x["er"]) == 1), F.array(pair(right(x["ep"]), s["r"]))).when(short(x["er"]) & (F.size(x["ep"]) == 1), F.array(pair(s["p"], right(x["er"]))))
        return F.filter(F.array(tuples.cast(_PAIRS), matrices.cast(_PAIRS), sides.cast(_PAIRS)), lambda v: v.isNotNull())

    split = {"t": inside, "m": lines, "e": _sides}
    return let(F.struct(*[f(s[c]).alias(k + c) for k, f in split.items() for c in "pr"]), of)


def _sides(t: Column) -> Column:
    return F.transform(F.split(t, "=", -1), strip)


def _same_equation(p: Column, r: Column) -> Column:
    """Both one equation, with the same sides in either order."""

    def of(x: Column) -> Column:
        at = lambda v, k: F.get(v, F.lit(k))
        same = lambda i, j: same_value(at(x["p"], 0), at(x["r"], i)) & same_value(at(x["p"], 1), at(x["r"], j))
        return F.when((F.size(x["p"]) == 2) & (F.size(x["r"]) == 2), same(0, 1) | same(1, 0)).otherwise(False)

    return let(F.struct(_sides(p).alias("p"), _sides(r).alias("r")), of)


def listed_equal(prediction: Column, reference: Column, depth: int = 2) -> Column:
    """Same text, same number give or take a factor of 100, or equal part by part: tuples, matrices, equations."""

    def pieces(s: Column) -> Column:
        whole, symbolic = same_value(s["p"], s["r"]), same_expression(s["p"], s["r"], near=1e-3)
        if depth == 0:
            return F.when(whole, True).otherwise(symbolic)
        by_part = F.exists(_parts(s), lambda way: F.forall(way, lambda x: listed_equal(x["p"], x["r"], depth - 1)))
        return F.when(whole, True).when(_same_equation(s["p"], s["r"]), True).when(by_part, True).otherwise(symbolic)

    def of(v: Column) -> Column:
        factors = F.transform(F.array(F.lit(1.0), F.lit(0.01), F.lit(100.0)), lambda k: _near(v["r"] * k, v["p"]))
        close = F.exists(factors, lambda b: b)
        text = F.struct(strip(v["a"]).alias("p"), strip(v["b"]).alias("r"))
        return F.when(v["a"] == v["b"], True).when(v["p"].isNotNull() & v["r"].isNotNull(), close).when(F.length(v["a"]) == 0, False).otherwise(let(text, pieces))

    numbers = F.struct(prediction.alias("a"), reference.alias("b"), percentage_or_number(prediction).alias("p"), percentage_or_number(reference).alias("r"))
    return F.coalesce(let(numbers, of), F.lit(False))


def _matched(predictions: Column, answers: Column, same) -> Column:
    """Every prediction fits an answer and every answer a prediction."""
    fits = F.transform(predictions, lambda p: F.transform(answers, lambda a: same(p, a)))
    rows = lambda m: F.forall(m, lambda row: F.exists(row, lambda v: v))
    columns = lambda m: F.forall(F.transform(answers, lambda _, j: F.exists(m, lambda row: F.get(row, j))), lambda v: v)
    return let(fits, lambda m: rows(m) & columns(m))


def listed_correct(prediction: Column, answer: Column, precision: float = 1e-3) -> Column:
    """One answer against one: unions part by part, numbers within the precision, else listed_equal."""

    def single(p: Column, a: Column) -> Column:
        bare = lambda t: decimal(F.replace(t, F.lit(","), F.lit("")))
        return (F.abs(bare(p) - bare(a)) < precision).eqNullSafe(True) | ((a != "") & (p == a)) | listed_equal(p, a)

    def of(s: Column) -> Column:
        both = s["p"].contains("\\cup") & s["a"].contains("\\cup")
        parts = lambda t: F.when(both, F.split(t, r"\\cup", -1)).otherwise(F.array(t))
        return let(F.struct(parts(s["p"]).alias("p"), parts(s["a"]).alias("a")), lambda x: _matched(x["p"], x["a"], single))

    return let(F.struct(prediction.alias("p"), answer.alias("a")), of)


def listed_grade(predictions: Column, answers: Column) -> Column:
    """Lists of answers, each once; of the predictions the last as many as there are answers."""

    def of(s: Column) -> Column:
        last = F.slice(s["p"], F.greatest(F.size(s["p"]) - F.size(s["a"]) + 1, F.lit(1)), F.greatest(F.size(s["a"]), F.lit(1)))
        return _matched(F.when(F.size(s["a"]) == 0, s["p"]).otherwise(last), s["a"], listed_correct)

    return let(F.struct(F.array_distinct(predictions).alias("p"), F.array_distinct(answers).alias("a")), of)

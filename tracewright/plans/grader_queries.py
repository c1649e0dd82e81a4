"""Queries on the answer graders: normal forms against the same rewriting in DuckDB, verdicts against truth tables."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import graders as G
from ..functions import text as X
from ..functions.expressions import same_expression
from ..operators.grading import graded
from .rollouts import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Answers as models write them; %n stands for a number.
ANSWERS = (
    "%n", "\\text{%n}", " \\frac%n2 ", "\\dfrac{%n}{2}", "\\tfrac1{%n}", "%n/2", "0.5", ".%n", "x=%n", "k = %n", "\\sqrt%n", "\\sqrt{%n}", "%n\\%", "\\$%n", "%n^\\circ", "%n^{\\circ}", "%n\\text{ cm}",
    "\\left(%n,2\\right)", "%n\\!00", "1,%n00", "%n cm", "%n square feet", "%n million", "%n 1/2", "- %n", "{%n}", "%n.0", "%n.00 apples", "A and %n", "\\text{Maria} ", "\\frac{%n}{\\pi}", "2\\cdot%n",
    "x\\in[%n,\\infty)", "(-inf,%n)", "%n p.m.", "5j+%n", "\\tan%n", "\\mbox{no }%n", "\\text{(A)} %n\\text{ km}", "a\\frac%n", "%n,", "\\\\frac12+%n", "1 %n 2", "\\begin{pmatrix}%n\\\\2\\end{pmatrix}",
)


def _array(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def _filled(values: tuple[str, ...]) -> Column:
    k = F.col("o_orderkey")
    return F.replace(F.get(_array(values), (k % len(values)).cast("int")), F.lit("%n"), (k % 97).cast("string"))


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'" if "\n" not in s else "(" + " || chr(10) || ".join(_text(p) for p in s.split("\n")) + ")"


def _filled_sql(values: tuple[str, ...]) -> str:
    return f"replace([{', '.join(map(_text, values))}][CAST(o_orderkey % {len(values)} AS INTEGER) + 1], '%n', CAST(o_orderkey % 97 AS VARCHAR))"


def _steps(x: str, steps) -> str:
    for old, new, *kind in steps:
        x = f"regexp_replace({x}, {_text(old)}, {_text(new.replace(chr(92) * 2, chr(92) * 2).replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')" if kind else f"replace({x}, {_text(old)}, {_text(new)})"
    return x


_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_UNWRAP = "regexp_replace({}, '^\\\\text\\{{(.+?)\\}}$', '\\1')"
_SHORT = "len(list_filter(string_split({0}, '\\frac')[2:], lambda p: NOT starts_with(p, '{{') AND length(p) < 2)) > 0"
_SLASH = "regexp_replace({}, '^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$', '\\\\frac{{\\1}}{{\\2}}')"


@query(f"""WITH a AS (SELECT o_orderkey, {_filled_sql(ANSWERS)} AS x FROM orders), b AS (SELECT *, {_TRIM.format(_UNWRAP.format(_TRIM.format("x")))} AS raw FROM a),
c AS (SELECT *, {_steps("raw", G.COMPETITION_FIRST)} AS s FROM b),
d AS (SELECT *, {_steps("split_part(s, '\\text{ ', 1)", G.COMPETITION_THEN)} AS t, len(string_split(s, '\\text{{ ')) > 2 OR regexp_matches(s, '\\\\sqrt($|\\\\sqrt)') OR regexp_matches(replace(s, ' ', ''), '\\\\frac($|\\\\frac)') AS broken FROM c),
e AS (SELECT *, replace({_steps("CASE WHEN len(string_split(t, '=')) = 2 AND length(split_part(t, '=', 1)) <= 2 THEN split_part(t, '=', 2) ELSE t END", G.ROOTS)}, ' ', '') AS u FROM d),
f AS (SELECT *, CASE WHEN {_SHORT.format("u")} THEN u ELSE {_steps("u", G.FRACTIONS)} END AS v FROM e)
SELECT o_orderkey, CASE WHEN broken THEN raw WHEN v = '0.5' THEN '\\frac{{1}}{{2}}' ELSE {_SLASH.format("v")} END AS normal FROM f""")
def t25_competition_normal(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", G.competition_normal(_filled(ANSWERS)).alias("normal"))


_NUMBER = G.NUMBER.replace("'", "''")
_COMMAS = "regexp_replace(regexp_replace(regexp_replace({}, '([0-9])(,)([0-9][0-9][0-9])($|[^0-9])', '\\1\\3\\4', 'g'), '([0-9])(,)([0-9][0-9][0-9])($|[^0-9])', '\\1\\3\\4', 'g'), '([0-9])(,)([0-9][0-9][0-9])($|[^0-9])', '\\1\\3\\4', 'g')"


def _decimal_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{_NUMBER}') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


@query(f"""WITH a AS (SELECT o_orderkey, {_filled_sql(ANSWERS)} AS x FROM orders), b AS (SELECT *, {_steps(_UNWRAP.format("x"), G.PROCESS_FIRST)} AS s FROM a),
c AS (SELECT *, regexp_replace(CASE WHEN starts_with(s, '{{') AND ends_with(s, '}}') AND length(s) > 1 THEN s[2:-2] ELSE s END, ',\\\\! *', '', 'g') AS t FROM b),
d AS (SELECT *, {_decimal_sql("t")} AS n FROM c), e AS (SELECT *, CASE WHEN abs(n - round(n)) <= 1e-7 THEN CAST(CAST(round(n) AS BIGINT) AS VARCHAR) ELSE t END AS u FROM d),
f AS (SELECT *, lower({_steps(f"CASE WHEN contains(u, chr(92)) THEN {_steps('u', G.LATEX_TEXT)} ELSE u END", G.PROCESS_LAST)}) AS v FROM e),
g AS (SELECT *, {_decimal_sql(_COMMAS.format("v"))} AS w FROM f)
SELECT o_orderkey, CASE WHEN abs(w - round(w)) <= 1e-7 THEN CAST(CAST(trunc(TRY_CAST(replace(v, ',', '') AS DOUBLE)) AS BIGINT) AS VARCHAR) ELSE v END AS normal FROM g""")
def t22_process_normal(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", G.process_normal(_filled(ANSWERS)).alias("normal"))


@query(f"""WITH a AS (SELECT o_orderkey, {_steps(_TRIM.format(_filled_sql(ANSWERS)), G.LISTED_FIRST)} AS s FROM orders),
b AS (SELECT *, {_steps("CASE WHEN starts_with(s, '\\text{') AND ends_with(s, '}') THEN s[7:-2] ELSE s END", G.LISTED_FRACTIONS)} AS t FROM a),
c AS (SELECT *, {_TRIM.format("regexp_replace(t, '\\\\text\\{.*?\\}$', '')")} AS w FROM b), d AS (SELECT *, {_steps("CASE WHEN w <> '' AND w <> t THEN w ELSE t END", G.LISTED_UNITS)} AS u FROM c),
e AS (SELECT *, {_steps("CASE WHEN contains(u, '\\infty') THEN u ELSE replace(u, 'inf', '\\infty') END", G.LISTED_THEN)} AS v FROM d),
f AS (SELECT *, {_steps("CASE WHEN contains(v, 'j') AND NOT contains(v, 'i') THEN replace(v, 'j', 'i') ELSE v END", G.LISTED_NUMBERS)} AS y FROM e),
g AS (SELECT *, replace({_steps(_steps("y", G.ROOTS), G.TANGENTS)}, ' ', '') AS z FROM f), h AS (SELECT *, CASE WHEN {_SHORT.format("z")} THEN z ELSE {_steps("z", G.FRACTIONS)} END AS q FROM g)
SELECT o_orderkey, regexp_replace({_SLASH.format("q")}, '(\\\\|,|\\.)+$', '') AS normal FROM h""")
def t26_listed_normal(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", G.listed_normal(_filled(ANSWERS)).alias("normal"))


#: Solution, answers in list form.
SOLUTIONS = (
    ("so \\boxed{%n} and \\boxed{\\frac12}", "%n|\\frac{1}{2}"), ("\\boxed{a{b}c} then \\boxed{never closed", "a{b}c"), ("The final answer is $%n$. I hope it is correct.", "%n"), ("The answer is: %n.\nBye", "%n"),
    ("```output\n%n\n```\n", "%n"), ("we get 3, then 1,%n05", "1%n05"), ("nothing at all", ""), ("\\boxed{3,%n}", "3|%n"), ("\\boxed{2\\text{ and }%n}", "2\\text{and}%n"), ("\\boxed{(1,%n)}", "(1,%n)"),
)


@query(f"SELECT o_orderkey, {_filled_sql(tuple(w for _, w in SOLUTIONS))} AS answers FROM orders")
def t26_listed_answers(spark, sf_dir):
    asked = F.lit("Give all values, separated by commas.")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(G.question_answers(asked, _filled(tuple(s for s, _ in SOLUTIONS))), "|").alias("answers"))


#: Text, is it whole, is it a fraction, its parts, its unknown letters, may it be evaluated.
PROBES = (
    ("%n", True, False, "%n", 0, True), ("1,000", True, False, "1000", 0, True), ("1,00", False, False, "1,00", 0, True), ("%n/7", False, True, "%n/7", 0, True), ("(1,%n]", False, False, "1;%n", 0, True),
    ("[a, b)", False, False, "a;b", 2, True), ("((1,2),3)", False, False, "((1,2),3)", 0, True), ("x+y+z", False, False, "x+y+z", 3, False), ("sqrt(%n)+x", False, False, "sqrt(%n)+x", 1, True), ("2^{10}", False, False, "2^{10}", 0, False),
    ("x^12", False, False, "x^12", 1, False), ("%n.5", False, False, "%n.5", 0, True), ("12,345,678", True, False, "12345678", 0, True), ("3/0", False, False, "3/0", 0, True), ("-3/14", False, True, "-3/14", 0, True),
)


@query(f"""SELECT o_orderkey, [{", ".join(str(p[1]) for p in PROBES)}][k] AS whole, [{", ".join(str(p[2]) for p in PROBES)}][k] AS fraction, {_filled_sql(tuple(p[3] for p in PROBES))} AS parts,
  CAST([{", ".join(str(p[4]) for p in PROBES)}][k] AS INTEGER) AS letters, [{", ".join(str(p[5]) for p in PROBES)}][k] AS evaluated FROM (SELECT o_orderkey, CAST(o_orderkey % {len(PROBES)} AS INTEGER) + 1 AS k FROM orders)""")
def t23_t24_answer_helpers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", _filled(tuple(p[0] for p in PROBES)).alias("x"))
    x = F.col("x")
    return o.select(
        "o_orderkey", G.is_whole(x).alias("whole"), G.is_fraction(x).alias("fraction"), F.array_join(G.tuple_parts(x), ";").alias("parts"), G.unknown_letters(x).alias("letters"), G.may_be_evaluated(x).alias("evaluated")
    )


#: Given, gold, verdict of the process-reward grade.
PROCESS = (
    ("%n", "%n", True), ("\\frac{%n}{2}", "%n/2", True), ("%n.0", "%n", True), ("1,500", "1500", True), ("2/4", "1/2", False), ("0.5", "\\frac12", True), ("(1,%n)", "(1, %n)", True), ("(1,%n)", "[1,%n)", False),
    ("%n cm", "%n", True), ("%n1", "%n", False), ("0.50", "1/2", True), ("", "%n", False), ("(1/2,3)", "(2/4,3)", False), ("x=%n", "%n", True), ("\\text{Yes}", "yes", True), ("1.0,2", "1,2", False), ("7 1/2", "7+1/2", True),
    ("x(x+1)", "x^2+x", True), ("\\sqrt{8}", "2\\sqrt{2}", True), ("%n x+1", "1+%n x", True), ("x^2-1", "(x-1)(x+2)", False), ("x+y+z", "z+y+x", False), ("(2x+x,%n)", "(3x,%n)", True), ("(x(x-1),%n)", "(x^2-x,%n)", False),
)


def _verdicts(rows) -> str:
    return f"SELECT o_orderkey, [{', '.join(str(r[2]) for r in rows)}][CAST(o_orderkey % {len(rows)} AS INTEGER) + 1] AS verdict FROM orders"


@query(_verdicts(PROCESS))
def t21_process_grade(spark, sf_dir):
    given, gold = (_filled(tuple(r[k] for r in PROCESS)) for k in (0, 1))
    return graded(table(spark, sf_dir, "orders").select("o_orderkey", given.alias("given"), gold.alias("gold")), "given", "gold", G.process_grade).select("o_orderkey", "verdict")


#: Prediction, reference, verdict of the list grade; a bar parts several answers.
LISTED = (
    ("%n", "%n", True), ("50%", "0.5", True), ("1%n000", "%n", False), ("(1,%n)", "(1.0, %n)", True), ("\\begin{pmatrix}1&%n\\\\3&4\\end{pmatrix}", "\\begin{bmatrix}1.0&%n\\\\3&4.0\\end{bmatrix}", True),
    ("x=%n", "%n", True), ("%n", "y = %n", True), ("y=2", "2=y", True), ("1|2", "2|1", True), ("1|2|3", "2|3", True), ("1|2", "1|3", False), ("[0,1]\\cup[2,%n]", "[2,%n]\\cup[0,1]", True), ("1/4", "0.25", True), ("abc", "abd", False),
    ("2|2|5", "5|2|5", True), ("3.0004", "3", True), ("(1,2,3)", "(1,2)", False), ("12%", "12", True),
    ("\\frac{x^2-1}{x-1}", "x+1", True), ("\\sqrt{8}", "2\\sqrt{2}", True), ("\\frac{\\pi}{4}", "0.7853", True), ("\\frac{\\pi}{4}", "0.79", False), ("x+y+z", "z+y+x", True), ("(x(x-1),%n)", "(x^2-x,%n)", True), ("y=2x", "2x=y", True),
    ("\\sin^2 x+\\cos^2 x", "1", True), ("x^2", "x^3", False),
)


@query(_verdicts(LISTED))
def t27_listed_grade(spark, sf_dir):
    p, a = (F.split(_filled(tuple(r[k] for r in LISTED)), r"\|") for k in (0, 1))
    return graded(table(spark, sf_dir, "orders").select("o_orderkey", p.alias("given"), a.alias("gold")), "given", "gold", G.listed_grade).select("o_orderkey", "verdict")


#: Two sides of one expression with numbers a, b and e (0 or 1), and both in DuckDB as functions of x: they are the same where e is 0, and where e makes no difference.
EXPRESSIONS = (
    ("(x+{a})(x-{b})", "x^2+{a-b+e}x-{a*b}", "(x+a)*(x-b)", "x*x+(a-b+e)*x-a*b"), ("\\frac{x^2-{a*a}}{x-{a}}", "x+{a+e}", "(x*x-a*a)/(x-a)", "x+a+e"),
    ("\\sqrt{{a*a*b}}", "{a}\\sqrt{{b+e}}", "sqrt(a*a*b)", "a*sqrt(b+e)"), ("({a}/{b})x", "{a*2+e}x/{b*2}", "a/b*x", "(a*2+e)*x/(b*2)"),
    ("\\sin(x+{a})^2+\\cos^2(x+{a})", "{e+1}", "sin(x+a)**2+cos(x+a)**2", "e+1"), ("{a}.25x", "{a*4+1+e}x/4", "(a+0.25)*x", "(a*4+1+e)*x/4"),
    ("(x+{b})^3-(x-{b})^3", "{b*6}x^2+{b*b*b*2+e}", "(x+b)**3-(x-b)**3", "b*6*x*x+b*b*b*2+e"), ("\\ln(2^{{a}})/\\ln(2)", "{a}+0\\cdot x+{e}", "ln(2**a)/ln(2)", "a+e"),
    ("\\frac{1}{\\frac{1}{x}+\\frac{{a}}{{b}}}", "\\frac{{b}x}{{b}+{a+e}x}", "1/(1/x+a/b)", "b*x/(b+(a+e)*x)"), ("-x^2-{a}", "-(x^2+{a+e})", "-(x*x)-a", "-(x*x+a+e)"),
    ("2^{x+{e}}", "2\\cdot2^x", "2**(x+e)", "2*2**x"), ("{a}!", "{a}({a+e}-1)!", "gamma(a+1.0)", "a*gamma(a+e+0.0)"),
)


def _side(text: str) -> Column:
    """A side with its numbers filled in."""
    pieces = re.split(r"\{([abe*+0-9-]*[abe][abe*+0-9-]*)\}", text)
    return F.concat(*[F.expr(f"CAST({p} AS STRING)") if k % 2 else F.lit(p) for k, p in enumerate(pieces)])


def _picked(sides: list[Column]) -> Column:
    out = F.when(F.col("t") == 0, sides[0])
    for k, side in enumerate(sides[1:], 1):
        out = out.when(F.col("t") == k, side)
    return out


def _at(form: str, x: str) -> str:
    return re.sub(r"\bx\b", x, form)


def _agreed(f: str, g: str) -> str:
    return " AND ".join(f"abs(({_at(f, x)}) - ({_at(g, x)})) <= 1e-9 * greatest(1, abs({_at(f, x)}))" for x in ("0.37e0", "1.93e0"))


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey % {len(EXPRESSIONS)} AS t, CAST(1 + o_orderkey % 9 AS DOUBLE) AS a, CAST(1 + o_custkey % 7 AS DOUBLE) AS b, CAST(CASE WHEN (o_orderkey + o_custkey) % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS e FROM orders)
SELECT o_orderkey, CASE {" ".join(f"WHEN t = {k} THEN {_agreed(f, g)}" for k, (_, _, f, g) in enumerate(EXPRESSIONS))} END AS verdict FROM o""")
def t21_t27_same_expressions(spark, sf_dir):
    """Pairs of expressions graded once each."""
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"o_orderkey % {len(EXPRESSIONS)} AS t", "1 + o_orderkey % 9 AS a", "1 + o_custkey % 7 AS b", "CASE WHEN (o_orderkey + o_custkey) % 3 = 0 THEN 1 ELSE 0 END AS e"
    )
    sides = (_picked([_side(r[k]) for r in EXPRESSIONS]).alias(n) for k, n in enumerate(("given", "gold")))
    return graded(o.select("o_orderkey", *sides), "given", "gold", same_expression).select("o_orderkey", "verdict")


#: Text, its number, its LaTeX normal form, its right side.
NUMERIC = (
    ("%n", "%n", "%n", "%n"), (" 1,000 ", "1000", "1,000", " 1,000 "), ("%n/4", "%n/4", "%n/4", "%n/4"), ("50%", "1/2", "50%", "50%"), ("\\dfrac{%n}{2}", None, "\\frac{%n}{2}", "\\dfrac{%n}{2}"), ("x = %n", None, "x=%n", "%n"),
    ("\\left( %n \\right)", None, "(%n)", "\\left( %n \\right)"), ("\\sqrt3 \\cdot %n", None, "\\sqrt{3}*%n", "\\sqrt3 \\cdot %n"), ("a long left side = %n", None, "alongleftside=%n", "a long left side = %n"), ("\\text{km} %n", None, "km%n", "\\text{km} %n"),
    ("1/0", None, "1/0", "1/0"), ("a=b=%n", None, "a=b=%n", "a=b=%n"),
)


def _number_sql(values) -> str:
    parts = ", ".join("NULL" if v is None else v.replace("%n", "q").replace("/", "::DOUBLE / ") if "%" not in v else v.replace("%n", "q") for v in values)
    return f"[{parts}][CAST(o_orderkey % {len(values)} AS INTEGER) + 1]"


@query(f"""SELECT o_orderkey, round({_number_sql([r[1] for r in NUMERIC])}, 6) AS number, {_filled_sql(tuple(r[2] for r in NUMERIC))} AS normal, {_filled_sql(tuple(r[3] for r in NUMERIC))} AS right_side
FROM (SELECT o_orderkey, CAST(o_orderkey % 97 AS DOUBLE) AS q FROM orders)""")
def t5_t6_t7_numbers_and_normal_forms(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", _filled(tuple(r[0] for r in NUMERIC)).alias("x"))
    x = F.col("x")
    return o.select("o_orderkey", F.round(X.number(x), 6).alias("number"), X.latex_normal(x).alias("normal"), X.right_side(x).alias("right_side"))

"""Text functions on columns: answer extraction, normal forms and grading, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's str.strip() removes all white space, Spark's trim() only spaces.
_EDGES = r"^\s+|\s+$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, _EDGES, "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def boxed(x: Column) -> Column:
    """What the last ``\\boxed{`` holds up to its matching brace (or the end), stripped; null without one."""
    tail = F.substring_index(x, "\\boxed{", -1)
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("i"), F.lit(-1).alias("at"))

    def step(s: Column, p: Column) -> Column:
        """p is what stands before a closing brace: a step a brace, not a character."""
        end = s["i"] + F.length(p)
        deeper = s["depth"] + F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit(""))) - 1
        return F.struct(deeper.alias("depth"), (end + 1).alias("i"), F.when((s["at"] < 0) & (deeper == 0), end).otherwise(s["at"]).alias("at"))

    closed = lambda t: F.aggregate(F.split(t, r"\}", -1), start, step, lambda s: s["at"])
    scan = lambda t: let(closed(t), lambda at: F.when(at >= 0, F.substr(t, F.lit(1), at)).otherwise(t))
    return F.when(F.instr(x, "\\boxed{") > 0, strip(let(tail, scan)))


def boxed_by_pattern(x: Column) -> Column:
    """The last ``\\boxed{...}`` with at most one level of braces inside."""
    found = F.regexp_extract_all(x, F.lit(r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def last_number(x: Column) -> Column:
    found = F.try_element_at(F.regexp_extract_all(x, F.lit(r"-?[\d,]+\.?\d*"), F.lit(0)), F.lit(-1))
    return F.replace(found, F.lit(","), F.lit(""))


def after_marker(x: Column, marker: str = "####") -> Column:
    return F.when(F.instr(x, marker) > 0, strip(F.substring_index(x, marker, -1)))


def number(x: Column) -> Column:
    """A double from 1,000 or a/b or 50%; null if it is no number."""
    s = F.regexp_replace(strip(x), "[, ]", "")
    parts = F.split(s, "/")
    fraction = F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))
    percent = F.regexp_replace(s, "%$", "").try_cast("double") / 100
    return F.when(s.contains("/"), F.when(F.size(parts) == 2, fraction)).when(s.endswith("%"), percent).otherwise(s.try_cast("double"))


# What the normal form of a LaTeX answer rewrites or drops, in this order.
LATEX_FIRST = (
    ("\\$", ""), ("$", ""), ("\\dfrac", "\\frac"), ("\\tfrac", "\\frac"), ("\\cfrac", "\\frac"),
    ("\\left", ""), ("\\right", ""), ("\\big", ""), ("\\Big", ""), ("\\bigg", ""), ("\\Bigg", ""), ("\\bigl", ""), ("\\bigr", ""), ("\\Bigl", ""), ("\\Bigr", ""),
)
LATEX_THEN = (
    ("\\%", "%"), ("\\,", ""), ("\\;", ""), ("\\:", ""), ("\\!", ""), ("\\quad", ""), ("\\qquad", ""), ("\\ ", ""), ("\\cdot", "*"), ("×", "*"), ("·", "*"),
)


def _rewritten(x: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def latex_normal(x: Column) -> Column:
    out = _rewritten(strip(x), LATEX_FIRST)
    out = F.regexp_replace(out, r"\\(?:text|mathrm|textbf|textit|operatorname)\s*\{([^}]*)\}", "$1")
    out = F.regexp_replace(_rewritten(out, LATEX_THEN), r"\\sqrt(?!\{)(\w)", r"\\sqrt{$1}")
    return F.regexp_replace(out, r"\s+", "")


def right_side(x: Column) -> Column:
    """What follows the only '=' if at most ten characters precede it, else x."""
    parts = F.split(x, "=")
    return F.when((F.size(parts) == 2) & (F.length(strip(F.get(parts, F.lit(0)))) <= 10), strip(F.get(parts, F.lit(1)))).otherwise(x)


def close(a: Column, b: Column, tolerance: float = 1e-5) -> Column:
    """Relative to b, absolute where b is tiny."""
    return F.when(F.abs(b) < tolerance, F.abs(a - b) < tolerance).otherwise(F.abs(a - b) / F.abs(b) < tolerance)


def equivalent(a: Column, b: Column) -> Column:
    """Equal as normal text, else as numbers (which decides), else as sorted comma lists, else by right sides."""
    listed = lambda s: F.array_join(F.sort_array(F.transform(F.split(F.regexp_replace(s, r"^[(\[]|[)\]]$", ""), ","), lambda e: strip(e))), ",")

    def with_numbers(s: Column) -> Column:
        lists = s["x"].contains(",") & s["y"].contains(",") & (listed(s["x"]) == listed(s["y"]))
        sides = let(
            F.struct(right_side(s["x"]).alias("x"), right_side(s["y"]).alias("y")),
            lambda r: ((r["x"] != s["x"]) | (r["y"] != s["y"])) & ((r["x"] == r["y"]) | F.coalesce(close(number(r["x"]), number(r["y"])), F.lit(False))),
        )
        return F.when(s["p"].isNotNull() & s["q"].isNotNull(), close(s["p"], s["q"])).otherwise(lists | sides)

    def of(s: Column) -> Column:
        numbers = F.struct(s["x"].alias("x"), s["y"].alias("y"), number(s["x"]).alias("p"), number(s["y"]).alias("q"))
        return F.when(s["x"] == s["y"], True).otherwise(let(numbers, with_numbers))

    return F.coalesce(let(F.struct(latex_normal(a).alias("x"), latex_normal(b).alias("y")), of), F.lit(False))


def score_gsm8k(solution: Column, gold: Column) -> Column:
    """1 if right; 0.1 if wrong but boxed; else 0."""

    def of(box: Column) -> Column:
        answer = F.coalesce(box, after_marker(solution), last_number(solution))
        return F.when(equivalent(answer, gold), 1.0).when(box.isNotNull(), 0.1).otherwise(0.0)

    return let(boxed(solution), of)


def score_math(solution: Column, gold: Column, gold_may_be_boxed: bool = True) -> Column:
    answer = F.coalesce(boxed(solution), last_number(solution))
    target = F.coalesce(boxed(gold), gold) if gold_may_be_boxed else gold
    return F.when(equivalent(answer, target), 1.0).otherwise(0.0)


#: Sources by name: the first key contained in the source's normal name decides; others grade as math.
GRADERS = {"gsm8k": "gsm8k", "competition": "competition", "olympiad": "math", "math": "math"}


def score(data_source: Column, solution: Column, gold: Column) -> Column:
    """The score by the rule of the data source."""

    def of(name: Column) -> Column:
        kinds = {"gsm8k": score_gsm8k(solution, gold), "math": score_math(solution, gold), "competition": score_math(solution, gold, False)}
        kind = F.lit(None).cast("string")
        for key in reversed(GRADERS):
            kind = F.when(name.contains(key), F.lit(GRADERS[key])).otherwise(kind)
        return let(kind, lambda k: F.when(k == "gsm8k", kinds["gsm8k"]).when(k == "competition", kinds["competition"]).otherwise(kinds["math"]))

    return let(F.translate(F.lower(data_source), "- ", "__"), of)


def question_id(x: Column) -> Column:
    return F.substring(F.sha2(strip(x), 256), 1, 16)


def judge_score(raw: Column) -> Column:
    """Score of a judge's reply: JSON, then a pattern, then the first number in [0, 1], else 0.5."""
    said = strip(F.regexp_replace(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))
    as_json = F.get_json_object(said, "$.score").try_cast("double")
    by_pattern = F.regexp_extract(said, r"\"?score\"?\s*[:=]\s*([0-9]*\.?[0-9]+)", 1).try_cast("double")
    numbers = F.transform(F.regexp_extract_all(said, F.lit(r"[0-9]*\.?[0-9]+"), F.lit(0)), lambda s: s.try_cast("double"))
    first = F.get(F.filter(numbers, lambda v: (v >= 0) & (v <= 1)), F.lit(0))
    clip = lambda v: F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    return F.coalesce(clip(as_json), clip(by_pattern), first, F.lit(0.5))


def gsm8k_answer(x: Column) -> Column:
    """After the last ####, else the last number, commas dropped."""
    return F.coalesce(after_marker(x), last_number(F.replace(x, F.lit(","), F.lit(""))))


def gsm8k_equal(given: Column, gold: Column) -> Column:
    return F.coalesce(F.lower(F.replace(strip(given), F.lit(","), F.lit(""))) == F.lower(strip(gold)), F.lit(False))


def without_calculations(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)<<.*?>>", "")


def answer_after_heading(x: Column, heading: str = "# Answer\n") -> Column:
    """The text after the heading if it occurs exactly once."""
    parts = F.split(x, heading)
    return F.when(F.size(parts) == 2, strip(F.get(parts, F.lit(1))))


def conclusion_penalty(x: Column, penalty: float = -2.0) -> Column:
    """The penalty for a response with several conclusions, else 0."""
    return F.when((F.size(F.split(x, "####")) > 2) | (F.size(F.split(x, "###")) > 2), penalty).otherwise(0.0)


def thinking_wrapped(reasoning: Column, content: Column) -> Column:
    has = lambda x: F.coalesce(F.length(x) > 0, F.lit(False))
    return F.when(has(reasoning) & has(content), F.concat(F.lit("<think>"), reasoning, F.lit("</think>"), content)).when(has(reasoning), reasoning).otherwise(content)


def preview(x: Column, width: int = 120) -> Column:
    flat = F.replace(x, F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > width, F.concat(F.left(flat, F.lit(width)), F.lit("..."))).otherwise(flat)


def steps(solution: Column, delimiter: str = "\n") -> Column:
    """Steps of a solution: blank leading steps join the next one; concatenated they give the solution."""
    parts = F.split(solution, delimiter)
    n = F.size(parts)
    whole = F.transform(parts, lambda p, i: F.when(i < n - 1, F.concat(p, F.lit(delimiter))).otherwise(p))
    none = F.expr("cast(array() as array<string>)")
    blank = lambda x: F.length(strip(x)) == 0
    return F.aggregate(
        whole,
        none,
        lambda out, p: F.when(F.size(out) == 0, F.array(p))
        .when(blank(F.element_at(out, -1)) | (blank(p) & (F.size(out) > 0)), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(F.element_at(out, -1), p))))
        .otherwise(F.concat(out, F.array(p))),
    )


def prompt(system: str, user: Column) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", user))


def first_user_message(messages: Column) -> Column:
    return F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"]


def plain_normal(x: Column) -> Column:
    """The short normal form of generated solutions: no spaces, one spelling of fractions, lower case."""
    out = F.replace(strip(x), F.lit(" "), F.lit(""))
    for old, new in (("\\frac", "frac"), ("\\dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("\\,", "")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.lower(out)


def solution_is_correct(solution: Column, gold: Column) -> Column:
    return F.coalesce(plain_normal(boxed_by_pattern(solution)) == plain_normal(gold), F.lit(False))


def only_choice(x: Column, choices: str = "ABCD") -> Column:
    """The one letter of choices that occurs in x, else "no-answer"."""
    there = F.filter(F.array(*[F.lit(c) for c in choices]), lambda c: F.instr(x, c) > 0)
    return F.when(F.size(there) == 1, F.get(there, F.lit(0))).otherwise("no-answer")


def after_prefix(x: Column, prefix: str, finish_reason: Column, end_of_turn: str = "") -> Column:
    """What follows the first prefix, with the end-of-turn token unless the text was cut off; null without the prefix."""
    rest = F.substring(x, F.instr(x, prefix) + len(prefix), F.length(x))
    return F.when(F.instr(x, prefix) > 0, F.when(finish_reason != "length", F.concat(rest, F.lit(end_of_turn))).otherwise(rest))


def sentence_spans(tokens: Column, boundary: Column) -> Column:
    """Spans (start, end) of decoded tokens that end at a blank line or after . ? !, at least two tokens each;
    a span that crosses the boundary is cut there."""
    ends = lambda t: t.rlike(r"[.?!]\s*$")
    visible = lambda t: t.rlike(r"\S")
    spans = "array<struct<start: int, end: int>>"
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(False).alias("mark"), F.expr(f"cast(array() as {spans})").alias("out"))

    def step(s: Column, t: Column) -> Column:
        mark = F.when(visible(t), ends(t)).otherwise(s["mark"])
        close = (t.contains("\n\n") | mark) & (s["i"] > s["start"])
        span = F.array(F.struct(s["start"].alias("start"), (s["i"] + 1).alias("end")))
        return F.struct(
            (s["i"] + 1).alias("i"), F.when(close, s["i"] + 1).otherwise(s["start"]).alias("start"), (mark & ~close).alias("mark"), F.when(close, F.concat(s["out"], span)).otherwise(s["out"]).alias("out")
        )

    rest = lambda s: F.when(s["start"] < s["i"], F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["i"].alias("end"))))).otherwise(s["out"])
    cut = lambda x: F.when(
        (x["start"] < boundary) & (boundary < x["end"]),
        F.array(F.struct(x["start"].alias("start"), boundary.alias("end")), F.struct(boundary.alias("start"), x["end"].alias("end"))),
    ).otherwise(F.array(x))
    return F.flatten(F.transform(F.aggregate(tokens, zero, step, rest), cut))


def levels(x: Column) -> Column:
    """The values of a comma list, trimmed and in lower case; null for a list without text."""
    return F.when(F.length(x) > 0, F.array_distinct(F.filter(F.transform(F.split(x, ","), lambda v: F.lower(strip(v))), lambda v: v != "")))


def solution_text(reasoning: Column, content: Column, include_reasoning: bool = True) -> Column:
    """The content, after the reasoning in think tags on lines of their own if that is wanted and there."""
    if not include_reasoning:
        return F.coalesce(content, F.lit(""))
    wrapped = F.concat(F.lit("<think>\n"), reasoning, F.lit("\n</think>\n\n"), F.coalesce(content, F.lit("")))
    return F.when(F.length(reasoning) > 0, wrapped).otherwise(F.coalesce(content, F.lit("")))


def judge_prompt(system: str, question: Column, golden: Column, phases: Column, k: Column) -> Column:
    """Messages that ask a judge for phase k (from 0) of phases, with the phases before it as context."""
    before = F.transform(F.slice(phases, F.lit(1), k), lambda p, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), p))
    none = F.expr("cast(array() as array<string>)")
    context = F.when(k > 0, F.concat(F.array(F.lit("**Previous reasoning steps (from the response being evaluated):**")), before, F.array(F.lit("")))).otherwise(none)
    task = F.concat(
        F.lit("**Step "), (k + 1).cast("string"), F.lit(" of "), F.size(phases).cast("string"), F.lit(" to evaluate:**\n"), F.get(phases, k),
        F.lit("\n\nEvaluate this reasoning step. Consider whether it aligns with the correct answer above. Output JSON: {\"score\": <0.0-1.0>, \"reason\": \"...\"}"),
    )
    answer = F.when(F.length(golden) > 0, F.array(F.concat(F.lit("**Correct Answer:** "), golden, F.lit("\n")))).otherwise(none)
    return prompt(system, F.array_join(F.concat(F.array(F.concat(F.lit("**Math Problem:**\n"), question, F.lit("\n"))), answer, context, F.array(task)), "\n"))


def hinted_prompt(system: str, question: Column, answer: Column, task: str = "Write a detailed step-by-step solution that arrives at this answer.") -> Column:
    """Messages that give the answer and ask for a solution; without one use prompt()."""
    return prompt(system, F.concat(F.lit("**Problem:** "), question, F.lit("\n\n**Correct Answer:** "), answer, F.lit("\n\n" + task)))


def adapted_messages(messages: Column, supports_system: bool, developer_role: bool = False) -> Column:
    """Messages for a provider: system messages as they are, as developer messages, or at the head of the first user message."""
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    if supports_system:
        return messages
    if developer_role:
        return F.transform(messages, lambda m: message(F.when(m["role"] == "system", "developer").otherwise(m["role"]), m["content"]))

    def merged(s: Column) -> Column:
        first = F.get(F.filter(F.transform(s["rest"], lambda m, i: F.when(m["role"] == "user", i)), lambda i: i.isNotNull()), F.lit(0))
        head = F.concat(F.array_join(s["system"], "\n"), F.lit("\n\n"))
        with_head = F.transform(s["rest"], lambda m, i: message(m["role"], F.when((i == first) & (F.size(s["system"]) > 0), F.concat(head, m["content"])).otherwise(m["content"])))
        return with_head

    system = F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"])
    return let(F.struct(system.alias("system"), F.filter(messages, lambda m: m["role"] != "system").alias("rest")), merged)


def reply(response: Column) -> Column:
    """(content, reasoning) of the first choice of a chat completion in JSON."""
    of = lambda name: F.get_json_object(response, f"$.choices[0].message.{name}")
    return F.struct(F.coalesce(of("content"), F.lit("")).alias("content"), of("reasoning_content").alias("reasoning"))

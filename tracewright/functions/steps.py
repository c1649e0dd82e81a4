"""Solutions as steps: a text cut into pieces that give it back when joined, formulas kept whole where they can be.

A text is first a row of units, each a formula (anything between LaTeX delimiters) or the
plain text between two formulas, by one pattern from left to right; an opening that
nothing closes is plain text. Cuts are flags on parts of units, pieces are folds over
flagged parts, so texts are never rewritten:

1. a cut after a full stop before an upper-case letter (not after initials), and before
   each line break, outside formulas; a piece below SHORT characters without a full stop
   takes the next one along, a formula counting as FORMULA characters;
2. a cut after a formula that ends a sentence inside its delimiters; pieces below SHORT
   characters that do not end so take the next along, the last joins its predecessor;
3. a cut before each line break inside formulas; a lone opening delimiter and pieces
   below three characters move on alike;
4. pieces over LONG characters are halved as near to their middle as signs allow, outside
   formulas first, then inside, again and again until no sign will do.

Null gives null, an empty text no pieces.

A text without a sign that can open a formula takes a shorter way to the same pieces: folds over
plain strings, no third step, and one-character signs found from the middle outwards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

SHORT, LONG, FORMULA = 20, 100, 60

# Delimiters of formulas, sentence ends inside them, and signs to halve at with the least length of a half.
_FORMULAS = (
    r"\[asy\].*?\[/asy\]", r"\$\\begin\{tabular\}.*?\\end\{tabular\}\$", r"\\begin\{tabular\}.*?\\end\{tabular\}", r"\\\(.*?\\\)", r"\\\[.*?\\\]", r"\$\$.*?\$\$",
    r"(?<!\\)\$.*?[^\\]\$(?!\$)", r"\\begin\{([^}]*)\}.*?\\end\{\1\}",
)
_SENTENCE_END = r"(?=\s)(?<=\.)(?<!(?:^|[^\p{L}\p{N}_])[A-Za-z]\.)(?<!\s[A-Za-z][A-Za-z]\.)(?=\s+[A-Z])"
_CLOSING = r"(?s)^.*\.(?:\$\$?|\\\)|\\\])$"
_OPENING = r"^\s*(?:\$|\$\$|\\\(|\\\[|\\begin\{[^}]*\}|\[asy\])\s*$"
# A sign is text that a half ends with; a pattern beside it says more closely where.
_IN_LANGUAGE = ((",", None), ("and", r"(?<=\sand)(?=\s)"), (":", None), ("to", r"(?<=\sto)(?=\s)"))
_IN_FORMULAS = ((",$", r"(?<=,\$)"), (",\\)", r"(?<=,\\\))"), (",\\]", r"(?<=,\\\])"), ("=", None), ("\\equiv", r"(?<=\\equiv)"), ("+", None), ("\\cancelto", r"(?<=\\cancelto)"))
LEAST_IN_LANGUAGE, LEAST_IN_FORMULAS = 40, 20

# A formula, or plain text: what cannot open a formula, else one character. Such cuts lie at no sign that a later pattern looks across.
_UNIT = rf"(?s)(?:{'|'.join(_FORMULAS)})|[^\\$\[]+|."
_STRINGS = "cast(array() as array<string>)"


def units(x: Column) -> Column:
    """Formulas and the plain text between them: an array of (text, formula), that joined gives x."""
    found = F.regexp_extract_all(x, F.lit(_UNIT), F.lit(0))
    return F.transform(found, lambda u: F.struct(u.alias("text"), (u.rlike(r"^[\\$\[]") & (F.length(u) > 1)).alias("formula")))


def _after(x: Column, sign: str, pattern: str | None) -> Column:
    """x cut after each sign: by the sign itself, which needs no regular expression, or at matches of a pattern where it has the sign at all."""
    if pattern is not None:
        return F.when(x.contains(sign), F.split(x, pattern, -1)).otherwise(F.array(x))
    pieces = F.split(x, "\\+" if sign == "+" else sign, -1)
    return let(pieces, lambda p: F.transform(p, lambda t, i: F.when(i < F.size(p) - 1, F.concat(t, F.lit(sign))).otherwise(t)))


def _cut_units(of: Column, plain, first_line: bool = False) -> Column:
    """Parts (text, formula, cut) of units, plain text cut by plain; first_line: also where one begins with a line break."""

    def parts(u: Column) -> Column:
        part = lambda t, formula, cut: F.struct(t.alias("text"), formula.alias("formula"), cut.alias("cut"))
        begins = u["text"].startswith("\n") if first_line else F.lit(False)
        pieces = F.transform(plain(u["text"]), lambda t, i: part(t, F.lit(False), (i > 0) | begins))
        return F.when(u["formula"], F.array(part(u["text"], F.lit(True), F.lit(False)))).otherwise(pieces)

    return F.flatten(F.transform(of, parts))


def _sentences_and_lines(x: Column) -> Column:
    return F.split(x, rf"{_SENTENCE_END}|(?=\n)", -1)


def breaks(x: Column) -> Column:
    """How many sentence ends and line breaks lie outside formulas: the cuts of step 1 before any piece is joined."""
    cut = F.filter(_cut_units(units(x), _sentences_and_lines, first_line=True), lambda p: p["cut"])
    return F.size(cut)


_PIECE = "struct<text: string, parts: array<struct<text: string, formula: boolean>>>"


def _folded(parts: Column, onward) -> Column:
    """Pieces from flagged parts: at a cut the piece so far ends, unless it must go onward to the next."""
    none = F.expr(f"cast(array() as array<{_PIECE}>)")
    empty = F.expr(f"cast(named_struct('text', '', 'parts', array()) as {_PIECE})")
    state = lambda done, now: F.struct(done.alias("done"), now.cast(_PIECE).alias("now"))

    def step(s: Column, p: Column) -> Column:
        one = F.struct(p["text"].alias("text"), p["formula"].alias("formula"))
        longer = F.struct(F.concat(s["now"]["text"], p["text"]).alias("text"), F.concat(s["now"]["parts"], F.array(one)).alias("parts"))
        fresh = F.struct(p["text"].alias("text"), F.array(one).alias("parts"))
        ends = p["cut"] & ~onward(s["now"])
        return F.when(ends, state(F.concat(s["done"], F.array(s["now"])), fresh)).otherwise(state(s["done"], longer))

    return F.aggregate(parts, state(none, empty), step, lambda s: F.concat(s["done"], F.array(s["now"])))


def _last_joined(pieces: Column, onward) -> Column:
    """The last piece joined to its predecessor if it should have gone onward."""
    n = F.size(pieces)
    a, b = F.get(pieces, n - 2), F.get(pieces, n - 1)
    both = F.struct(F.concat(a["text"], b["text"]).alias("text"), F.concat(a["parts"], b["parts"]).alias("parts")).cast(_PIECE)
    return F.when((n > 1) & onward(b), F.concat(F.slice(pieces, F.lit(1), n - 2), F.array(both))).otherwise(pieces)


def _within(pieces: Column, parts, onward) -> Column:
    """Pieces cut again: parts of each piece with their flags, the first part of a piece always at a cut, folded over the whole text."""
    flagged = F.flatten(F.transform(pieces, lambda p: F.transform(parts(p["parts"]), lambda q, i: F.struct(q["text"].alias("text"), q["formula"].alias("formula"), ((i == 0) | q["cut"]).alias("cut")))))
    return let(_folded(flagged, onward), lambda v: _last_joined(v, onward))


def _sentences(x: Column) -> Column:
    """Step 1."""

    def onward(p: Column) -> Column:
        size = F.aggregate(p["parts"], F.lit(0), lambda n, q: n + F.when(q["formula"], FORMULA).otherwise(F.length(q["text"])))
        ended = F.element_at(p["parts"], -1)["text"].endswith(".") & ~F.element_at(p["parts"], -1)["formula"]
        return (size < SHORT) & ~ended

    parts = _cut_units(units(x), _sentences_and_lines, first_line=True)
    return _folded(parts, lambda p: F.when(F.size(p["parts"]) == 0, True).otherwise(onward(p)))


def _after_formulas(pieces: Column) -> Column:
    """Step 2."""

    def parts(of: Column) -> Column:
        after = lambda i: F.coalesce(F.get(of, i - 1)["formula"] & F.get(of, i - 1)["text"].rlike(_CLOSING), F.lit(False))
        return F.transform(of, lambda q, i: F.struct(q["text"].alias("text"), q["formula"].alias("formula"), after(i).alias("cut")))

    return _within(pieces, parts, lambda p: (F.length(p["text"]) < SHORT) & ~p["text"].rlike(_CLOSING))


def _lines_of_formulas(pieces: Column) -> Column:
    """Step 3."""

    def parts(of: Column) -> Column:
        lines = lambda q: F.transform(F.when(q["formula"], F.split(q["text"], r"(?=\n)", -1)).otherwise(F.array(q["text"])), lambda t, i: F.struct(t.alias("text"), q["formula"].alias("formula"), (i > 0).alias("cut")))
        return F.flatten(F.transform(of, lines))

    return _within(pieces, parts, lambda p: (F.length(p["text"]) < 3) | p["text"].rlike(_OPENING))


def _middle(parts: Column, size, least: int) -> Column:
    """Characters before the cut of flagged parts that is nearest to the middle, null if a half would be too short. size is a part's length for the middle."""
    start = F.expr("cast(named_struct('at', 0, 'real', 0, 'found', array()) as struct<at: int, real: int, found: array<struct<at: int, real: int>>>)")

    def step(s: Column, p: Column) -> Column:
        here = F.struct(s["at"].alias("at"), s["real"].alias("real"))
        found = F.when(p["cut"], F.concat(s["found"], F.array(here))).otherwise(s["found"])
        return F.struct((s["at"] + size(p)).alias("at"), (s["real"] + F.length(p["text"])).alias("real"), found.alias("found"))

    def best(s: Column) -> Column:
        near = F.array_min(F.transform(s["found"], lambda c: F.struct(F.abs(2 * c["at"] - s["at"]).alias("off"), c["at"].alias("at"), c["real"].alias("real"))))
        return let(near, lambda c: F.when(F.least(c["real"], s["real"] - c["real"]) >= least, c["real"]))

    return F.aggregate(parts, start, step, best)


def _cut_in_language(x: Column) -> Column:
    size = lambda p: F.when(p["formula"], FORMULA).otherwise(F.length(p["text"]))

    def cut_by(sign: str, pattern: str | None):
        return lambda t: _after(t, sign, pattern)

    return let(units(x), lambda u: F.coalesce(*[_middle(_cut_units(u, cut_by(*sign)), size, LEAST_IN_LANGUAGE) for sign in _IN_LANGUAGE]))


def _cut_in_formulas(x: Column) -> Column:
    def halved(sign: str, pattern: str | None) -> Column:
        parts = F.transform(_after(x, sign, pattern), lambda t, i: F.struct(t.alias("text"), F.lit(False).alias("formula"), (i > 0).alias("cut")))
        return _middle(parts, lambda p: F.length(p["text"]), LEAST_IN_FORMULAS)

    return F.coalesce(*[halved(*sign) for sign in _IN_FORMULAS])


def _beside_middle(x: Column, sign: str, least: int) -> Column:
    """_middle for a sign of one character in plain text: the last before the middle and the first from there on."""
    n = F.length(x)

    def best(half: Column) -> Column:
        before = F.position(F.lit(sign), F.reverse(F.left(x, half - 1)))
        left, right = F.when(before > 0, half - before), F.nullif(F.position(F.lit(sign), x, half), F.lit(0))
        near = let(F.struct(left.alias("left"), right.alias("right")), lambda c: F.when(c["right"].isNull() | (n - 2 * c["left"] <= 2 * c["right"] - n), c["left"]).otherwise(c["right"]))
        return let(near, lambda at: F.when(F.least(at, n - at) >= least, at))

    return let(F.ceil(n / 2).cast("int"), best)


def _cut_plain(x: Column, signs, least: int) -> Column:
    """_cut_in_language or _cut_in_formulas of plain text by those signs that it can hold."""

    def halved(sign: str, pattern: str | None) -> Column:
        if pattern is None:
            return _beside_middle(x, sign, least)
        parts = F.transform(F.split(x, pattern, -1), lambda t, i: F.struct(t.alias("text"), F.lit(False).alias("formula"), (i > 0).alias("cut")))
        return F.when(x.contains(sign), _middle(parts, lambda p: F.length(p["text"]), least))

    return F.coalesce(*[halved(*sign) for sign in signs])


def _halved(x: Column, in_language=_cut_in_language, in_formulas=_cut_in_formulas) -> Column:
    """Step 4 on one piece. After a cut inside a formula, parts that begin within the stretch cut so far are only cut inside formulas."""
    todo = "array<struct<text: string, start: int>>"
    kind = f"struct<done: array<string>, todo: {todo}, low: int, high: int>"
    start = F.struct(F.expr(_STRINGS).alias("done"), F.array(F.struct(x.alias("text"), F.lit(0).alias("start"))).alias("todo"), F.lit(-1).alias("low"), F.lit(0).alias("high")).cast(kind)

    def step(s: Column, _: Column) -> Column:
        first = F.get(s["todo"], F.lit(0))
        text = first["text"]
        rest = F.slice(s["todo"], F.lit(2), F.size(s["todo"]))
        fenced = (s["low"] <= first["start"]) & (first["start"] < s["high"])
        spoken = F.when((F.length(text) > LONG) & ~fenced, in_language(text))
        inside = F.when(F.length(text) > LONG, in_formulas(text))

        def with_cuts(c: Column) -> Column:
            at = F.coalesce(c["spoken"], c["inside"])
            two = F.array(F.struct(F.left(text, at).alias("text"), first["start"].alias("start")), F.struct(F.substr(text, at + 1).alias("text"), (first["start"] + at).alias("start")))
            formula = c["spoken"].isNull()
            low = F.when(formula, F.when(s["low"] == -1, at).otherwise(F.least(s["low"], at))).otherwise(s["low"])
            high = F.when(formula, F.greatest(s["high"], F.length(text))).otherwise(s["high"])
            split = F.struct(s["done"].alias("done"), F.concat(two, rest).alias("todo"), low.alias("low"), high.alias("high")).cast(kind)
            kept = F.struct(F.concat(s["done"], F.array(text)).alias("done"), rest.alias("todo"), s["low"].alias("low"), s["high"].alias("high")).cast(kind)
            return F.when(at.isNotNull(), split).otherwise(kept)

        cuts = let(spoken, lambda a: F.struct(a.alias("spoken"), F.when(a.isNull(), inside).alias("inside")))
        return F.when(F.size(s["todo"]) == 0, s).otherwise(let(cuts, with_cuts))

    # only parts over LONG are cut, into halves of LEAST_IN_FORMULAS or more: so many cuts at most, and each part takes a round
    cuts = F.greatest(F.ceil((F.length(x) - LONG) / LEAST_IN_FORMULAS).cast("int"), F.lit(0))
    rounds = F.sequence(F.lit(0), 2 * cuts)
    return F.aggregate(rounds, start, step, lambda s: s["done"])


def _long_halved(texts: Column, halved) -> Column:
    """The texts that are not empty, the long ones halved."""
    some = F.filter(texts, lambda t: t != "")
    return let(some, lambda v: F.flatten(F.transform(v, lambda t: F.when(F.length(t) > LONG, halved(t)).otherwise(F.array(t)))))


def _pieces_with_formulas(x: Column) -> Column:
    three = let(let(let(x, _sentences), _after_formulas), _lines_of_formulas)
    return _long_halved(let(three, lambda p: F.transform(p, lambda v: v["text"])), _halved)


def _joined(texts: Column, onward) -> Column:
    """Texts joined with the next where they must go onward to it."""
    kind = "struct<done: array<string>, now: string>"
    start = F.expr(f"cast(named_struct('done', array(), 'now', null) as {kind})")
    state = lambda done, now: F.struct(done.alias("done"), now.alias("now")).cast(kind)

    def step(s: Column, t: Column) -> Column:
        now = s["now"]
        return F.when(now.isNull(), state(s["done"], t)).when(onward(now), state(s["done"], F.concat(now, t))).otherwise(state(F.concat(s["done"], F.array(now)), t))

    return F.aggregate(texts, start, step, lambda s: F.concat(s["done"], F.array(s["now"])))


def _plain_pieces(x: Column) -> Column:
    """The pieces of a text without formulas: step 2 leaves none below SHORT but a single one, so step 3 joins nothing."""
    short = lambda t: F.length(t) < SHORT

    def last_joined(p: Column) -> Column:
        n = F.size(p)
        both = F.array(F.concat(F.get(p, n - 2), F.get(p, n - 1)))
        return F.when((n > 1) & short(F.get(p, n - 1)), F.concat(F.slice(p, F.lit(1), n - 2), both)).otherwise(p)

    spoken = lambda t: _cut_plain(t, _IN_LANGUAGE, LEAST_IN_LANGUAGE)
    inside = lambda t: _cut_plain(t, (("=", None), ("+", None)), LEAST_IN_FORMULAS)
    sentences = _joined(_sentences_and_lines(x), lambda t: short(t) & ~t.endswith("."))
    return _long_halved(let(_joined(sentences, short), last_joined), lambda t: _halved(t, spoken, inside))


def solution_pieces(x: Column) -> Column:
    """The pieces of a solution, which joined give it back."""
    return let(x, lambda t: F.when(~t.rlike(r"[$\\\[]"), _plain_pieces(t)).otherwise(_pieces_with_formulas(t)))

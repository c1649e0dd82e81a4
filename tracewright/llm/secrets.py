"""Secret scan: fixed patterns, and windows of high entropy inside candidate strings.

Base kinds (assign, access, hex) are leftmost non-overlapping matches of a
pattern that also pass a length. To these come ``entropy`` spans: a candidate is
a maximal run of ``[A-Za-z0-9+/_=-]`` of at least ``WINDOW`` characters. It has a
character class (hex, alphanumeric or base64), and a window of ``WINDOW``
characters slides over it. The window's Shannon entropy is kept by incremental
counts: with c the count of a character, sum(c * log2 c) changes by one term for
the character that enters and one for the one that leaves. Windows that reach
the threshold of their class and mix letters and digits are merged into spans.
An allow list suppresses candidates that are known to be harmless: UUIDs, paths
and names of words, runs in alphabetical or numerical order, and texts named by
the caller.

Positions. The gaps between matches are ``split`` by the same pattern that
``regexp_extract_all`` finds, so a match starts at the total length of the gaps
and matches before it; lengths are in code points, ends are exclusive.

Scale. One pass over each row with Spark's own expressions, no shuffle at all.
Only texts in which a pattern occurs pay for its positions. The running counts
hold one number a character of the alphabet, whatever the text. A candidate is
taken in stretches of ``STRETCH`` windows and matches in blocks of ``BLOCK``, so
that the work grows in proportion to a text, however long its runs are.

Defined cases: a null text counts as empty and has no spans; the hash of no
spans is that of the empty string; repeated rows each give their row; an empty
table gives no rows; a text or run of any length is read whole; spans that start
together come by kind, then end; columns of docs named ``base_spans`` or
``all_spans`` are replaced, all others kept (``_assign``, ``_values`` and
``_candidates`` are names of this module).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
STRETCH, BLOCK = 108, 256
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Entropy in bits a character that a window must reach, by class.
THRESHOLDS = {"hex": 3.0, "alphanumeric": 3.6, "base64": 3.8}
#: Candidates that are let go: a UUID; words joined by - _ / or =, with digits at most at a word's end.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[-_=/+]*([A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}([-_=/+]+(([A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]{1,4}))*[-_=/+]*$",
    r"(?i)^(0123456789|abcdefghijklmnopqrstuvwxyz|[-_=/+])+$",
)
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SPANS = "array<struct<start: bigint, kind: int, end: bigint>>"


def _running(lengths: Column) -> Column:
    """The sum of all earlier numbers, for each number of an array; block by block, so that no step copies a long array."""
    nothing = lambda: F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
    scan = lambda v: F.aggregate(v, nothing(), lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    total = lambda v: F.aggregate(v, F.lit(0).cast("bigint"), lambda s, x: s + x)
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(BLOCK)), lambda k: F.slice(v, k + 1, F.lit(BLOCK)))
    sums = lambda c: F.flatten(F.zip_with(c, scan(F.transform(c, total)), lambda v, base: F.transform(scan(v), lambda x: x + base)))
    return let(lengths, lambda v: F.when(F.size(v) > 0, let(cut(v), sums)).otherwise(F.expr("cast(array() as array<bigint>)")))


def _located(text: Column, pattern: str) -> Column:
    """Matches with their start in code points: array of (start, match)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def at(x: Column) -> Column:
        # a match starts after its gap and all gaps and matches before it
        gaps, matches = x["gaps"], x["matches"]
        before = _running(F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(F.coalesce(m, F.lit("")))).cast("array<bigint>"))
        starts = F.zip_with(before, gaps, lambda b, g: b + F.length(g))
        return F.slice(F.zip_with(starts, matches, lambda s, m: F.struct(s.alias("start"), m.alias("match"))), F.lit(1), F.size(matches))

    none = F.expr("cast(array() as array<struct<start: bigint, match: string>>)")
    return F.when(text.rlike(pattern), let(F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("matches")), at)).otherwise(none)


def _spans(located: Column, kind: int) -> Column:
    return F.transform(located, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["match"])).alias("end")))


def _character_class(s: Column) -> Column:
    return F.when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(s.rlike("^[A-Za-z0-9]+$"), "alphanumeric").otherwise("base64")


def _threshold(s: Column) -> Column:
    kind = _character_class(s)
    out = F.lit(None).cast("double")
    for name, least in THRESHOLDS.items():
        out = F.when(kind == name, F.lit(least)).otherwise(out)
    return out


def _hot_in(codes: Column, least: Column, first: Column) -> Column:
    """Which of the windows that start at first and up to STRETCH - 1 later reach the threshold, by incremental counts."""
    zero = F.struct(
        F.array_repeat(F.lit(0), len(_ALPHABET)).alias("counts"),
        F.lit(0.0).alias("load"),
        F.lit(0).alias("letters"),
        F.lit(0).alias("digits"),
        F.expr("cast(array() as array<int>)").alias("hot"),
    )
    weights = F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(WINDOW + 2)])
    letter = lambda c: F.coalesce(c <= 52, F.lit(False)).cast("int")
    digit = lambda c: F.coalesce((c > 52) & (c <= 62), F.lit(False)).cast("int")

    def moved(counts: Column, code: Column, by: int) -> Column:
        return F.concat(F.slice(counts, F.lit(1), code - 1), F.array(F.get(counts, code - 1) + by), F.slice(counts, code + 1, F.lit(len(_ALPHABET))))

    def change(counts: Column, code: Column, by: int) -> Column:
        now = F.get(counts, code - 1)
        return F.get(weights, now + by) - F.get(weights, now)

    def step(s: Column, i: Column) -> Column:
        enters, leaves = F.get(codes, i), F.when(i - WINDOW >= first, F.get(codes, i - WINDOW))
        fewer = F.when(leaves.isNull(), s["counts"]).otherwise(moved(s["counts"], leaves, -1))
        load = s["load"] + F.coalesce(change(s["counts"], leaves, -1), F.lit(0.0))
        letters = s["letters"] + letter(enters) - letter(leaves)
        digits = s["digits"] + digit(enters) - digit(leaves)
        part = F.struct(fewer.alias("counts"), load.alias("load"), letters.alias("letters"), digits.alias("digits"))

        def entered(x: Column) -> Column:
            load = x["load"] + change(x["counts"], enters, 1)
            hit = (i - first >= WINDOW - 1) & (load <= least + 1e-9) & (x["letters"] > 0) & (x["digits"] > 0)
            hot = F.when(hit, F.concat(s["hot"], F.array(i - WINDOW + 1))).otherwise(s["hot"])
            return F.struct(moved(x["counts"], enters, 1).alias("counts"), load.alias("load"), x["letters"].alias("letters"), x["digits"].alias("digits"), hot.alias("hot"))

        return let(part, entered)

    last = F.least(first + STRETCH + WINDOW - 2, F.size(codes) - 1)
    return F.aggregate(F.sequence(first, last), zero, step, lambda x: x["hot"])


def _hot_windows(s: Column) -> Column:
    """Starts (from 0) of the windows of a candidate that reach its threshold, ascending."""
    least = WINDOW * (F.log2(F.lit(WINDOW).cast("double")) - _threshold(s))
    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(_ALPHABET), c))
    starts = F.sequence(F.lit(0), F.length(s) - WINDOW, F.lit(STRETCH))
    each = lambda x: F.flatten(F.transform(starts, lambda first: _hot_in(x["codes"], x["least"], first)))
    return let(F.struct(codes.alias("codes"), least.alias("least")), each)


def _allowed(s: Column, allow: tuple[str, ...]) -> Column:
    """Whether the caller or one of ALLOWED lets s go; without nested repetition, on which Java's patterns recurse."""
    word = "([A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}"
    parts = F.filter(F.split(s, "[-_=/+]+"), lambda x: x != "")
    words = let(parts, lambda w: F.coalesce(F.get(w, 0).rlike(f"^{word}$"), F.lit(False)) & F.forall(w, lambda x: x.rlike(f"^({word}|[0-9]{{1,4}})$")))
    ordered = F.length(F.regexp_replace(s, "(?i)0123456789|abcdefghijklmnopqrstuvwxyz|[-_=/+]", "")) == 0
    known = F.coalesce(s.isin(*allow), F.lit(False)) if allow else F.lit(False)
    return known | s.rlike(ALLOWED[0]) | words | ordered


def _entropy_spans(located: Column, allow: tuple[str, ...]) -> Column:
    candidates = F.filter(located, lambda x: ~_allowed(x["match"], allow))

    def merged(x: Column, hot: Column) -> Column:
        opens = F.filter(hot, lambda h, i: F.coalesce(h > F.get(hot, i - 1) + WINDOW, F.lit(True)))
        closes = F.filter(hot, lambda h, i: F.coalesce(F.get(hot, i + 1) > h + WINDOW, F.lit(True)))
        return F.zip_with(opens, closes, lambda a, b: F.struct((x["start"] + a).alias("start"), F.lit(3).alias("kind"), (x["start"] + b + WINDOW).alias("end")))

    return F.flatten(F.transform(candidates, lambda x: let(_hot_windows(x["match"]), lambda hot: merged(x, hot))))


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """docs with base_spans and all_spans, arrays of (start, kind, end) by start, then kind."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("_assign", _located(text, ASSIGN)).withColumn("_values", F.when(F.size("_assign") > 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))))
    long_ = F.filter(F.zip_with("_assign", F.coalesce("_values", F.array().cast("array<string>")), lambda x, v: F.struct(x["start"].alias("start"), x["match"].alias("match"), v.alias("v"))), lambda x: F.length(x["v"]) >= 6)
    base = F.concat(_spans(long_, 0), _spans(_located(text, ACCESS), 1), _spans(_located(text, HEX), 2))
    out = out.withColumn("base_spans", F.sort_array(base)).withColumn("_candidates", _located(text, CANDIDATE))
    found = F.when(F.size("_candidates") > 0, _entropy_spans(F.col("_candidates"), allow)).otherwise(F.expr(f"cast(array() as {_SPANS})"))
    return out.withColumn("all_spans", F.sort_array(F.concat("base_spans", found))).drop("_assign", "_values", "_candidates")


def digest(docs: DataFrame) -> DataFrame:
    out = scan(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"),
        _joined(F.col("all_spans")).alias("spans"),
    )


def _located_sql(pattern: str, group: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, f[k] AS match, v[k] AS value,
      CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS a
    FROM (SELECT *, unnest(range(1, len(f) + 1)) AS k FROM (
      SELECT doc_id, regexp_extract_all(t, '{p}') AS f, regexp_extract_all(t, '{p}', {group}) AS v, regexp_split_to_array(t, '{p}') AS g FROM d))"""


#: DuckDB, over the same tables: fixed patterns, and the entropy of every window taken anew.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
base AS (
  SELECT doc_id, a, 0 AS kind, a + length(match) AS b FROM ({_located_sql(ASSIGN, 1)}) WHERE length(value) >= 6
  UNION ALL SELECT doc_id, a, 1, a + length(match) FROM ({_located_sql("AKIA[A-Z0-9]+", 0)}) WHERE length(match) >= 20
  UNION ALL SELECT doc_id, a, 2, a + length(match) FROM ({_located_sql("[0-9a-f]+", 0)}) WHERE length(match) >= 24),
candidate AS (
  SELECT doc_id, a, match AS s, CASE WHEN regexp_matches(match, '^([0-9a-f]+|[0-9A-F]+)$') THEN {THRESHOLDS["hex"]} WHEN regexp_matches(match, '^[A-Za-z0-9]+$') THEN {THRESHOLDS["alphanumeric"]} ELSE {THRESHOLDS["base64"]} END AS least
  FROM ({_located_sql(CANDIDATE, 0)}) WHERE NOT regexp_matches(match, '{"|".join(ALLOWED)}')),
hot AS (
  SELECT doc_id, a, i FROM (SELECT doc_id, a, least, i, s[i + 1:i + 20] AS w FROM (SELECT *, unnest(range(0, length(s) - 19)) AS i FROM candidate))
  WHERE regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[0-9]') AND list_aggregate(string_split(w, ''), 'entropy') >= least - 1e-9),
runs AS (
  SELECT doc_id, a, i, sum(new) OVER (PARTITION BY doc_id, a ORDER BY i) AS run
  FROM (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id, a ORDER BY i) + {WINDOW} THEN 1 ELSE 0 END AS new FROM hot)),
spans AS (SELECT * FROM base UNION ALL SELECT doc_id, a + min(i), 3, a + max(i) + {WINDOW} FROM runs GROUP BY doc_id, a, run),
named AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || a || ':' || b AS span FROM spans)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY a, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY a, kind), '') AS spans
FROM d LEFT JOIN named USING (doc_id) GROUP BY d.doc_id, d.row
"""

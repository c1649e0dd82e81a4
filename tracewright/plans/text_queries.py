"""Queries on answer extraction and grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import puzzles
from ..functions import steps as S
from ..functions import text as X
from ..operators.grading import graded_by
from .rollouts import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def graded(spark, sf_dir):
    """A solution text, its gold answer and its source for every line item."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    q, k = F.col("q"), F.col("l_partkey") % 6
    s = lambda x: x.cast("string")
    solution = (
        F.when(k == 0, F.concat(F.lit("so \\boxed{"), s(q), F.lit("}")))
        .when(k == 1, F.concat(F.lit("#### "), s(q * 1000)))
        .when(k == 2, F.concat(F.lit("thus \\boxed{\\dfrac{"), s(q), F.lit("}{4}}")))
        .when(k == 3, F.concat(F.lit("we get x = "), s(q), F.lit(" or 1,234")))
        .when(k == 4, F.concat(F.lit("\\boxed{wrong} then \\boxed{ "), s(q), F.lit("/2 }")))
        .otherwise(F.concat(F.lit("\\boxed{"), s(q), F.lit("\\%}")))
    )
    gold = (
        F.when(k == 0, s(q)).when(k == 1, F.concat(s(q), F.lit(",000"))).when(k == 2, F.concat(F.lit("\\frac{"), s(q), F.lit("}{4}")))
        .when(k == 3, F.lit("1234")).when(k == 4, s(q / 2)).otherwise(s(q / 100))
    )
    gold = F.when(F.col("l_linenumber") == 3, F.lit("-7/3")).otherwise(gold)
    source = F.when(F.col("l_partkey") % 2 == 0, "openai-gsm8k main").otherwise("MATH lighteval")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", k.alias("k"), q.alias("q"), solution.alias("solution"), gold.alias("gold"), source.alias("data_source"))


_GRADED = """g AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS q, l_partkey % 6 AS k FROM lineitem)"""


@query(f"""WITH {_GRADED} SELECT l_orderkey, l_linenumber, l_partkey, CASE k WHEN 0 THEN q::VARCHAR WHEN 2 THEN '\\dfrac{{' || q || '}}{{4}}' WHEN 4 THEN q || '/2' WHEN 5 THEN q || '\\%' END AS boxed,
  CASE k WHEN 3 THEN '1234' WHEN 1 THEN (q * 1000)::VARCHAR WHEN 0 THEN q::VARCHAR WHEN 2 THEN '4' WHEN 4 THEN '2' ELSE q::VARCHAR END AS last_number,
  CASE k WHEN 1 THEN (q * 1000)::VARCHAR END AS marked FROM g""")
def t1_t4_answer_extraction(spark, sf_dir):
    s = F.col("solution")
    return graded(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", X.boxed(s).alias("boxed"), X.last_number(s).alias("last_number"), X.after_marker(s).alias("marked"))


@query(f"""WITH {_GRADED} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <> 3 THEN 1.0::DOUBLE WHEN l_partkey % 2 = 0 AND k IN (0, 2, 4, 5) THEN 0.1 ELSE 0.0 END AS score FROM g""")
def t8_t12_graded_answers(spark, sf_dir):
    return graded_by(graded(spark, sf_dir), ["data_source", "solution", "gold"], X.score, "score").select("l_orderkey", "l_linenumber", "l_partkey", "score")


@query("SELECT doc_id, substr(sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 1, 16) AS question_id FROM documents")
def t14_question_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.question_id(F.col("text")).alias("question_id"))


@query("""SELECT doc_id, round(CASE doc_id % 5 WHEN 0 THEN (doc_id % 100) / 100.0 WHEN 1 THEN 0.25 WHEN 2 THEN 0.7 WHEN 3 THEN 0.5 ELSE 0.9 END, 6) AS score FROM documents""")
def t15_judge_scores(spark, sf_dir):
    i = F.col("doc_id")
    raw = (
        F.when(i % 5 == 0, F.concat(F.lit("<think>hm 0.3</think> {\"score\": "), ((i % 100) / 100.0).cast("string"), F.lit("}")))
        .when(i % 5 == 1, F.lit("Score: 0.25 of 1")).when(i % 5 == 2, F.lit("I give 12 no 0.7"))
        .when(i % 5 == 3, F.lit("<think>score 0.9 never closed")).otherwise(F.lit("\"score\": 0.9, bad json"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.round(X.judge_score(raw), 6).alias("score"))


@query("""WITH c AS (SELECT conv_id, turn, role, text FROM conversations), u AS (SELECT conv_id, arg_min(text, turn) AS question FROM c WHERE role = 'user' GROUP BY conv_id), n AS (SELECT conv_id, count(*) AS n_messages FROM c GROUP BY conv_id)
SELECT n.conv_id, n_messages, question FROM n LEFT JOIN u USING (conv_id)""")
def p9_first_user_message(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    listed = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return listed.select("conv_id", F.size("messages").cast("long").alias("n_messages"), X.first_user_message(F.col("messages")).alias("question"))


@query("SELECT doc_id, CASE WHEN length(t) > 120 THEN t[1:120] || '...' ELSE t END AS preview, CASE WHEN doc_id % 3 = 0 THEN '<think>' || lang || '</think>' || source WHEN doc_id % 3 = 1 THEN lang ELSE source END AS wrapped FROM (SELECT doc_id, lang, source, replace(text, chr(10), ' ') AS t FROM documents)")
def p11_p17_wrapped_and_previewed(spark, sf_dir):
    i = F.col("doc_id")
    wrapped = X.thinking_wrapped(F.when(i % 3 < 2, F.col("lang")), F.when(i % 3 != 1, F.col("source")))
    return table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"), wrapped.alias("wrapped"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN -2.0::DOUBLE WHEN doc_id % 4 = 1 THEN 0.0 WHEN doc_id % 4 = 2 THEN -2.0 ELSE 0.0 END AS penalty FROM documents")
def t33_conclusion_penalty(spark, sf_dir):
    i = F.col("doc_id") % 4
    x = F.when(i == 0, "a #### 1 b #### 2").when(i == 1, "a #### 1").when(i == 2, "a ### 1 ### 2").otherwise("plain")
    return table(spark, sf_dir, "documents").select("doc_id", X.conclusion_penalty(x).alias("penalty"))


@query("SELECT doc_id, regexp_replace(t, '<<.*?>>', '', 'gs') AS plain FROM (SELECT doc_id, lang || '<<1+' || doc_id || '>>=' || source || '<<' || chr(10) || '>>' AS t FROM documents)")
def t19_without_calculations(spark, sf_dir):
    x = F.concat("lang", F.lit("<<1+"), F.col("doc_id").cast("string"), F.lit(">>="), "source", F.lit("<<\n>>"))
    return table(spark, sf_dir, "documents").select("doc_id", X.without_calculations(x).alias("plain"))


@query("SELECT doc_id, CAST(greatest(1, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')))) AS INTEGER) AS n_steps, true AS whole FROM documents")
def t28_solution_steps(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text"), X.steps(F.col("text")).alias("steps"))
    return d.select("doc_id", F.size("steps").alias("n_steps"), (F.array_join("steps", "") == F.col("text")).alias("whole"))


@query("SELECT o_orderkey, o_orderkey % 4 IN (0, 1) AS correct FROM orders")
def t13_plain_solution_check(spark, sf_dir):
    k = F.col("o_orderkey")
    n = k.cast("string")
    solution = F.when(k % 4 == 0, F.concat(F.lit("\\boxed{ \\dfrac{"), n, F.lit("}{2} }"))).when(k % 4 == 1, F.concat(F.lit("\\boxed{1} \\boxed{\\frac{"), n, F.lit("}{2}}"))).when(k % 4 == 2, F.lit("\\boxed{1}")).otherwise(n)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.solution_is_correct(solution, F.concat(F.lit("\\frac{"), n, F.lit("}{2}"))).alias("correct"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false ELSE true END AS correct FROM lineitem""")
def t31_make_24(spark, sf_dir):
    k = F.col("l_partkey") % 5
    s = (
        F.when(k == 0, "\\boxed{(1+2+3)*4 = 24}").when(k == 1, "\\boxed{4 \\times 3 \\times 2 \\times 1}").when(k == 2, "\\boxed{4*3*2} ").when(k == 3, "\\boxed{1} \\boxed{(1+2+3)*4}")
        .otherwise("\\boxed{4*(3+2+1)}")
    )
    puzzle = F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", puzzles.makes_24(puzzles.only_boxed(s), puzzle).alias("correct"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'no-answer' ELSE 'no-answer' END AS choice, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN lang || '<end>' END AS rest FROM documents")
def t34_answer_extractors(spark, sf_dir):
    i = F.col("doc_id") % 3
    x = F.when(i < 2, F.concat(F.lit("q Solution:"), F.col("lang"))).otherwise("nothing")
    said = F.when(i == 0, "it is B.").when(i == 1, "A or C").otherwise("none")
    reason = F.when(i == 0, "length").otherwise("stop")
    return table(spark, sf_dir, "documents").select("doc_id", X.only_choice(said).alias("choice"), X.after_prefix(x, "Solution:", reason, "<end>").alias("rest"))


_GAP = "[ \\t\\n\\x0B\\f\\r]"
_FLAG = f"""CASE WHEN contains(t, chr(10) || chr(10)) THEN CASE WHEN regexp_matches(t, '[.?!]{_GAP}*$') THEN 'y' ELSE 'x' END WHEN NOT regexp_matches(t, '[^ \\t\\n\\x0B\\f\\r]') THEN 'w' WHEN regexp_matches(t, '[.?!]{_GAP}*$') THEN 'e' ELSE 'v' END"""
#: A span over a letter a token: e ends a sentence, w is blank, x and y hold a blank line (y ends a sentence too), v is any other.
_SPAN = "[ey](w|[exy]|v[vw]*[exy])|[vwx][vw]*[exy]"


@query(f"""WITH p AS (SELECT doc_id, string_split(text, ' ') AS p FROM documents), k AS (SELECT doc_id, list_transform(generate_series(1, len(p)), lambda i: CASE WHEN i < len(p) THEN p[i] || ' ' ELSE p[i] END) AS toks FROM p),
f AS (SELECT doc_id, array_to_string(list_transform(toks, lambda t: {_FLAG}), '') AS f FROM k), s AS (SELECT doc_id, length(f) AS n, regexp_extract_all(f, '{_SPAN}') AS s, length(array_to_string(regexp_extract_all(f[:40], '{_SPAN}'), '')) AS at40 FROM f)
SELECT doc_id, CAST(len(s) + CASE WHEN length(array_to_string(s, '')) < n THEN 1 ELSE 0 END + CASE WHEN n > 40 AND at40 < 40 THEN 1 ELSE 0 END AS INTEGER) AS n_spans, true AS whole FROM s""")
def t35_sentence_spans(spark, sf_dir):
    tokens = F.split("text", "(?<= )")
    spans = X.sentence_spans(tokens, F.lit(40))
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).alias("n"), spans.alias("s"))
    covered = F.aggregate("s", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    return d.select("doc_id", F.size("s").alias("n_spans"), (covered == F.col("n")).alias("whole"))


_LINES = "CAST(length(t) - length(replace(t, chr(10), '')) AS INTEGER)"
_INITIALS = "regexp_matches(s[i], '(^|[^\\pL\\pN_])[A-Za-z]$') OR regexp_matches(s[i], '[ \\t\\n\\x0B\\f\\r][A-Za-z][A-Za-z]$')"


@query(f"""WITH a AS (SELECT doc_id, 'Let _1. ' || regexp_replace(text, '[$\\\\\\[]', '', 'g') || ' So _2 ends.' AS t FROM documents), b AS (SELECT doc_id, t, string_split(t, '.') AS s FROM a)
SELECT doc_id, CAST({_LINES} + len(list_filter(generate_series(1, len(s) - 1), lambda i: regexp_matches(s[i + 1], '^[ \\t\\n\\x0B\\f\\r]+[A-Z]') AND NOT starts_with(s[i + 1], chr(10)) AND NOT ({_INITIALS}))) AS INTEGER) AS n_breaks FROM b""")
def t29_breaks_outside_formulas(spark, sf_dir):
    """Sentence ends and line breaks of texts with a formula before and after, whose own stops and lines do not count."""
    plain = F.regexp_replace("text", r"[$\\\[]", "")
    x = F.concat(F.lit("Let $x. Y\nz$. "), plain, F.lit(" So \\[a.\nB.\\] ends."))
    return table(spark, sf_dir, "documents").select("doc_id", S.breaks(x).alias("n_breaks"))


@query()
def t29_t30_solution_pieces(spark, sf_dir):
    """Texts cut into steps: how many, the longest, and whether they give the text back."""
    pieces = S.solution_pieces(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", pieces.alias("pieces"))
    longest = F.array_max(F.transform("pieces", F.length))
    return d.select("doc_id", F.size("pieces").alias("n_pieces"), longest.alias("longest"), (F.array_join("pieces", "") == F.col("text")).alias("whole"))


_STRIPPED = "regexp_replace({}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"


@query(f"""WITH d AS (SELECT doc_id, text, translate(text, '{{}}', '') AS p FROM documents)
SELECT doc_id, md5({_STRIPPED.format("'a{' || p || '}b'")}) AS boxed, replace(regexp_extract_all(text, '-?[0-9,]+\\.?[0-9]*')[-1], ',', '') AS last_number, md5(CASE WHEN doc_id % 2 = 0 OR contains(p, '####') THEN {_STRIPPED.format("string_split(p, '####')[-1]")} END) AS marked FROM d""")
def t1_t3_t4_answers_in_texts(spark, sf_dir):
    """Answers in whole documents: in nested braces, the last number, behind a marker."""
    plain = F.translate("text", "{}", "")
    d = table(spark, sf_dir, "documents")
    boxed = F.concat(F.lit("\\boxed{1} so \\boxed{a{"), plain, F.lit("}b} and more}"))
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x #### y ####"), plain)).otherwise(plain)
    # an answer of a text that holds the marker itself begins after the last one
    return d.select("doc_id", F.md5(X.boxed(boxed)).alias("boxed"), X.last_number(F.col("text")).alias("last_number"), F.md5(X.after_marker(marked)).alias("marked"))

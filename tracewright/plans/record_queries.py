"""Queries on records: readers and writers in round trips, filters, field maps, texts and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import text as X
from ..operators import joins as J
from ..operators import records as R
from ..sources import readers, writers
from ..streaming import state as S
from .rollouts import ROLLOUTS, TOKENS, rollouts, table, tokens

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, lang, n_chars FROM documents")
def s1_p18_columns(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")


_SPEC = readers.SourceSpec("openai/gsm8k", ("problem", "text"), ("answer", "source"), keep="lang IN ('en', 'de')", extra={"level": "lang"})


@query("SELECT 'openai/gsm8k' AS data_source, CAST(doc_id AS VARCHAR) AS idx, text AS question, source AS ground_truth, lang AS level, 2 AS n_messages FROM documents WHERE lang IN ('en', 'de')")
def s2_s3_s8_k1_p1_p4_p8_prompt_records(spark, sf_dir):
    path = writers.scratch(spark, "prompts") + ".parquet"
    writers.write_prompts(_SPEC.load(table(spark, sf_dir, "documents"), "train", "doc_id"), path)
    r = readers.read_prompts(spark, path)
    question, info = X.first_user_message(F.col("prompt")).alias("question"), F.col("extra_info")
    return r.select("data_source", info["index"].alias("idx"), question, F.col("reward_model.ground_truth").alias("ground_truth"), info["level"].alias("level"), F.size("prompt").alias("n_messages"))


@query("SELECT lang AS data_source, source AS content, 'user' AS role, 1 AS n_messages FROM documents")
def s4_s13_json_prompts(spark, sf_dir):
    path = writers.scratch(spark, "prompts") + ".jsonl"
    writers.append_json(table(spark, sf_dir, "documents").select(F.col("lang").alias("data_source"), F.col("source").alias("prompt")), path)
    one = F.get("prompt", F.lit(0))
    return readers.read_prompts(spark, path).select("data_source", one["content"].alias("content"), one["role"].alias("role"), F.size("prompt").alias("n_messages"))


@query(f"WITH {ROLLOUTS} SELECT problem_id, CAST(row_number() OVER (PARTITION BY problem_id ORDER BY idx) - 1 AS INTEGER) AS sample_idx, answer AS response, score FROM roll")
def s5_s6_k2_results(spark, sf_dir):
    listed = rollouts(spark, sf_dir).groupBy("problem_id").agg(F.sort_array(F.collect_list(F.struct("idx", "answer", "score"))).alias("x"))
    path = writers.scratch(spark, "results")
    writers.append_json(listed.select("problem_id", F.col("x.answer").alias("responses"), F.col("x.score").alias("scores")), path)
    return readers.read_results(spark, path).select("problem_id", "sample_idx", "response", "score")


@query("SELECT doc_id, lang FROM documents")
def s11_s12_u1_shards_read_together(spark, sf_dir):
    path = writers.scratch(spark, "shards")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    for k in range(3):
        d.where(F.pmod("doc_id", F.lit(3)) == k).write.parquet(f"{path}/{k}")
    return spark.read.parquet(*[f"{path}/{k}" for k in range(3)])


@query("SELECT round(avg(doc_id % 100), 6) AS prompt_throughput, round(avg(doc_id % 7), 6) AS generation_throughput, 0.0::DOUBLE AS cache_usage FROM documents")
def s17_server_log_averages(spark, sf_dir):
    path = writers.scratch(spark, "log")
    line = F.concat(F.lit("INFO Avg prompt throughput: "), (F.col("doc_id") % 100).cast("string"), F.lit(" tokens/s, Avg generation throughput: "), (F.col("doc_id") % 7).cast("string"), F.lit(" tokens/s"))
    table(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    return readers.server_log_averages(spark, path).select(*[F.round(c, 6).alias(c) for c in ("prompt_throughput", "generation_throughput", "cache_usage")])


@query(f"WITH {ROLLOUTS} SELECT problem_id, count(*) AS n_rollouts, count(*) FILTER (WHERE score >= 0.5) AS n_correct FROM roll GROUP BY problem_id HAVING max(score) < 1.0")
def k5_p13_hard_subset(spark, sf_dir):
    good = F.count_if(F.col("score") >= 0.5)
    per = rollouts(spark, sf_dir).where("answer <> '' and problem_id is not null").groupBy("problem_id").agg(F.count("*").alias("n_rollouts"), good.alias("n_correct"), F.max("score").alias("best"))
    path = writers.scratch(spark, "hard")
    per.where("best < 1.0").drop("best").write.parquet(path)
    return spark.read.parquet(path)


@query("SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels")
def k7_csv_round_trip(spark, sf_dir):
    path = writers.scratch(spark, "labels")
    rows = table(spark, sf_dir, "labels").select(*[F.col(c).cast("long").alias(c) for c in ("doc_id", "quality", "toxic")])
    writers.write_csv(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END::BIGINT AS value FROM labels")
def k9_upserted_metrics(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("value"), F.lit(0).alias("step"))
    new = old.where("doc_id % 3 = 0").select("doc_id", (1 - F.col("value")).alias("value"), F.lit(1).alias("step"))
    return writers.upserted(old, new, "doc_id", "step").select("doc_id", "value")


@query("WITH k AS (SELECT doc_id FROM documents WHERE lang IN ('en', 'fr')) SELECT doc_id FROM k WHERE doc_id <= coalesce((SELECT min(doc_id) FROM k WHERE doc_id >= 100), doc_id)")
def p6_p7_capped_scan(spark, sf_dir):
    return R.until_scanned(table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr")).select("doc_id"), "doc_id", 100)


@query("SELECT o_orderkey, o_orderstatus = 'F' AND o_orderpriority = '5-LOW' AS hit FROM orders WHERE lower(o_orderstatus) = 'f' OR lower(o_orderpriority) IN ('1-urgent', '5-low')")
def p15_p25_level_or_source_and_mask(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where((F.lower("o_orderstatus") == "f") | F.lower("o_orderpriority").isin("1-urgent", "5-low"))
    return o.select("o_orderkey", R.matches({"o_orderstatus": "F", "o_orderpriority": "5-LOW"}).alias("hit"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang END AS field FROM documents")
def p10_p16_json_field(spark, sf_dir):
    k = F.col("doc_id") % 3
    value = F.when(k == 0, F.to_json(F.struct(F.col("lang").alias("ground_truth")))).when(k == 1, F.col("lang")).otherwise('{"other": 1}')
    return table(spark, sf_dir, "documents").select("doc_id", F.get_json_object(value, "$.ground_truth").alias("field"))


@query("SELECT doc_id AS key, lang AS language FROM documents WHERE length(source) > 0")
def p19_p32_p33_mapped_fields(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.length("source") > 0).select("doc_id", "lang", F.lit(None).alias("nothing"))
    return R.mapped(R.without_null_columns(d), {"doc_id": "key", "lang": "language"}, drop_others=True)


@query("SELECT doc_id FROM documents WHERE len(string_split('Question: ' || text, ' ')) <= 120 AND n_chars >= 20 AND len(string_split(text, chr(10))) <= 5")
def p21_p22_t36_fitting_questions(spark, sf_dir):
    question = R.formatted("Question: {text}")
    d = table(spark, sf_dir, "documents")
    return d.where((F.size(F.split(question, " ")) <= 120) & (F.col("n_chars") >= 20) & (F.size(F.split("text", "\n")) <= 5)).select("doc_id")


@query("SELECT doc_id, '{Q} ' || lang || ': ' || source AS query_text, 'so ' || source AS response_text, 1.0::DOUBLE AS scores, 2.0::DOUBLE AS total FROM documents")
def p36_sft_episodes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.replace("source", F.lit(" "), F.lit("_")).alias("source"))
    out = R.sft_episodes(d, R.formatted("{{Q}} {lang}: {source}"), R.formatted("so {source}"))
    return out.select("doc_id", "query_text", "response_text", "scores", F.aggregate("advantages", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query(f"WITH {TOKENS} SELECT response_id, pos, CAST(sum(length(token)) OVER w - length(token) AS BIGINT) AS first, CAST(sum(length(token)) OVER w AS BIGINT) AS last FROM tok WINDOW w AS (PARTITION BY response_id ORDER BY pos)")
def j6_token_spans(spark, sf_dir):
    return R.character_spans(tokens(spark, sf_dir).select("response_id", "pos", "token"), ["response_id"], "pos", "token").select("response_id", "pos", "first", "last")


@query(f"WITH {ROLLOUTS} SELECT problem_id, idx, CASE WHEN max(score) OVER p < 1.0 THEN first_value(answer || idx) OVER (PARTITION BY problem_id ORDER BY idx) END AS golden_text FROM roll WINDOW p AS (PARTITION BY problem_id)")
def j13_golden_for_failed_groups(spark, sf_dir):
    r = rollouts(spark, sf_dir).withColumn("golden", F.concat("answer", F.col("idx").cast("string")))
    return R.golden_for_failed(r, "problem_id", "idx", "score", "golden").select("problem_id", "idx", "golden_text")


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def j14_j15_enriched_results(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey").select("o_orderkey", "c_mktsegment")


@query(f"""WITH {ROLLOUTS}, r AS (SELECT problem_id, count(*) AS n, count(DISTINCT answer) AS u, avg((score >= 0.5)::INTEGER) AS p, avg((answer = 'O')::INTEGER) AS cut FROM roll GROUP BY problem_id)
SELECT round(avg(n), 6) AS n_rollouts, round(avg(u / n), 6) AS unique_share, round(avg(cut), 6) AS truncated_share, round(avg(2 * 1.96 * sqrt(p * (1 - p) / n)), 6) AS ci_length FROM r""")
def g26_monte_carlo_diagnostics(spark, sf_dir):
    right, cut = (F.col("score") >= 0.5).cast("int"), (F.col("answer") == "O").cast("int")
    per = rollouts(spark, sf_dir).groupBy("problem_id").agg(F.count("*").alias("n"), F.count_distinct("answer").alias("u"), F.avg(right).alias("p"), F.avg(cut).alias("cut"))
    ci = M.confidence_length(F.col("p"), F.col("n"))
    return per.agg(F.round(F.avg("n"), 6).alias("n_rollouts"), F.round(F.avg(F.col("u") / F.col("n")), 6).alias("unique_share"), F.round(F.avg("cut"), 6).alias("truncated_share"), F.round(F.avg(ci), 6).alias("ci_length"))


@query("SELECT lang, source, round(avg(n_chars), 4) AS n_chars_mean, round(stddev_samp(n_chars), 4) AS n_chars_std FROM documents GROUP BY lang, source")
def g43_mean_and_deviation(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.round(F.avg("n_chars"), 4).alias("n_chars_mean"), F.round(F.stddev_samp("n_chars"), 4).alias("n_chars_std"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, min(doc_id) LIMIT 5")
def o8_o10_most_common(spark, sf_dir):
    return R.most_common(table(spark, sf_dir, "documents"), "source", "doc_id", 5)


@query("SELECT question, solution FROM (SELECT doc_id AS question, 'hint ' || lang AS solution FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'free ' || source FROM documents)")
def u2_hint_and_free_solutions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question"), "lang", "source")
    return d.where("question % 2 = 0").select("question", R.formatted("hint {lang}").alias("solution")).unionByName(d.select("question", R.formatted("free {source}").alias("solution")))


@query("""SELECT md5('{"lang":"' || lang || '","shard":' || doc_id % 3 || '}') AS key, count(*) AS n FROM documents GROUP BY lang, doc_id % 3""")
def u3_t38_unique_by_content(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", (F.col("doc_id") % 3).alias("shard"))
    return d.groupBy(R.content_key("shard", "lang").alias("key")).agg(F.count("*").alias("n"))


@query(f"WITH {ROLLOUTS}, f AS (SELECT problem_id, answer, min(idx) AS i FROM roll GROUP BY ALL) SELECT problem_id, string_agg(answer, ',' ORDER BY i) AS answers FROM f GROUP BY problem_id")
def u7_distinct_in_order(spark, sf_dir):
    listed = rollouts(spark, sf_dir).groupBy("problem_id").agg(F.sort_array(F.collect_list(F.struct("idx", "answer"))).alias("x"))
    return listed.select("problem_id", F.array_join(F.array_distinct("x.answer"), ",").alias("answers"))


@query("SELECT o_custkey AS question_id, o_orderkey AS edge_id FROM orders WHERE o_orderstatus <> 'F'")
def u8_buffer_without_used(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("edge_id"), "o_orderstatus")
    return S.without_used(e, e.where("o_orderstatus = 'F'")).select("question_id", "edge_id")


@query("WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT doc_id, array_to_string(w[greatest(len(w) - 9, 1):], ' ') AS fitted FROM w")
def t37_fitted_to_context(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(R.fitted(F.split("text", " "), 10), " ").alias("fitted"))


@query("SELECT event_id, round(CASE WHEN event_type = 'click' THEN 0.0 ELSE value END, 9) AS masked, round(-ln(1 + exp(-value / 2)), 9) AS taken, round(1 / (1 + exp(value / 2 - value)), 6) AS share FROM events")
def m1_m5_m21_log_probabilities(spark, sf_dir):
    v = F.col("value")
    lp = M.log_softmax(F.array(v / 2, v))
    e = table(spark, sf_dir, "events")
    masked = F.when(F.col("event_type") == "click", 0.0).otherwise(v)
    return e.select("event_id", F.round(masked, 9).alias("masked"), F.round(F.get(lp, F.lit(1)), 9).alias("taken"), F.round(F.exp(F.get(lp, F.lit(1))), 6).alias("share"))


@query("SELECT doc_id, lang AS \"info.lang\", source AS \"info.more.source\" FROM documents")
def a17_flattened(spark, sf_dir):
    more = F.struct(F.col("lang"), F.struct(F.col("source")).alias("more")).alias("info")
    return R.flattened(table(spark, sf_dir, "documents").select("doc_id", more))


@query("SELECT conv_id, turn, coalesce(string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM conversations")
def a18_a19_running_context(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return R.running_context(c, ["conv_id"], "turn", "text", "|").select("conv_id", "turn", "context")


@query("SELECT d.doc_id, l.quality::BIGINT AS quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1")
def p24_j1_kept_values(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    d = table(spark, sf_dir, "documents").select("doc_id")
    todo = J.not_done(d, done.where("quality <> 1"), "doc_id")
    return todo.join(done.where("quality = 1"), "doc_id").select("doc_id", "quality")

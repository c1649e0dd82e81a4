"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from . import decontam, html_wrappers, mixing, ngram_join, periodic_runs, pii, quality, secrets, substring_dedup, token_records, toxicity, warc, whitening
from .shared import read_table


def op1_pii_surrogates(spark, sf_dir):
    return pii.digest(read_table(spark, sf_dir, "documents"))


def op2_html_wrapper_induction(spark, sf_dir):
    return html_wrappers.extract(read_table(spark, sf_dir, "pages"))


def op3_quality_rules(spark, sf_dir):
    return quality.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_warc_splittable_reader(spark, sf_dir):
    return warc.archive_and_read(read_table(spark, sf_dir, "pages"))


def op5_toxic_segments(spark, sf_dir):
    return toxicity.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_source_mixing(spark, sf_dir):
    return mixing.digest(read_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark, sf_dir):
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark, sf_dir):
    return secrets.digest(read_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.digest(read_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(read_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark, sf_dir):
    return whitening.digest(read_table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark, sf_dir):
    return periodic_runs.digest(read_table(spark, sf_dir, "documents"))


def op13_token_records(spark, sf_dir):
    return token_records.write_and_read(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_html_wrapper_induction": op2_html_wrapper_induction,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc_splittable_reader": op4_warc_splittable_reader,
    "op5_toxic_segments": op5_toxic_segments,
    "op6_source_mixing": op6_source_mixing,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_secret_scan": op8_secret_scan,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_records": op13_token_records,
}

ORACLE_SQL = {
    "op4_warc_splittable_reader": warc.SQL,
    "op6_source_mixing": mixing.SQL,
    "op8_secret_scan": secrets.SQL,
    "op9_ngram_jaccard_join": ngram_join.SQL,
    "op10_substring_dedup": substring_dedup.SQL,
}

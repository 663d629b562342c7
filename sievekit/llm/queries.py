"""Registered queries of the operators, and their DuckDB twins."""

from __future__ import annotations

from ..sources.tables import table
from . import (bpe, conversation_repair, exact_dedup, line_dedup, lm_scoring, mixing, near_dedup, packing,
               quality_classifier, quality_rules, ranked_search, url_filter, warc)


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"), line_dedup.FULL)


def op2_bpe(spark, sf_dir):
    return bpe.report(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark, sf_dir):
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark, sf_dir):
    return lm_scoring.lm_score(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark, sf_dir):
    return conversation_repair.report(conversation_repair.damage(table(spark, sf_dir, "conversations")), "copies")


def op12_ranked_search(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op13_packing(spark, sf_dir):
    return packing.report(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_bpe": op2_bpe,
    "op3_warc": op3_warc,
    "op4_near_dedup": op4_near_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_quality_rules": op9_quality_rules,
    "op10_url_filter": op10_url_filter,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_ranked_search": op12_ranked_search,
    "op13_packing": op13_packing,
}

ORACLE = {
    "op5_mix_sources": mixing.ORACLE_SQL,
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_url_filter": url_filter.oracle_sql(),
    "op11_conversation_repair": conversation_repair.oracle_sql(),
    "op12_ranked_search": ranked_search.ORACLE_SQL,
}

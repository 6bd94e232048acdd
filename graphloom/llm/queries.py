"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import (chat, collocations, digestindex, imi, jaccard, langid, lengths, linededup, mixing, sanitise, sptok,
                           urltrie, variants)
from graphloom.llm.common import table
from graphloom.session import cut_lineage


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # both the counts and the filter read the lines: pages are turned to lines once
    p = cut_lineage(pages.select("page_id", linededup.url_host(F.col("url")).alias("site"), linededup.html_lines(F.col("html")).alias("text")))
    return linededup.drop_lines(p, F.col("site"), F.col("text")).select("page_id", "site", "n_lines", "n_dropped", "clean_text")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = digestindex.fresh_index(spark)
    found = digestindex.dedup(spark, table(spark, sf_dir, "documents"), index)
    index.close()  # the result reads written tables, not the index
    return found


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sptok.encode(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.token_counts(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imi.near_dedup(table(spark, sf_dir, "embeddings"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.format_chat(rows))


def op10_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.sanitise(table(spark, sf_dir, "documents"))


#: The rules of op11's contract (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urltrie.filter_urls(table(spark, sf_dir, "pages"), rules)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(variants.word_counts(table(spark, sf_dir, "documents"), misspell_every=97))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_phrases(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_token_counts": op5_token_counts,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_chat_format": op9_chat_format,
    "op10_sanitise": op10_sanitise,
    "op11_url_filter": op11_url_filter,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_phrase_mining": op13_phrase_mining,
}

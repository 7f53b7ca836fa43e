"""The opN_ queries: thin digests over the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, extract, jaccard, mixing, packing, quality, repeats, shards, tokens, urls
from quillgraph.llm.common import materialize, new_path, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialize(tokens.token_lengths(table(spark, sf_dir, "documents"), TOKENIZER), "lengths")
    return packing.pack(sized, F.col("n_tokens"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokens.write_orc(table(spark, sf_dir, "documents"), path, TOKENIZER)
    return tokens.token_index(spark, path, partial(materialize, name="token-index"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), keep=False).withColumnRenamed("id", "doc_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shards.ShardStore(spark, new_path(spark, "shards"))
    store.append(table(spark, sf_dir, "documents"))
    store.compact_all()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, urls.link_edges(pages))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_orc": op4_token_orc,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_sharding": op6_sharding,
    "op7_context_mixing": op7_context_mixing,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_url_filters": op9_url_filters,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL = {
    "op3_quality_rules": quality.ORACLE_SQL,
    "op6_sharding": shards.ORACLE_SQL,
    "op9_url_filters": urls.ORACLE_SQL,
    "op10_decontamination": decontaminate.ORACLE_SQL,
}

"""One query for each operator, over the whole of its tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, html, jaccard, licences, mixing, quality, repeats, sharding, substring, tokencount, toxicity, warc, whitening
from tidemark.llm.frames import table

#: The vocabulary that op7 counts with: pieces and scores of a public BPE model file.
#: Its scores are merge ranks, so counts are those of a unigram lattice over them, and not that tokenizer's own.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


def op2_licence_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(table(spark, sf_dir, "documents"))


def op3_paragraph_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table(spark, sf_dir, "documents"))


def op4_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op6_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op7_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), *tokencount.load_vocabulary(VOCABULARY))


def op8_adaptive_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(table(spark, sf_dir, "documents"))


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_embeddings(table(spark, sf_dir, "embeddings"))


def op12_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.run_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_main_text": op1_html_main_text,
    "op2_licence_sentence_rules": op2_licence_sentence_rules,
    "op3_paragraph_minhash_dedup": op3_paragraph_minhash_dedup,
    "op4_qgram_decontamination": op4_qgram_decontamination,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_line_frequency_quality": op6_line_frequency_quality,
    "op7_unigram_token_counts": op7_unigram_token_counts,
    "op8_adaptive_jaccard_join": op8_adaptive_jaccard_join,
    "op9_source_mixture": op9_source_mixture,
    "op10_toxicity_chain": op10_toxicity_chain,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_stratified_shards": op12_stratified_shards,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op2_licence_sentence_rules": licences.LICENCE_SQL,
    "op5_warc_round_trip": warc.WARC_SQL,
    "op6_line_frequency_quality": quality.QUALITY_SQL,
    "op8_adaptive_jaccard_join": jaccard.JACCARD_SQL,
    "op12_stratified_shards": sharding.SHARD_SQL,
    "op13_periodic_runs": repeats.RUN_SQL,
}

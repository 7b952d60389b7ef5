"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_cnn, capture_merge, curriculum, guess_cost, line_crf, shard, simhash_index, telephony, text_density, winnow
from .common import table


def op1_telephony_pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, codec, sample_rate, n_samples, pcm): every document's bytes taken as an 8 kHz payload, by the codec of its language's region."""
    docs = table(spark, sf_dir, "documents")
    codec = F.when(docs["lang"] == "en", "mulaw").when(docs["lang"] == "es", "ima_adpcm").otherwise("alaw")
    return telephony.store_pcm(docs.select("doc_id", F.col("text").cast("binary").alias("payload"), codec.alias("codec")), "doc_id", "payload", "codec")


def op2_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, predicted, confidence, n_windows) of every document."""
    return byte_cnn.identify(table(spark, sf_dir, "documents"))


def op3_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, match, context, value, guesses_log10, spans, secret) of every value in a credential's place."""
    return guess_cost.scan(table(spark, sf_dir, "documents"))


def op4_capture_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index records of three fetches of every page, a day apart, in global order; every third page has changed by the last."""
    fetched = table(spark, sf_dir, "pages").withColumn("visit", F.explode(F.array(*map(F.lit, range(3)))))
    changed = F.when((F.col("visit") == 2) & (F.col("page_id") % 3 == 0), "<!-- again -->").otherwise("")
    fetched = fetched.withColumn("html", F.concat("html", changed))
    return capture_merge.merge_runs(capture_merge.captures_of(fetched, F.lit(1704067200) + F.col("page_id") % 1000 + F.col("visit") * 86400))


def op5_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, text, n_chars, nodes, threshold, density_sum) of every page."""
    return text_density.main_text(table(spark, sf_dir, "pages"))


def op6_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, quality, keep) of every document."""
    return line_crf.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard and its place in it."""
    return shard.shuffle_into_shards(table(spark, sf_dir, "documents"))


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, position) of the documents that training reaches, in its order."""
    return curriculum.training_order(table(spark, sf_dir, "documents"))


def op9_winnowing_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words) of every longest span that a document shares with a test text."""
    return winnow.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kept_id, group_size) of every document with a near-duplicate of lesser doc_id."""
    return simhash_index.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_telephony_pcm": op1_telephony_pcm,
    "op2_byte_cnn_language": op2_byte_cnn_language,
    "op3_guess_cost_secrets": op3_guess_cost_secrets,
    "op4_capture_histories": op4_capture_histories,
    "op5_text_density": op5_text_density,
    "op6_line_crf_quality": op6_line_crf_quality,
    "op7_exact_shards": op7_exact_shards,
    "op8_curriculum_mix": op8_curriculum_mix,
    "op9_winnowing_spans": op9_winnowing_spans,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op4_capture_histories": capture_merge.ORACLE_SQL,
    "op8_curriculum_mix": curriculum.ORACLE_SQL,
    "op9_winnowing_spans": winnow.ORACLE_SQL,
}

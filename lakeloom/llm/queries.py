"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, exact, html, language, licenses, mixing, neighbours, packing, quality, resample, simhash, suffix, tokens
from .common import own_columns, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_columns(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    labels = own_columns(table(spark, sf_dir, "labels"), ["doc_id", "quality"])
    held = quality.held_out()
    scored = quality.quality_scores(docs, labels, train=~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(own_columns(table(spark, sf_dir, "pages"), ["page_id", "url", "html"]))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_columns(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return packing.pack_digests(docs, tokenizer_path())


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_columns(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return licenses.license_matches(docs).select("doc_id", "template_id", "license", "n_shingles", F.round("containment", 6).alias("containment"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_columns(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang"])
    held = language.held_out()
    return language.language_scores(docs, train=~held).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = own_columns(table(spark, sf_dir, "embeddings"), ["vec_id", "embedding"])
    return neighbours.nearest(vectors, F.col("id") % 100 == 0)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_columns(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return simhash.simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_columns(table(spark, sf_dir, "documents"), ["doc_id", "text", "source"])
    return mixing.mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_columns(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return exact.exact_classes(docs, keep="max")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_columns(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return suffix.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_columns(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return resample.resample(docs, own_columns(table(spark, sf_dir, "benchmark"), ["text"]))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_columns(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return tokens.token_counts(docs, tokenizer_path("piece_bpe_32k.model"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_html_extraction": op2_html_extraction,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_target_resampling": op11_target_resampling,
    "op12_token_counts": op12_token_counts,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op4_license_scan": licenses.oracle_sql(),
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.text) AS text_sha256
        FROM d JOIN g USING (text)
    """,
    "op13_vector_codes": codes.oracle_sql(),
}

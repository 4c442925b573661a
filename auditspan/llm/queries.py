"""The operators as registered queries: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (languages, licenses, lines, mixing, neighbours, packing, quality, repeats, sharding, similarity,
               sketches, spelling, whitening)

TOKENIZER = "word_bpe_49k.json"
SHARDS = 8


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def op1_line_templates(spark: SparkSession, sf: str) -> DataFrame:
    out = lines.drop_recurring_lines(read(spark, sf, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_recurring", "n_dropped", F.octet_length(text).cast("long").alias("n_bytes"),
                      F.crc32(text.cast("binary")).alias("text_crc32"))


def op2_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(read(spark, sf, "documents"))


def op3_hypergeometric_shards(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = read(spark, sf, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shuffle_to_shards(rows, SHARDS, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op4_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.jaccard_classes(read(spark, sf, "documents"))


def op5_language_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf, "documents"))


def op6_repeat_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf, "documents"))


def op7_bin_slack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf, "documents"), tokenizer_path())


def op8_word_field(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    model = languages.learn(docs.where(~languages.held_out()))
    return languages.language_id(docs.select("doc_id", "text"), model).withColumn("held_out", languages.held_out())


def op9_small_world(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read(spark, sf, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"))


def op10_license_diagonals(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf, "documents"))


def op11_vector_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened_vectors(read(spark, sf, "embeddings"))


def op12_setsketch_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.sketch_components(read(spark, sf, "documents"))


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_line_templates, op2_source_mix, op3_hypergeometric_shards, op4_ngram_jaccard, op5_language_divergence,
    op6_repeat_intervals, op7_bin_slack, op8_word_field, op9_small_world, op10_license_diagonals,
    op11_vector_whitening, op12_setsketch_dedup, op13_spelling_variants)}

#: SQL cannot express the methods (hash permutations, trained models, graphs, MinHash);
#: tests/llm compares each query with a brute-force version.
ORACLES: dict[str, str] = {}

"""The queries of this folder, one for each operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, cotraining, fm_index, html_text, line_templates, media, plane_store, ppm, simhash, token_counts

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORDS = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(_table(spark, sf_dir, "documents"), size=3, radius=2)
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    coded = byte_bpe.encode_documents(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = plane_store.write_store(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), end_id=1)
    read = plane_store.read_store(spark, store, with_ids=False)
    return read.select("doc_id", "start", "n_tokens", F.col("crc32").alias("ids_crc32"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return cotraining.score(docs, cotraining.fit(docs, _table(spark, sf_dir, "labels")))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store_texts(_table(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return ppm.identify(docs, ppm.learn(docs))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"]).select("doc_id", "found.*")
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    items = F.size("items")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), items.cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (items >= 2).alias("contaminated")
    )


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.without_templates(docs, counts=True)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_html_text, op3_byte_bpe, op4_bit_planes, op5_quality, op6_media, op7_token_counts, op8_language, op9_decontamination, op10_line_templates)}
ORACLE = {"op9_decontamination": fm_index.SQL, "op10_line_templates": line_templates.SQL}

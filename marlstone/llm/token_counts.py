"""Token counts through a digest cache (operator 7).

Every text has a key: the SHA-256 of the tokenizer's version and the normalised text. Keys that the cache
lacks are encoded once each and appended; documents then get their counts by a join on the key.
Null text counts as the empty text (0 tokens). Repeated rows stay repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain_text, scratch_path, sliced
from .word_tokens import word_encoder

CACHE = T.StructType([T.StructField("digest", T.StringType()), T.StructField("n_tokens", T.LongType())])


class WordCounter:
    """Counts by the tokenizers library (.json)."""

    def __init__(self, path: str):
        self.encoder = word_encoder(path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) // 4 for x in self.encoder.encode(texts)]


class PieceCounter:
    """Counts by the sentencepiece library (.model)."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(texts, num_threads=1)]


def version(path: str) -> str:
    """The digest of the tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(path: str, text):
    """Runs of blanks as one blank, for vocabularies that drop white space; else the text as it is."""
    if path.endswith(".json") and word_encoder(path).by_word:
        return F.regexp_replace(text, "[ \\n]+", " ")
    return text


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache, one row for each key; an absent one is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, digest and n_tokens for each row. cache: a folder all executors share; a new one if None."""
    spark = docs.sparkSession
    cache = cache or scratch_path(spark, "token-counts")
    clean = normalised(tokenizer, F.col("text"))
    keyed = plain_text(docs, key, text=text).withColumns({"n_bytes": F.octet_length("text").cast("bigint"), "clean": clean})
    keyed = keyed.withColumn("digest", F.sha2(F.concat(F.lit(version(tokenizer) + "\n"), F.col("clean")), 256))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = (PieceCounter if tokenizer.endswith(".model") else WordCounter)(tokenizer)
        for batch in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter.counts(batch.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    texts = keyed.select("digest", "clean").join(read_cache(spark, cache).select("digest"), "digest", "left_anti")
    misses = texts.groupBy("digest").agg(F.first("clean").alias("clean"))
    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    return keyed.select(key, "n_bytes", "digest").join(read_cache(spark, cache), "digest").select(key, "n_bytes", "digest", "n_tokens")

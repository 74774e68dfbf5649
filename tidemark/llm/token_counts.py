"""Token counts through a cache keyed by content digest and tokenizer version.

Only distinct texts that the cache lacks are encoded, and their counts are appended to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, map_texts, staged, table

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
#: The public vocabulary that the query counts with.
PIECE_MODEL = "piece_bpe_32k.model"


def content(text: Column) -> Column:
    """Normalised content: null as empty. Anything more would change the counts."""
    return F.coalesce(text, F.lit(""))


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(content(text), 256))


def file_version(path: str) -> str:
    """A tokenizer's version: kind of file and digest of its bytes."""
    with open(path, "rb") as f:
        return f"{path.rpartition('.')[2]}-{hashlib.sha256(f.read()).hexdigest()}"


def counter(path: str):
    """A function from a list of texts to their token counts, without added tokens."""
    if path.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in own.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    fast = Tokenizer.from_file(path)
    fast.no_truncation()
    fast.no_padding()
    return lambda texts: [len(x.ids) for x in fast.encode_batch(texts, add_special_tokens=False)]


def encode_misses(misses: DataFrame, path: str, version: str, batch: int = 64) -> DataFrame:
    """(digest, version, n_tokens) of (digest, text) rows; a text that follows itself is encoded once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, last = counter(path), None
        for frame in frames:
            frame = frame[frame["digest"] != frame["digest"].shift(fill_value=last)]
            counts, last = [], frame["digest"].iloc[-1] if len(frame) else last
            for i in range(0, len(frame), batch):
                counts += count(frame["text"].iloc[i:i + batch].tolist())
            yield pd.DataFrame({"digest": frame["digest"], "version": version, "n_tokens": pd.Series(counts, dtype="int64", index=frame.index)})

    return map_texts(misses, run, CACHE_SCHEMA)


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of a version, one row a digest, however often jobs have appended it."""
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("version") == version)
    return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's key with n_bytes, n_tokens and over_limit (more than `limit` tokens).

    tokenizer: path of a .model (sentencepiece) or .json (tokenizers) file, present on every
    machine. cache: Parquet folder of earlier counts; without one a new folder is made in the
    shared folder. Null text counts as empty and has no tokens; of equal texts that of the
    smallest key is encoded; long texts are encoded whole; rows repeat as they repeat in docs,
    null keys too; an empty table gives an empty result; other columns of docs, whatever their
    names, are left out. A job that runs again, or beside another, may append a digest twice;
    it is read once.
    """
    spark, version = docs.sparkSession, file_version(tokenizer)
    cache = cache or fresh_path(spark, "token-cache")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    docs = docs.select(F.col(key).alias("key"), content(F.col(text)).alias("text")).withColumn("digest", content_digest(F.col("text")))
    rows = staged(docs.select("key", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "text-digests")
    # digests meet the cache without their texts; then one text comes for each miss
    distinct = staged(rows.groupBy("digest").agg(F.min("key").alias("key")), "distinct-digests")
    misses = staged(distinct.join(cached(spark, cache, version), "digest", "left_anti"), "misses")
    found = docs.alias("d").join(misses.alias("m"), (F.col("d.digest") == F.col("m.digest")) & F.col("d.key").eqNullSafe(F.col("m.key")), "left_semi")
    encode_misses(found.select("digest", "text"), tokenizer, version).write.mode("append").parquet(cache)
    counts = staged(distinct.select("digest").join(cached(spark, cache, version), "digest"), "counts")
    return rows.join(counts, "digest").select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the public 32k piece vocabulary."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(PIECE_MODEL))

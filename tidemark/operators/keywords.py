"""Which of many keywords lie inside which texts: a scan of each text by an automaton, and equi-joins from there."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged

#: Characters of keywords in one automaton, which bounds what goes to the workers at once.
SHARD = 1 << 20
#: Hits that a task gathers before they go on.
BATCH = 1 << 16


@functools.lru_cache(maxsize=2)
def _automaton(held: Broadcast) -> ahocorasick.Automaton:
    """Built once in a worker for each set of keywords; its values are the keywords' numbers."""
    out = ahocorasick.Automaton()
    for i, word in enumerate(held.value):
        out.add_word(word, i)
    out.make_automaton()
    return out


def _scan(texts: DataFrame, held: Broadcast) -> DataFrame:
    """(id, keyword) of one set of keywords, each pair once for a row of texts."""
    schema = texts.select("id", F.col("text").cast("string").alias("keyword")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, find = pa.array(held.value, pa.string()), _automaton(held)
        for batch in batches:
            rows, hits = [], []
            for row, text in enumerate(batch.column("text")):
                found = {i for _, i in find.iter(text.as_py())} if text.is_valid else ()
                rows += [row] * len(found)
                hits += found
                if len(hits) >= BATCH or row + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), words.take(pa.array(hits, pa.int64()))], names=["id", "keyword"])
                    rows, hits = [], []

    return texts.mapInArrow(run, schema)


def keyword_hits(texts: DataFrame, keywords: DataFrame, shard: int = SHARD) -> DataFrame:
    """(id, keyword): the keywords that each text contains, each once for a row of texts.

    texts: (id, text), keywords: (keyword), in the form in which they are to be compared. Null
    and empty keywords are none; null texts hold none; rows that repeat give repeated pairs.
    Keywords are dealt by hash to automata of about `shard` characters, and each automaton reads
    every text once, whatever the number of its keywords; nothing is compared pair by pair, and
    texts don't move.
    """
    spark = texts.sparkSession
    words = staged(keywords.select(F.col("keyword").cast("string").alias("keyword")).filter("keyword <> ''").distinct(), "keywords")
    total = words.agg(F.sum(F.length("keyword"))).first()[0] or 0
    if not total:
        return texts.select("id", F.col("text").cast("string").alias("keyword")).limit(0)
    shards, own, out = -(-total // shard), texts.select("id", "text"), None
    for i in range(shards):
        part = [r[0] for r in words.filter(F.pmod(F.xxhash64("keyword"), F.lit(shards)) == i).collect()]
        if part:
            found = _scan(own, spark.sparkContext.broadcast(part))
            out = found if out is None else out.unionByName(found)
    return out

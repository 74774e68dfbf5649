"""SimHash near-duplicates through covering locality-sensitive hashing.

For radius r every bit position i gets a vector (1, x_i) of r + 1 bits, the x_i in turn; a
table for each vector v keeps the positions whose vector has an odd product with v. Two
fingerprints that differ in 1 to r positions have a v, other than (1, 0...0), that is even on
all of these (r equations in r + 1 unknowns), so they agree in v's table: no pair is missed.
There are 2^(r + 1) - 2 tables; radius 3 on 64 bits has 14 tables of 32 bits. Buckets with too
many fingerprints are hashed again on the bits that are still free, down to 16 bits and then 8
for radius 3, so that no bucket can hold more than 256 fingerprints whatever the data; for a
larger radius some of the last tables keep fewer bits and more can share a bucket.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import map_texts, running_sums, staged, table
from .word_arrays import NOT_SPACE, Words

RADIUS, SEED, BUCKET = 3, 42, 256


@functools.lru_cache(maxsize=100_000)
def free_bits(free: int, radius: int) -> tuple[int, ...]:
    """For each table over the free bits (a set of positions): the bits that it leaves free."""
    places = [p for p in range(64) if free >> p & 1]
    vectors = [1 | (i % (1 << radius)) << 1 for i in range(len(places))]
    left = {free & ~sum(1 << p for p, m in zip(places, vectors) if (m & v).bit_count() % 2) for v in range(2, 2 << radius)}
    return tuple(sorted(x - (1 << 64) if x >> 63 else x for x in left))


def fingerprint(text: str | None, words: int, seed: int = SEED) -> int:
    """SimHash of a text's word shingles, as an unsigned integer; zero for a text without words."""
    own = text.encode().lower().split() if isinstance(text, str) else []
    if not own:
        return 0
    line = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(own))
    spans = zip(starts[:len(own) - k + 1].tolist(), ends[k - 1:].tolist())
    hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], seed) for a, b in spans), dtype=np.uint64, count=len(own) - k + 1)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i:i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int, text: str = "text", name: str = "fp") -> DataFrame:
    """docs with the fingerprint of its text as a signed long, instead of the text."""
    others = [c for c in docs.columns if c not in (text, name)]
    schema = docs.select(*others, F.lit(0).cast("long").alias(name)).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = np.array([fingerprint(t, words) for t in frame[text]], dtype=np.uint64).view(np.int64)
            yield frame[others].assign(**{name: own})

    return map_texts(docs, run, schema)


def _first_tables(fps: DataFrame, radius: int) -> DataFrame:
    """A row for each fingerprint and table: the bits left free and a hash of the bucket."""
    each = fps.select("fp", F.explode(F.array(*[F.lit(x).cast("long") for x in free_bits((1 << 64) - 1, radius)])).alias("free"))
    return each.select("fp", "free", F.xxhash64("free", F.col("fp").bitwiseAND(F.bitwise_not("free"))).alias("bucket"))


def _next_tables(rows: DataFrame, radius: int) -> DataFrame:
    """The same one level down, for fingerprints of large buckets."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for free, own in frame.groupby("free")["fp"]:
                left = np.array(free_bits(int(free) & (1 << 64) - 1, radius), dtype=np.int64)
                yield pd.DataFrame({"fp": np.repeat(own.to_numpy(), len(left)), "free": np.tile(left, len(own))})

    each = rows.select("fp", "free").mapInPandas(run, "fp long, free long")
    return each.select("fp", "free", F.xxhash64("free", F.col("fp").bitwiseAND(F.bitwise_not("free"))).alias("bucket"))


def _spanning(reach: int):
    """Edges of a least spanning forest of a bucket's pairs within reach: closest pairs first, fewer edges than fingerprints."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            a, b = [], []
            for members in frame["members"]:
                left = np.unique(np.asarray(members, dtype=np.int64)).view(np.uint64)
                one, left = left[0], left[1:]
                far, via = np.full(len(left), 65, dtype=np.uint8), np.zeros(len(left), dtype=np.uint64)
                while len(left):
                    d = np.bitwise_count(left ^ one)
                    via, far = np.where(d < far, one, via), np.minimum(d, far)
                    i = int(far.argmin())
                    one = left[i]
                    if far[i] <= reach:
                        a.append(via[i])
                        b.append(one)
                    left, far, via = np.delete(left, i), np.delete(far, i), np.delete(via, i)
            yield pd.DataFrame({"a": np.array(a, dtype=np.uint64).view(np.int64), "b": np.array(b, dtype=np.uint64).view(np.int64)})

    return run


def near_edges(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all fingerprint pairs within the radius.

    fps: distinct fingerprints in column fp. Buckets of up to `bucket` fingerprints are
    compared in one row; larger ones go down a level, at most twice.
    """
    found, rows = [], None
    for level in range(3):
        each = _next_tables(rows, radius) if rows is not None else _first_tables(fps, radius)
        sizes = each.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        small = sizes if level == 2 else sizes.filter(F.col("n") <= bucket)
        groups = each.select("fp", "bucket").join(small.select("bucket"), "bucket").groupBy("bucket").agg(F.collect_list("fp").alias("members"))
        found.append(groups.select("members").mapInPandas(_spanning(radius), "a long, b long"))
        if level < 2:
            large = sizes.filter(F.col("n") > bucket).select("bucket")
            rows = staged(each.join(large, "bucket", "left_semi").select("fp", "free").distinct(), "large-buckets")
            if rows.isEmpty():
                break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of a text's word shingles, as signed integers."""
    own = Words([text.encode().lower() if isinstance(text, str) else b""], NOT_SPACE)
    n = len(own.start)
    if not n:
        return np.zeros(0, dtype=np.int64)
    at = np.arange(max(1, n - words + 1))
    return np.unique(own.hashes(own.start[at], own.end[np.minimum(at + words - 1, n - 1)])).view(np.int64)


def simhash_groups(docs: DataFrame, words: int = 5, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) of every row: the smallest key that links of at most `radius` bits reach.

    A fingerprint's bit is 1 if it is set in over half of the XXH64 hashes of the word
    shingles; a text with fewer words is one shingle; null, empty and blank texts have
    fingerprint zero and link like any other. Rows with equal fingerprints are one node. A
    component of null keys alone has a null id. Long texts are hashed whole. Other columns,
    whatever their names, are ignored; no rows give no rows.
    """
    rows = staged(fingerprints(docs.select(key, text), words, text), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min(key).alias("least"))
    links = connected_components(near_edges(nodes.select("fp"), radius))
    rooted = nodes.join(links.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # a table of its own, so that Spark can split the join at the root of a very large component
    roots = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    named = staged(rooted.join(roots, "root").select("fp", "component_id"), "components")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select(key, shown.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose key is the smallest of their near-duplicate group, with the columns of docs.

    Nulls, empty and long texts and empty tables are as in simhash_groups, repeated keys as in keep_first.
    """
    return keep_first(docs, lambda own, k, t: simhash_groups(own, words, radius, k, t), key, text)


def keep_first(docs: DataFrame, groups: Callable[[DataFrame, str, str], DataFrame], key: str, text: str) -> DataFrame:
    """The rows of docs that are first in their group, with the columns of docs, whatever their names.

    groups: from a frame and the names of its key and text to (key, component_id), the smallest
    key of the row's group. Rows without a key can't be told apart and all stay. Where keys
    repeat, rows are numbered in the order of key and text first, so that each row is judged by
    its own text; of rows that repeat key and text one stays.
    """
    names = docs.columns
    own = docs.toDF(*[f"__{i}" for i in range(len(names))])
    at, body = f"__{names.index(key)}", f"__{names.index(text)}"
    if not own.filter(F.col(at).isNotNull()).groupBy(at).count().filter("count > 1").isEmpty():
        own = running_sums(own.withColumns({"__h": F.xxhash64(body), "__one": F.lit(1).cast("long")}), [at, "__h"], {"__id": "__one"})
        own, at = own.withColumn("__id", F.when(F.col(at).isNotNull(), F.col("__id"))), "__id"
    found = staged(groups(own.select(at, body), at, body), "groups")
    copies = found.filter(F.col(at) != F.col("component_id")).select(at)
    return own.join(copies, at, "left_anti").select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(names)])


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, by 3-word shingles and 3 bits."""
    return simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, radius=RADIUS)

"""Mixing sources to target weights with exact budgets in words.

Rows get hash-random keys. Their sizes, not their texts, are range-sorted by source and key;
distributed prefix sums tell at which key each source's budget ends. What leaves is one cut
per source. Sources themselves may be many: their turns and targets come from prefix sums too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import running_sums, staged, table, unstage, word_count

#: Bits of a hash key.
KEY_BITS = 62


def mix_key(key: Column, text: Column, seed: int) -> Column:
    """A hash-random key of 62 bits that rows with equal key and text share."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, text), 64 - KEY_BITS)


def source_targets(sizes: DataFrame, share: float, max_epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """Per source: its size, weight and target in words.

    Sources in code-point order, null last, get the weights in turn. Targets share `share` of
    all words by weight and stop at max_epochs times the source's size; what stays over goes to
    the others by weight until none is above. That is the level L with
    sum(min(weight x L, cap)) = total: sources reach their cap in the order of cap / weight, so
    running sums in that order give L directly. One row per source takes part.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"last": F.col("source").isNull(), "one": F.lit(1).cast("long")})
    turned = running_sums(per, ["last", "source"], {"turn": "one"})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("turn") - 1) % len(weights) + 1).cast("int"))
    per = turned.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("full_at", F.col("cap") / F.col("weight"))
    sums = running_sums(per, ["full_at", "last", "source"], {"caps": "cap", "weights": "weight"})
    every = sums.agg((F.sum("source_size") * float(share)).alias("total"), F.sum("weight").alias("all_weights"))
    level = (F.col("total") - (F.col("caps") - F.col("cap"))) / (F.col("all_weights") - (F.col("weights") - F.col("weight")))
    final = sums.join(F.broadcast(every)).select(F.when(level * F.col("weight") <= F.col("cap"), level).alias("level")).agg(F.max("level").alias("final"))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("final")))
    return sums.join(F.broadcast(final)).select("source", "source_size", "weight", target.alias("target"))


def source_cuts(sized: DataFrame, targets: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per source: whole epochs, the key at which the rest of the budget ends, words and rows of that key.

    sized: (source, size, mix_key). Rows that share a source and a key count as one.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.select("source", "source_size", "target", whole.alias("epochs"))
    plan = staged(plan.withColumn("rest", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long")), "mix-plan")
    keys = sized.groupBy("source", "mix_key").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    until = running_sums(keys, ["mix_key"], {"until": "words"}, "source", ranges)
    k, p = until.alias("k"), plan.select(F.col("source").alias("cut_source"), F.col("rest").alias("cut_rest")).alias("p")
    left = F.col("cut_rest") - F.col("until") + F.col("words")
    ends = (k.join(p, F.col("source").eqNullSafe(F.col("cut_source"))).filter((F.col("until") > F.col("cut_rest")) & (left >= 0))
            .select("cut_source", F.col("mix_key").alias("cut_key"), F.floor(left / F.col("n")).alias("cut_words")))
    return plan.join(ends, F.col("source").eqNullSafe(F.col("cut_source")), "left").select("source", "source_size", "target", "epochs", "cut_key", "cut_words")


def mix_sources(docs: DataFrame, share: float = 1.0, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17,
                rows_per_range: int | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row of docs with size, source_size, target, taken: the words that the mix takes of it.

    Every source's rows stand in the order of a seeded hash of key and text. The mix takes each
    row `epochs` times whole; of the last, partial epoch it takes rows in that order and ends
    inside the row at which the source's budget is used up. Rows that repeat key and text share
    a hash: a cut through them takes an equal part of each. Null or empty texts have size 0,
    long ones count whole, null sources are one source, an empty table gives an empty result.
    Columns of docs named like the new ones are replaced, others pass through, whatever their names. The order depends
    on rows and seed alone, so reruns agree. rows_per_range: rows of a range of the sort, by
    default what Spark's number of shuffle partitions gives.
    """
    new = ["size", "source_size", "target", "taken"]
    docs = docs.drop(*new)
    names = docs.columns
    own = docs.toDF(*[f"__{i}" for i in range(len(names))])
    key, text, source = (F.col(f"__{names.index(c)}") for c in (key, text, source))
    keyed = own.select(source.alias("source"), word_count(text).alias("size"), mix_key(key, text, seed).alias("mix_key"))
    sized = staged(keyed, "mix-sized")
    ranges = math.ceil(sized.count() / rows_per_range) or None if rows_per_range else None
    cuts = staged(source_cuts(sized, source_targets(sized, share, max_epochs, weights), ranges), "mix-cuts")
    unstage(sized)
    out = own.withColumns({"size": word_count(text), "mix_key": mix_key(key, text, seed)}).join(cuts.withColumnRenamed("source", "cut_source"), source.eqNullSafe(F.col("cut_source")), "left")
    part = (F.when(F.col("cut_key").isNull(), 0).when(F.col("mix_key") < F.col("cut_key"), F.col("size"))
            .when(F.col("mix_key") == F.col("cut_key"), F.least("size", "cut_words")).otherwise(0))
    out = out.withColumn("taken", (F.col("size") * F.col("epochs") + part).cast("long"))
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(names)], *new)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3 by source, at most three epochs each."""
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")

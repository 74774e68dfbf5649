"""Vector search, selection of context, and retrieval quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import cut_block
from ..sources.tables import staged
from .nearest import BLOCK, nearest_by_kind, search


def unit(vector: Column) -> Column:
    """a vector of length one; a zero vector stays."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.when(size == 0, 1.0).otherwise(size))


def top_k(queries: DataFrame, docs: DataFrame, k: int, skip_self: bool = False, block: int = BLOCK, lists: int | None = None) -> DataFrame:
    """(q, rank, doc, score) of the k documents of highest cosine for each query, ties by doc.

    queries, docs: (id, embedding), ids being unique. Exact: a block of documents is skipped
    only where the triangle inequality shows that none of them can be among the k best. Cosines
    are rounded to 9 places, so that equal vectors tie. A zero vector has the cosine 0 with
    everything; empty and null vectors are left out.
    """
    return search(queries, docs, k, skip_self, block, lists)[0]


def pruning(queries: DataFrame, docs: DataFrame, k: int, skip_self: bool = False, block: int = BLOCK, lists: int | None = None) -> DataFrame:
    """One row: queries, blocks, visits of blocks by queries, and the share of all such pairs that top_k skips."""
    _, visits, index = search(queries, docs, k, skip_self, block, lists)
    every = visits[0] if len(visits) == 1 else visits[0].unionByName(visits[1])
    pairs = queries.filter(F.size("embedding") > 0).agg(F.count("*").alias("n_queries")).withColumn("n_blocks", F.lit(len(index.rows)).cast("long"))
    return pairs.withColumn("n_visits", every.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()).withColumn("skipped", 1 - F.col("n_visits") / (F.col("n_queries") * F.col("n_blocks")))


def nearest_by_category(vectors: DataFrame, block: int = BLOCK, lists: int | None = None) -> DataFrame:
    """(q, same, other): cosine distance to the nearest other vector of the same category and to the nearest of another one; null where there is none.

    vectors: (id, category, embedding). Exact, with the pruning of top_k.
    """
    found = nearest_by_kind(vectors, block, lists)
    return found.select("q", (1 - F.col("same")).alias("same"), (1 - F.col("other")).alias("other"))


def merge_results(refined: DataFrame, original: DataFrame, k: int) -> DataFrame:
    """Best (lowest) score of each document of two result sets, the k best; of the original at most max(5, k / 2)."""
    both = refined.select("q", "doc", "score").unionByName(original.filter(F.col("rank") <= max(5, k // 2)).select("q", "doc", "score"))
    best = both.groupBy("q", "doc").agg(F.min("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("score", "doc"))).filter(F.col("rank") <= k)


def filter_scores(found: DataFrame, threshold: float | None = None, least: int = 2) -> DataFrame:
    """T4: (q, doc, score, rank) within a fixed threshold under 10, else within a margin of the best.

    The fixed threshold falls back to the first `least` documents only if none passes; the
    margin keeps at least that many.
    """
    by = Window.partitionBy("q")
    fixed = threshold is not None and threshold < 10
    best = F.min("score").over(by)
    limit = F.lit(threshold) if fixed else best + F.greatest(F.lit(0.20), F.abs(best) * 0.35)
    out = found.withColumns({"rank": F.row_number().over(by.orderBy("score", "doc")), "__in": F.col("score") <= limit})
    out = out.withColumn("__n", F.count_if("__in").over(by))
    return out.filter(F.col("__in") | ((F.col("__n") < (1 if fixed else least)) & (F.col("rank") <= least))).drop("__in", "__n")


def rerank(found: DataFrame, score: str | None, n: int) -> DataFrame:
    """T5: the n best by a second score, highest first; by rank where there is no score."""
    order = [F.desc_nulls_last(score), F.col("rank"), F.col("doc")] if score else [F.col("rank"), F.col("doc")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("rank") <= n)


def dominant_category(found: DataFrame, first: int = 8, least: int = 2) -> DataFrame:
    """The most frequent category of the first documents of each query, the earliest of equals; none under `least`."""
    counts = found.filter((F.col("rank") <= first) & F.col("category").isNotNull()).groupBy("q", "category").agg(F.count("*").alias("n"), F.min("rank").alias("at"))
    best = counts.groupBy("q").agg(F.max_by("category", F.struct(F.col("n"), -F.col("at"))).alias("category"), F.max("n").alias("n"))
    return best.filter(F.col("n") >= least)


def focus(found: DataFrame, questions: DataFrame, least: int = 2) -> DataFrame:
    """Documents of the dominant category, unless the question compares or too few would stay."""
    compares = questions.select("q", F.col("text").rlike("|".join(vocab.COMPARISON_WORDS)).alias("__compares"))
    lead = dominant_category(found).select("q", F.col("category").alias("__lead"))
    out = found.join(compares, "q", "left").join(lead, "q", "left")
    own = F.coalesce(F.col("category") == F.col("__lead"), F.lit(False))
    by = Window.partitionBy("q")
    out = out.withColumns({"__own": own, "__n": F.count("*").over(by), "__k": F.count_if(own).over(by)})
    free = (F.col("__n") <= least) | F.coalesce("__compares", F.lit(False)) | F.col("__lead").isNull() | (F.col("__k") < least)
    return out.filter(free | F.col("__own")).drop("__compares", "__lead", "__own", "__n", "__k")


def context_order(found: DataFrame) -> DataFrame:
    """Manuals before FAQ before guides before questions and answers, else as ranked."""
    place = F.lit(3)
    for kind, n in vocab.DOC_TYPE_ORDER.items():
        place = F.when(F.col("doc_type") == kind, n).otherwise(place)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(place, "rank", "doc")))


def diverse(found: DataFrame, most: int, group: tuple[str, ...] = ("source", "chapter", "title")) -> DataFrame:
    """No document twice, at most two of a group, at most `most` in all."""
    once = found.withColumn("__n", F.row_number().over(Window.partitionBy("q", "doc").orderBy("rank"))).filter("__n = 1")
    two = once.withColumn("__n", F.row_number().over(Window.partitionBy("q", *group).orderBy("rank", "doc"))).filter("__n <= 2").drop("__n")
    return two.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("rank", "doc"))).filter(F.col("rank") <= most)


def context_text(found: DataFrame) -> DataFrame:
    """one text a query: the documents in order, cut, with their head lines."""
    head = F.concat_ws("\n", F.concat(F.lit("[문서 "), F.col("rank").cast("string"), F.lit("]")), *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("")))
                       for c in ("doc_type", "doc_id", "source", "chapter", "category", "title")], cut_block(F.col("page_content")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", head.alias("shown"))))
    return found.groupBy("q").agg(F.array_join(F.transform(ordered, lambda x: x["shown"]), "\n\n").alias("context"))


def preview(found: DataFrame) -> DataFrame:
    """`rank:source/chapter/category` of each document."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.col("rank").cast("string"), F.lit(":"), F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "chapter", "category")])).alias("shown"))))
    return found.groupBy("q").agg(F.array_join(F.transform(ordered, lambda x: x["shown"]), " | ").alias("preview"))


def attribution(found: DataFrame) -> DataFrame:
    """the documents of a query in order, as structs."""
    return found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "source", "chapter", "category", "title", "doc_type"))).alias("docs"))


def hits(found: DataFrame, labels: DataFrame, names: tuple[str, ...], ks: tuple[int, ...]) -> DataFrame:
    """(label, k, hit, precision): whether, and how often, neighbours carry the query's label.

    found: (q, rank, doc); labels: (id, names...), one row an id.
    """
    a, b = labels.select(F.col("id").alias("q"), *[F.col(n).alias(f"q_{n}") for n in names]), labels.select(F.col("id").alias("doc"), *names)
    joined = found.join(a, "q").join(b, "doc")
    flags = joined.select("q", "rank", F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(n), F.coalesce(F.col(n) == F.col(f"q_{n}"), F.lit(False)).cast("int")) for n in names]))).alias("label", "same"))
    deep = flags.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("rank") <= F.col("k"))
    per = deep.groupBy("label", "k", "q").agg(F.max("same").alias("hit"), F.avg("same").alias("precision"))
    return per.groupBy("label", "k").agg(F.avg("hit").alias("hit"), F.avg("precision").alias("precision"))


def category_hits(found: DataFrame, labels: DataFrame, k: int = 5, least: int = 2) -> DataFrame:
    """Precision and hit at k for each category of at least `least` documents."""
    sizes = labels.groupBy("category").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= least)
    joined = found.filter(F.col("rank") <= k).join(labels.select(F.col("id").alias("q"), F.col("category").alias("own")), "q").join(labels.select(F.col("id").alias("doc"), "category"), "doc")
    per = joined.groupBy("own", "q").agg(F.max((F.col("own") == F.col("category")).cast("int")).alias("hit"), F.avg((F.col("own") == F.col("category")).cast("int")).alias("precision"))
    return per.groupBy(F.col("own").alias("category")).agg(F.avg("hit").alias("hit"), F.avg("precision").alias("precision")).join(sizes, "category")


#: Numbers of category sums that are held against the vectors in one pass.
SUMS = 1 << 21


def silhouette(vectors: DataFrame, sums_a_pass: int = SUMS) -> DataFrame:
    """Mean cosine silhouette over categories of more than one vector; null under two such categories.

    vectors: (id, category, embedding). The mean cosine distance of a vector to a category is
    1 - x . sum / n, so no pairs of vectors are formed. Sums of categories go to the tasks in
    blocks of bounded size, and every block is held against all vectors as a matrix product.
    """
    own = staged(vectors.select("id", "category", unit(F.col("embedding")).alias("x")).filter("category is not null"), "unit-vectors")
    parts = own.select("category", F.posexplode("x").alias("i", "v")).groupBy("category", "i").agg(F.sum("v").alias("s"))
    sums = (parts.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda t: t["s"]).alias("total"))
            .join(own.groupBy("category").agg(F.count("*").alias("n")).filter("n > 1"), "category"))
    sums = staged(sums, "category-sums")
    size = sums.agg(F.count("*").alias("n"), F.max(F.size("total")).alias("dims")).first()
    passes = max(1, -(-size["n"] * (size["dims"] or 1) // sums_a_pass))
    able, found = own.join(sums.select("category"), "category", "left_semi"), None
    for i in range(passes):
        held = sums.filter(F.pmod(F.xxhash64("category"), F.lit(passes)) == i).collect()
        if held:
            near = _to_categories(able, [r["category"] for r in held], np.array([r["total"] for r in held]), np.array([r["n"] for r in held]))
            found = near if found is None else found.unionByName(near)
    if found is None:
        found = able.select("id", F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b")).limit(0)
    per = found.groupBy("id").agg(F.max("a").alias("a"), F.min("b").alias("b"))
    return per.agg(F.when(F.count("b") > 0, F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"), F.count("*").alias("n"))


def _to_categories(vectors: DataFrame, names: list, totals: np.ndarray, sizes: np.ndarray) -> DataFrame:
    """(id, a, b): mean distance to the own category, if it is one of these, and the least to another of these."""
    place = {c: i for i, c in enumerate(names)}
    schema = f"id {vectors.schema['id'].dataType.simpleString()}, a double, b double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = np.array(frame["x"].tolist())
            dot = x @ totals.T
            own = np.array([place.get(c, -1) for c in frame["category"]])
            rows, far = np.arange(len(own)), 1 - dot / sizes
            mine = own >= 0
            # n - dot is the sum of distances, that to the vector itself too: 0, but 1 for a zero vector
            a = np.where(mine, (sizes[own] - dot[rows, own] - (1 - (x * x).sum(axis=1))) / (sizes[own] - 1), np.nan)
            far[rows[mine], own[mine]] = np.inf
            b = far.min(axis=1)
            yield pd.DataFrame({"id": frame["id"], "a": [None if np.isnan(v) else v for v in a], "b": [v if np.isfinite(v) else None for v in b]})

    return vectors.mapInPandas(run, schema)


def distance_histogram(nearest: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """Rows of each of equal bins, empty ones too."""
    place = F.least(F.greatest(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)), F.lit(1)), F.lit(bins)).cast("long")
    counts = nearest.filter(F.col(value).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return nearest.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin").join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def composition(docs: DataFrame) -> DataFrame:
    """Documents, sources of each category."""
    return docs.groupBy("category").agg(F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_sources"))


def judge_summary(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean scores, rates and rows."""
    rate = lambda c: F.avg(F.col(c).cast("int"))
    return rows.groupBy(*keys).agg(F.avg("faithfulness").alias("faithfulness"), F.avg("relevance").alias("relevance"), F.avg("alignment").alias("alignment"),
                                   rate("hallucination").alias("hallucination_rate"), rate("source_hit").alias("source_hit_rate"), rate("chapter_hit").alias("chapter_hit_rate"), F.count("*").alias("n"))


def score_histogram(rows: DataFrame, columns: tuple[str, ...] = ("faithfulness", "relevance", "alignment")) -> DataFrame:
    """Rows of each score 1 to 5 and measure, zeros too."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("int").alias("score")) for c in columns])).alias("x")).select("x.*")
    grid = rows.sparkSession.createDataFrame([(c, s) for c in columns for s in range(1, 6)], "measure string, score int")
    return grid.join(long.groupBy("measure", "score").agg(F.count("*").alias("n")), ["measure", "score"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def funnel(retrieved: DataFrame, filtered: DataFrame, final: DataFrame, top: int = 10) -> DataFrame:
    """Per query, documents retrieved, filtered and final, final categories and document types in order, and the scores of the first `top` retrieved.

    Documents without a type are `unknown`, those without a category have an empty one.
    """
    n = lambda df, name: df.groupBy("q").agg(F.count("*").alias(name))
    kind = F.coalesce(F.col("doc_type"), F.lit("unknown")) if "doc_type" in final.columns else F.lit("unknown")
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.coalesce(F.col("category").cast("string"), F.lit("")).alias("category"), kind.alias("kind"))))
    joined = lambda name: F.array_join(F.transform(ordered, lambda x: x[name]), "|")
    last = final.groupBy("q").agg(F.count("*").alias("n_final"), joined("category").alias("categories"), joined("kind").alias("doc_types"))
    scores = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc", "score"))), lambda x: F.concat_ws(":", x["doc"].cast("string"), F.format_number(x["score"], 6))), "|")
    first = retrieved.filter(F.col("rank") <= top).groupBy("q").agg(scores.alias("scores"))
    out = n(retrieved, "n_retrieved").join(n(filtered, "n_filtered"), "q", "left").join(last, "q", "left").join(first, "q", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_filtered", "n_final")})


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """N rows by a seeded hash of the key, in key order. A sampling operator: n is its feature."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n).orderBy(key)


def judge_rows(rows: DataFrame) -> DataFrame:
    """flat judge rows with whether the reference source and chapter are among the retrieved (array of structs)."""
    return rows.select("*", F.coalesce(F.exists("retrieved", lambda r: r["source"].eqNullSafe(F.col("source"))), F.lit(False)).alias("source_hit"),
                       F.coalesce(F.exists("retrieved", lambda r: r["chapter"].eqNullSafe(F.col("chapter"))), F.lit(False)).alias("chapter_hit"))

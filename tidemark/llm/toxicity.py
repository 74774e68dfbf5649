"""Toxicity through a chain of linear classifiers.

Categories are predicted one after the other. The model of a category sees the words of the
text and the probabilities of all earlier categories; in training these come from models that
did not see the row (out of fold), so that later links learn from honest probabilities.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import least_hashes, map_texts, staged, table
from .word_arrays import ALNUM, Words, batches

#: Hash buckets of words and word beginnings, lengths of beginnings in bytes, rows of the training sample, folds.
BUCKETS, PREFIXES, SAMPLE_ROWS, FOLDS = 1 << 18, (3, 4, 5), 8000, 3
#: Least deviation of a feature from chance to enter a model, and most features of a model.
LEAST_Z, MOST_FEATURES = 5.0, 2000
#: The chain of the query: label columns in order.
CHAIN = ("quality", "toxic")


def features(texts: list, limit: int = 1 << 19, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For consecutive texts: first number, how many, and the distinct (text, bucket) of words and word beginnings; only wanted buckets, if given."""
    for start, raws in batches(texts, limit):
        words = Words(raws, ALNUM)
        found = []
        for n in (0, *PREFIXES):
            long = np.flatnonzero(words.end - words.start > n) if n else slice(None)
            first, last, text = words.start[long], words.end[long], words.text[long]
            h = words.hashes(first, first + n if n else last) + np.uint64(n)
            bucket = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)
            if wanted is not None:
                text, bucket = text[wanted[bucket]], bucket[wanted[bucket]]
            found.append(text * BUCKETS + bucket)
        both = np.unique(np.concatenate(found))
        yield start, len(raws), both // BUCKETS, both % BUCKETS


class Link:
    """One category's model: selected buckets, their weights, weights of earlier probabilities, bias."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, earlier: np.ndarray, bias: float):
        self.buckets, self.weights, self.earlier, self.bias = buckets, weights, earlier, bias

    def probability(self, dense: np.ndarray, before: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(dense @ self.weights + before @ self.earlier + self.bias, -30, 30)))


def select(text: np.ndarray, bucket: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Buckets that stand in positive rows more often than chance would have it."""
    n, share = len(y), y.mean()
    if not 0 < share < 1:
        return np.zeros(0, dtype=np.int64)
    held = np.bincount(bucket, minlength=BUCKETS)
    positive = np.bincount(bucket, weights=y[text], minlength=BUCKETS)
    spread = np.sqrt(np.maximum(held * share * (1 - share) * (n - held) / max(1, n - 1), 1e-9))
    z = np.where(held > 1, (positive - held * share) / spread, 0)
    best = np.argsort(-z, kind="stable")[:MOST_FEATURES]
    return np.sort(best[z[best] >= LEAST_Z])


def dense_rows(n: int, text: np.ndarray, bucket: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    place = np.searchsorted(buckets, bucket)
    place[place == len(buckets)] = 0
    own = buckets[place] == bucket if len(buckets) else np.zeros(len(bucket), dtype=bool)
    x = np.zeros((n, len(buckets)), dtype=np.float32)
    x[text[own], place[own]] = 1
    return x


def fit_link(n: int, text: np.ndarray, bucket: np.ndarray, y: np.ndarray, before: np.ndarray, rows: np.ndarray, steps: int = 500, decay: float = 1e-4) -> Link:
    """Logistic regression on the given rows (a mask)."""
    number = np.cumsum(rows) - 1
    own = rows[text]
    text, bucket, y, before, n = number[text[own]], bucket[own], y[rows], before[rows], int(rows.sum())
    buckets = select(text, bucket, y)
    x = np.hstack([dense_rows(n, text, bucket, buckets), before]).astype(np.float64)
    w, m, v = (np.zeros(x.shape[1] + 1) for _ in range(3))
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        g = np.append(x.T @ (p - y) / n + decay * w[:-1], (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    k = len(buckets)
    return Link(buckets, w[:k], w[k:-1], float(w[-1]))


def fit_chain(texts_features: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS) -> list[Link]:
    """One link for each column of labels; a null label (NaN) leaves the row out of that link's fit."""
    n = len(labels)
    text, bucket = np.repeat(np.arange(n), [len(f) for f in texts_features]), np.concatenate(texts_features)
    fold, links, before = np.arange(n) % folds, [], np.zeros((n, 0))
    for c in range(labels.shape[1]):
        known = ~np.isnan(labels[:, c])
        y = np.nan_to_num(labels[:, c])
        links.append(fit_link(n, text, bucket, y, before, known))
        if c + 1 < labels.shape[1]:
            p = np.zeros(n)
            for k in range(folds):
                part = fit_link(n, text, bucket, y, before, known & (fold != k))
                p[fold == k] = part.probability(dense_rows(n, text, bucket, part.buckets), before)[fold == k]
            before = np.column_stack([before, p])
    return links


def train(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...] = CHAIN, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> list[Link] | None:
    """The chain's models from a sample of labelled documents: those whose keys have the sample_rows smallest hashes.

    The sample's bounded size lets it be broadcast to the documents, and one task fit on it.
    Keys labelled more than once take the largest label; of documents that share a sampled key
    the text with the smallest hash is learned from. Null keys take no part, null labels leave a
    document out of that link, null and empty texts have no words, long texts count whole. None
    where no document is labelled.
    """
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(*[F.max(c).cast("double").alias(f"y{i}") for i, c in enumerate(chain)])
    marks = staged(marks, "labels")
    own = docs.select(F.col(key).alias("__key"), F.col(text).alias("text"))
    able = marks.select("__key").join(own.select("__key"), "__key", "left_semi")
    sampled = least_hashes(able, "__key", sample_rows).select(F.col("text").alias("__key"))
    sample = marks.join(F.broadcast(sampled), "__key", "left_semi")
    if sample.isEmpty():
        return None
    one = own.join(F.broadcast(sampled), "__key", "left_semi").groupBy("__key").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    own = one.join(F.broadcast(sample), "__key")
    names = [f"y{i}" for i in range(len(chain))]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for _, size, text, bucket in features(frame["text"].tolist()):
                found += [x.astype("<i4").tobytes() for x in np.split(bucket, np.searchsorted(text, np.arange(1, size)))]
            yield frame[["__key", *names]].assign(found=found)

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if parts:
            frame = pd.concat(parts, ignore_index=True)
            frame = frame.sort_values(["__key", "found"], kind="stable")
            links = fit_chain([np.frombuffer(x, "<i4").astype(np.int64) for x in frame["found"]], frame[names].to_numpy(dtype=float))
            yield pd.DataFrame({"model": [pickle.dumps([(x.buckets, x.weights, x.earlier, x.bias) for x in links])]})

    kind = own.schema["__key"].dataType.simpleString()
    schema = f"__key {kind}, " + "".join(f"{c} double, " for c in names) + "found binary"
    fitted = map_texts(own, count, schema).repartition(1).mapInPandas(fit, "model binary").collect()
    if not fitted:
        raise RuntimeError("the sample of labelled documents is empty")
    return [Link(*x) for x in pickle.loads(fitted[0]["model"])]


def score(docs: DataFrame, model: list[Link] | None, chain: tuple[str, ...] = CHAIN, text: str = "text", drop_text: bool = False) -> DataFrame:
    """docs with p_<category> for each category of the chain.

    Columns of these names are replaced; all others pass through, whatever their names. Whole
    texts count; null and empty ones have no words and get the models' base rates; without a
    model all probabilities are 0. Rows repeat as in docs; no rows give no rows.
    """
    new = [f"p_{c}" for c in chain]
    docs = docs.drop(*new)
    others = [c for c in docs.columns if c != text or not drop_text]
    schema = docs.select(*[F.col(f"`{c}`") for c in others], *[F.lit(0.0).alias(c) for c in new]).schema
    wanted = np.zeros(BUCKETS, dtype=bool)
    for link in model or ():
        wanted[link.buckets] = True

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            p = np.zeros((len(frame), len(chain)))
            for start, size, own, bucket in features(frame[text].tolist(), wanted=wanted) if model else ():
                for c, link in enumerate(model):
                    x = dense_rows(size, own, bucket, link.buckets)
                    p[start:start + size, c] = link.probability(x, p[start:start + size, :c])
            yield frame[others].assign(**{name: p[:, c] for c, name in enumerate(new)})

    return map_texts(docs, run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, chain: tuple[str, ...] = CHAIN) -> DataFrame:
    """The rows of docs whose last category stays under the threshold, with the columns of docs.

    Without a labelled document nothing is known and all rows stay. Null, empty and long texts,
    repeated rows, null keys and empty tables are as in train and score; docs may have columns
    named like the new ones, which come back as they were.
    """
    names = docs.columns
    own = docs.toDF(*[f"__{i}" for i in range(len(names))])
    kept = score(own, train(docs, labels, chain), chain, text=f"__{names.index('text')}").filter(F.col(f"p_{chain[-1]}") < threshold)
    return kept.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(names)])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities of low or high quality and of toxicity, and whether it is rejected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, drop_text=True).select("doc_id", "p_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))

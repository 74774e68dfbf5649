"""Language identification with error-correcting output codes.

Each language gets a code word of several bits; a linear classifier on hashed byte n-grams
predicts each bit. The language whose code word loses least against all bit margins wins, and
a small gap to the runner-up flags the text as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import least_hashes, map_texts, table
from .word_arrays import batches

#: Hash buckets of n-grams, n-gram sizes in bytes, rows of the training sample, gap in loss under which a text is ambiguous.
BUCKETS, SIZES, SAMPLE_ROWS, AMBIGUOUS = 1 << 13, (2, 3), 3000, 0.5
#: Languages that are learned, the most frequent first, and texts of each at least.
LEAST_TEXTS = 2
LETTER = regex.compile(r"\p{L}")
_KEEP = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)


def code_words(classes: int, seed: int = 5) -> np.ndarray:
    """Rows of +1 and -1, one for each class: the exhaustive code up to 5 classes, else the best of random codes."""
    if classes == 1:
        return np.ones((1, 1))
    if classes <= 5:
        cols = [(1,) + c for c in itertools.product((1, -1), repeat=classes - 1) if -1 in c]
        return np.array(cols, dtype=float).T
    rng, bits, best, most = np.random.default_rng(seed), 15 + 5 * int(np.ceil(np.log2(classes))), None, -1
    for _ in range(50 if classes <= 256 else 5):
        code = rng.choice([-1.0, 1.0], size=(classes, bits))
        apart = ((bits - code @ code.T) / 2 + bits * np.eye(classes)).min()
        if apart > most and (abs(code.sum(axis=0)) < classes).all():
            best, most = code, apart
    return best


def ngram_rows(texts: list, limit: int = 1 << 18) -> Iterator[np.ndarray]:
    """For consecutive texts, rows of square roots of n-gram shares, of length one."""
    for _, raws in batches(texts, limit):
        own = np.frombuffer(b"\n\n".join(raws) + b"\n\n\n", dtype=np.uint8)
        chars = _KEEP[own]
        sizes = np.array([len(r) for r in raws])
        begin = np.concatenate(([0], np.cumsum(sizes + 2)[:-1]))
        text = np.repeat(np.arange(len(raws)), sizes)
        place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
        total = np.zeros((len(raws), BUCKETS), dtype=np.float32)
        for n in SIZES:
            gram = np.full(len(chars) - n + 1, n, dtype=np.uint32)
            for j in range(n):
                gram = gram * np.uint32(0x01000193) ^ chars[j:len(chars) - n + 1 + j]
            gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            bucket = (gram >> np.uint32(19)).astype(np.int64)
            total += np.bincount(text * BUCKETS + bucket[place], minlength=len(raws) * BUCKETS).reshape(-1, BUCKETS)
        norm = total.sum(axis=1, keepdims=True)
        yield np.sqrt(total / np.maximum(norm, 1))


def fit_bits(x: np.ndarray, y: np.ndarray, code: np.ndarray, steps: int = 150, decay: float = 1e-4) -> np.ndarray:
    """Weights (features + 1, bits) of one logistic classifier for each bit; classes weigh equally."""
    want = code[y]
    share = (len(y) / np.maximum(np.bincount(y, minlength=len(code)), 1) / len(code))[y][:, None] / len(y)
    want, share = want.astype(np.float32), share.astype(np.float32)
    w, m, v = (np.zeros((x.shape[1] + 1, code.shape[1]), dtype=np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        margin = np.clip(want * (x @ w[:-1] + w[-1]), -30, 30)
        slope = -want / (1 + np.exp(margin)) * share
        g = np.vstack([x.T @ slope + np.float32(decay) * w[:-1], slope.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, score between 0 and 1, and gap in loss to the second class, by logistic loss over all bits.

    log(1 + exp(-c m)) is log(1 + exp(m)) less m where c is 1, so one product gives all losses.
    """
    loss = np.logaddexp(0, margins).sum(axis=1, keepdims=True) - margins @ ((code.T + 1) / 2)
    order = np.sort(loss, axis=1)
    shares = np.exp(order[:, :1] - loss)
    gap = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
    return loss.argmin(axis=1), 1 / shares.sum(axis=1), gap


def held_out(key: Column) -> Column:
    """True where crc32 of the key as text is 2 modulo 4; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, most_languages: int | None = None) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """(languages, code, weights) from (text, lang) rows; None where no row has both a language and a letter.

    The sample holds sample_rows different texts, of equal number for each language, but at least
    LEAST_TEXTS of each; a language with fewer gives all it has. Copies of a text count once. Its
    n-grams are counted where the rows are; one task fits on them. Every value of `lang` is
    learned; with most_languages only so many, the most frequent, ties by name, and texts of
    the others are predicted as one of these. Long texts count whole; repeated rows change nothing.
    """
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang")
    languages = sorted(r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages or 2**31 - 1).collect())
    if not languages:
        return None
    known = rows if not most_languages or len(languages) < most_languages else rows.join(F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in languages], "lang string")), "lang", "left_semi")
    sample = least_hashes(known, "text", max(LEAST_TEXTS, sample_rows // len(languages)), "lang").withColumnRenamed("kind", "lang")
    code, number = code_words(len(languages)), {lang: i for i, lang in enumerate(languages)}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [row for part in ngram_rows(frame["text"].tolist()) for row in part]
            yield pd.DataFrame({"y": frame["lang"].map(number), "at": [np.flatnonzero(r).astype("<i4").tobytes() for r in rows], "x": [r[r > 0].astype("<f4").tobytes() for r in rows]})

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if parts:
            frame = pd.concat(parts, ignore_index=True)
            x = np.zeros((len(frame), BUCKETS), dtype=np.float32)
            for i, (at, v) in enumerate(zip(frame["at"], frame["x"])):
                x[i, np.frombuffer(at, "<i4")] = np.frombuffer(v, "<f4")
            order = np.lexsort((x @ np.arange(BUCKETS, dtype=np.float32), frame["y"]))  # the same sums in any order of rows
            yield pd.DataFrame({"w": [fit_bits(x[order], frame["y"].to_numpy()[order], code).astype("<f4").tobytes()]})

    fitted = map_texts(sample.select("text", "lang"), count, "y int, at binary, x binary").repartition(1).mapInPandas(fit, "w binary").collect()
    if not fitted:
        raise RuntimeError("the sample of labelled texts is empty")
    return languages, code, np.frombuffer(fitted[0]["w"], "<f4").reshape(BUCKETS + 1, -1)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray] | None, key: str = "doc_id", text: str = "text", ambiguous: float = AMBIGUOUS) -> DataFrame:
    """(key, lang_pred, score, ambiguous) of every row, from its whole text alone.

    `und` with score 0 where the text is null, empty or has no letter (Unicode category L), or
    without a model. Of equal losses the language first in code-point order is taken. Long texts
    count whole. Rows repeat as in docs, null keys too; an empty table gives an empty result;
    other columns, whatever their names, are ignored.
    """
    schema = docs.select(key, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            able = frame[text].map(lambda t: isinstance(t, str) and LETTER.search(t) is not None).to_numpy(dtype=bool)
            lang, score, doubt = np.full(len(frame), "und", dtype=object), np.zeros(len(frame)), np.ones(len(frame), dtype=bool)
            if model and able.any():
                languages, code, w = model
                margins = np.concatenate([x @ w[:-1] + w[-1] for x in ngram_rows(frame[text][able].tolist())])
                best, share, gap = decode(margins, code)
                lang[able], score[able], doubt[able] = np.array(languages, dtype=object)[best], share, gap < ambiguous
            yield pd.DataFrame({key: frame[key], "lang_pred": lang, "score": score, "ambiguous": doubt})

    return map_texts(docs.select(key, text), run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")

"""Spelling variants: words one insertion, deletion or replacement apart, by dense tiles of code points.

Two words that are one edit apart agree in the first or in the last half of the shorter one, so
words meet in buckets of equal halves; a bucket that is too large is divided again by halves of
what is still free, down to one code point. Within a bucket a padded code-point matrix of its
words is held against itself tile by tile: a pair is one edit apart if common prefix and common
suffix together reach the longer length less one. A pair counts in one bucket alone, so what
leaves a bucket is one row a word, with the number of its near words and the best of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_texts, staged, table, unstage

#: Runs of letters; code points and occurrences that a word has at least; times a form's count exceeds that of its variant.
LETTERS = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Words of a bucket above which it is divided again, code points of a tile's pairs and of a matrix.
BUCKET, TILE, CELLS = 512, 1 << 21, 1 << 22
NEAR = "word string, n_near long, best_n long, best string"


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, upper, lower))


def letter_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, run) for every maximal run of letters in a text, A-Z lower-cased; null texts have none."""
    every = docs.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(LETTERS), F.lit(0))).alias("run"))
    return every.select("key", lower_ascii(F.col("run")).alias("run"))


def word_counts(runs: DataFrame, word: Column, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least `length` code points that occur at least `count` times."""
    return runs.select(word.alias("word")).filter(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count)


def _divided(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, a, b, top) twice: with the first half of what is free fixed, and with the last.

    m is the shorter length of the pairs that are looked for, a and b the code points fixed at
    both ends; pairs that agree in their first `top` code points belong to another bucket.
    """
    free = F.col("m") - F.col("a") - F.col("b")
    half = F.floor(free / 2).cast("int")
    front = F.struct((F.col("a") + half).alias("a"), F.col("b"), F.col("top"))
    back = F.struct(F.col("a"), (F.col("b") + free - half).alias("b"), (F.col("a") + half).alias("top"))
    return rows.withColumn("x", F.explode(F.array(front, back))).select("word", "n", "m", "x.*")


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with their bucket: lengths and the fixed ends of the word, which a space parts as words have none."""
    ends = [F.substring(F.col("word"), F.lit(1), F.col("a")), F.substring(F.col("word"), F.length("word") - F.col("b") + 1, F.col("b"))]
    return rows.withColumn("bucket", F.concat_ws(" ", "m", "a", "b", "top", *ends))


def _buckets(words: DataFrame, most: int) -> list[DataFrame]:
    """Frames of (bucket, word, n, m, top); all words of a bucket are in one frame, at most `most` of them or alike in all but one place of the shorter words."""
    length = F.length("word")
    start = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1 << 30).alias("top"))
    now, done = staged(_keyed(_divided(start)), "buckets"), []
    while True:
        sizes = now.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1")
        # a word that is alone in its bucket has no partner there
        sized = staged(now.join(sizes, "bucket"), "sized-buckets")
        unstage(now)
        divisible = (F.col("c") > most) & (F.col("m") - F.col("a") - F.col("b") > 1)
        done.append(sized.filter(~divisible).select("bucket", "word", "n", "m", "top"))
        large = sized.filter(divisible)
        if large.isEmpty():
            return done
        now = staged(_keyed(_divided(large)), "buckets")


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded code points of words from the front and from the back, and lengths; pads differ from any code point."""
    size = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    first = np.cumsum(size) - size
    step = np.arange(size.max())
    inside = step < size[:, None]
    front = np.where(inside, flat[np.minimum(first[:, None] + step, len(flat) - 1)], 0)
    back = np.where(inside, flat[np.maximum(first[:, None] + size[:, None] - 1 - step, 0)], 0)
    return front, back, size


def _common(x: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Code points in which rows i and j agree from the left; beyond the shorter word nothing does."""
    same = x[i] == x[j]
    same[np.arange(x.shape[1]) >= size[:, None]] = False
    return np.where(same.all(axis=1), x.shape[1], same.argmin(axis=1))


def _tile_pairs(count: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of rows of one bucket, about `limit` at a time; buckets lie one after the other, of the given sizes."""
    first = np.cumsum(count) - count
    row = np.arange(count.sum())
    later = np.repeat(first + count, count) - row - 1
    sums = np.concatenate(([0], np.cumsum(later)))
    at = 0
    while at < len(row):
        until = max(at + 1, int(np.searchsorted(sums, sums[at] + limit, "right")) - 1)
        n = later[at:until]
        i = np.repeat(row[at:until], n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = until


def near_in_buckets(bucket: np.ndarray, word: list[str], n: np.ndarray, m: np.ndarray, top: np.ndarray, tile: int = TILE) -> pd.DataFrame:
    """For words sorted by bucket: a row (word, n_near, best_n, best) for each that has a near word in its bucket."""
    front, back, size = _codes(word)
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    count = np.diff(np.append(starts, len(bucket)))
    a, b = [], []
    for i, j in _tile_pairs(count, max(1, tile // front.shape[1])):
        short, long = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        able = (short == m[i]) & (long - short <= 1)
        i, j, short, long = i[able], j[able], short[able], long[able]
        prefix = _common(front, i, j, short)
        near = (prefix < top[i]) & (prefix + _common(back, i, j, short) >= long - 1)
        a += [i[near], j[near]]
        b += [j[near], i[near]]
    one, other = np.concatenate([*a, np.zeros(0, dtype=np.int64)]).astype(np.int64), np.concatenate([*b, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    names = np.array(word, dtype=object)
    order = np.lexsort((names[other], -n[other], one)) if len(one) else np.zeros(0, dtype=np.int64)
    one, other = one[order], other[order]
    begin = np.flatnonzero(np.concatenate(([True], one[1:] != one[:-1]))) if len(one) else np.zeros(0, dtype=np.int64)
    return pd.DataFrame({"word": names[one[begin]], "n_near": np.diff(np.append(begin, len(one))), "best_n": n[other[begin]], "best": names[other[begin]]})


def near_words(words: DataFrame, bucket: int = BUCKET, tile: int = TILE) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have a near one; words: (word, n), one row a word."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            rest = frame if rest is None or rest.empty else pd.concat([rest, frame], ignore_index=True)
            last = int((rest["bucket"] == rest["bucket"].iloc[-1]).to_numpy().argmax())  # the last bucket may go on in the next batch
            whole, rest = rest.iloc[:last], rest.iloc[last:].reset_index(drop=True)
            yield from found(whole)
        if rest is not None:
            yield from found(rest)

    def found(own: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Whole buckets, which come by length, in matrices of bounded size."""
        bucket, m = own["bucket"].to_numpy(dtype=object), own["m"].to_numpy(dtype=np.int64)
        starts = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(own)) if len(own) else np.zeros(1, dtype=np.int64)
        first = 0
        for at, until in zip(starts[:-1], starts[1:]):
            if at > first and (until - first) * (m[at] + 1) > CELLS:
                yield one(own.iloc[first:at])
                first = at
        if len(own):
            yield one(own.iloc[first:])

    def one(own: pd.DataFrame) -> pd.DataFrame:
        return near_in_buckets(own["bucket"].to_numpy(dtype=object), own["word"].tolist(), *(own[c].to_numpy(dtype=np.int64) for c in ("n", "m", "top")), tile)

    parts = [map_texts(b.repartition("bucket").sortWithinPartitions("m", "bucket"), run, NEAR, rows=1 << 14) for b in _buckets(words, bucket)]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("x")
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("x.minus")).alias("best_n"), F.col("x.best").alias("best"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root): where chains of (word, form) end; each round follows twice as many links."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = staged(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        unstage(now)
        now = after
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def group_variants(words: DataFrame, ratio: float = RATIO, bucket: int = BUCKET, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word.

    words: (word, n), one row a word, words without spaces, of any length; other columns are
    ignored, null words left out, no rows give no rows. Near words differ by exactly one
    inserted, deleted or replaced code point. A word's form is its near word of largest n, the
    smallest of equals, if that n is at least `ratio` times the word's (which makes chains end
    for a ratio over 1); root is the last of the chain of forms, the word itself without one.
    All near words count, however many a bucket holds.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its variant")
    own = staged(words.select("word", F.col("n").cast("long").alias("n")).filter("word is not null"), "words")
    near = own.join(near_words(own, bucket, tile), "word", "left")
    has = F.col("best_n") >= F.col("n") * ratio
    found = staged(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "forms")
    roots = roots_of(found.filter("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def with_slips(runs: DataFrame, every: int = 97) -> Column:
    """The run of (key, run) rows, short of one code point where `every` divides the crc32 of `key:run`; a null key counts as empty text."""
    h = F.crc32(F.concat(F.coalesce(runs["key"].cast("string"), F.lit("")), F.lit(":"), runs["run"]).cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return F.when(h % every == 0, cut).otherwise(F.col("run"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some with a slip, with the more frequent words that they vary.

    Null texts have no words; rows that repeat count as often as they stand there.
    """
    runs = letter_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return group_variants(word_counts(runs, with_slips(runs)))


OP11_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM runs GROUP BY doc_id, run),
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, [('0x' || code[2 * i - 1:2 * i])::BIGINT for i in range(1, length(code) // 2 + 1)]), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]))) AS h
  FROM counted, crc_table),
words AS (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT c, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS gone FROM places),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.gone = b.gone AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.gone = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.gone = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS form_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n,
    CASE WHEN b.form_n >= 2 * w.n THEN (SELECT min(x.other) FROM near x WHERE x.word = w.word AND x.other_n = b.form_n) END AS form
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
  WITH RECURSIVE c(word, place) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM c JOIN forms f ON f.word = c.place WHERE f.form IS NOT NULL)
  SELECT c.word, c.place AS root FROM c JOIN forms f ON f.word = c.place WHERE f.form IS NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word
"""

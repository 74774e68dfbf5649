"""Benchmark decontamination with suffix arrays over shards of training text.

Each task cuts its documents into shards and builds, for each, the sorted array of the
suffixes that can start a match: suffixes whose first words open some benchmark window. Every
benchmark suffix is then located in it by binary search, and hits that follow each other in a
document and in an item join to the longest match of the two, with its place in both. Only the
benchmark travels, in blocks of bounded size; documents stay where they were read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_texts, running_sums, staged, table
from .word_arrays import ALNUM, Words, batches, mixed

#: Words of a window, bytes of a shard, and bytes of benchmark text in a block that is sent to all tasks.
WINDOW, SHARD_BYTES, BLOCK_BYTES = 10, 1 << 19, 8 << 20
_TABLE = 1 << 22
MATCHES = "array<struct<item:string,item_first:int,first:int,last:int>>"


def _opening(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words that start at each position."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = mixed(out + h[j:j + n])
    return out


def _rows(h: np.ndarray, at: np.ndarray, stop: np.ndarray, width: int) -> np.ndarray:
    """Suffixes as byte strings that sort like their words; words from `stop` on count as nothing."""
    place = at[:, None] + np.arange(width)
    rows = h[np.minimum(place, len(h) - 1)]
    rows[place >= stop[:, None]] = 0
    return np.ascontiguousarray(rows.astype(">u8")).view(f"S{8 * width}").ravel()


def _same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether words i of a and j of b have equal bytes, pair by pair."""
    same = a.end[i] - a.start[i] == b.end[j] - b.start[j]
    at = np.flatnonzero(same)
    for k in range(0, len(at), 1 << 17):
        own = at[k:k + (1 << 17)]
        size = a.end[i[own]] - a.start[i[own]]
        first = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(first, size)
        same[own] = np.logical_and.reduceat(a.buf[np.repeat(a.start[i[own]], size) + step] == b.buf[np.repeat(b.start[j[own]], size) + step], first)
    return same


class BenchmarkBlock:
    """Distinct windows of some benchmark items, as sorted suffix rows with the items that hold them and where."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.ids = window, [i for i, _ in items]
        self.words = words = Words([t.encode().lower() for _, t in items] or [b""], ALNUM)
        self.h = h = words.hashes()
        count = words.count
        size = np.minimum(window, count)
        windows = np.where(count > 0, count - size + 1, 0)
        self.empty = not windows.sum()
        if self.empty:
            return
        owner = np.repeat(np.arange(len(items)), windows)
        place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        at, size = words.first[owner] + place, size[owner]
        rows = _rows(h, at, at + size, window)
        self.rows, pick, which = np.unique(rows, return_index=True, return_inverse=True)
        which = which.ravel()
        self.size, self.at = size[pick], at[pick]
        top = np.frombuffer(self.rows.tobytes(), dtype=np.uint8).reshape(-1, 8 * window).copy()
        top[np.arange(8 * window) >= 8 * self.size[:, None]] = 255
        self.top = top.view(f"S{8 * window}").ravel()
        order = np.lexsort((place, owner, which))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (np.diff(which[order]) != 0) | (np.diff(owner[order]) != 0)
        #: items that hold one window twice, in which a run of hits may not be the longest match yet
        self.folded = np.zeros(len(items), dtype=bool)
        self.folded[owner[order[~first]]] = True
        held = order[first]
        self.owner, self.place = owner[held], place[held]
        self.begin = np.searchsorted(which[held], np.arange(len(self.rows) + 1))
        self.opens = {}
        for k in sorted({min(3, int(n)) for n in np.unique(self.size)}):
            seen = np.zeros(_TABLE, dtype=bool)
            seen[_opening(h, k)[at[np.minimum(size, 3) == k]] & np.uint64(_TABLE - 1)] = True
            self.opens[k] = seen

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a shard's words at which a window occurs, with the window's number."""
        none = np.zeros(0, dtype=np.int64)
        if self.empty or not len(words.start):
            return none, none
        h = words.hashes()
        able = np.zeros(len(h), dtype=bool)
        for k, seen in self.opens.items():
            opening = _opening(h, k)
            able[:len(opening)] |= seen[opening & np.uint64(_TABLE - 1)]
        at = np.flatnonzero(able)
        if not len(at):
            return none, none
        stop = (words.first + words.count)[words.text[at]]
        rows = _rows(h, at, stop, self.window)
        order = np.argsort(rows, kind="stable")  # the suffix array of the shard
        rows, at, stop = rows[order], at[order], stop[order]
        low, high = np.searchsorted(rows, self.rows, "left"), np.searchsorted(rows, self.top, "right")
        found = np.flatnonzero(high > low)
        if not len(found):
            return none, none
        hits = (high - low)[found]
        place = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low[found], hits)
        window = np.repeat(found, hits)
        able = at[place] + self.size[window] <= stop[place]
        pos, window = at[place[able]], window[able]
        size = self.size[window]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        same = _same_words(words, np.repeat(pos, size) + step, self.words, np.repeat(self.at[window], size) + step)
        whole = np.logical_and.reduceat(same, np.cumsum(size) - size) if len(size) else np.zeros(0, dtype=bool)
        return pos[whole], window[whole]

    def _longest(self, words: Words, first: int, last: int, item: int, begin: int) -> tuple[int, int, int]:
        """A match of words first to last with an item from its word `begin` on, made as long as both allow."""
        text, base = words.text[first], self.words.first[item]
        h = words.hashes()
        left = int(min(first - words.first[text], begin))
        apart = np.flatnonzero(h[first - left:first][::-1] != self.h[base + begin - left:base + begin][::-1])
        left = int(apart[0]) if len(apart) else left
        end = base + begin + last - first + 1
        right = int(min(words.first[text] + words.count[text] - last - 1, base + self.words.count[item] - end))
        apart = np.flatnonzero(h[last + 1:last + 1 + right] != self.h[end:end + right])
        right = int(apart[0]) if len(apart) else right
        return first - left, last + right, begin - left

    def matches(self, words: Words) -> dict[int, list[dict]]:
        """For each text of a shard with hits: longest matches (item, item_first, first, last), words counted from the start of item and text.

        Of an item that repeats itself a window counts where it stands first, and matches that
        lie within one before are left out, so that there are never more than words.
        """
        pos, window = self.find(words)
        out: dict[int, list[dict]] = {}
        if not len(pos):
            return out
        n = np.diff(self.begin)[window]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[window], n)
        pos, item, place, size = np.repeat(pos, n), self.owner[at], self.place[at], np.repeat(self.size[window], n)
        order = np.lexsort((pos, pos - place, item, words.text[pos]))
        pos, item, place, size = pos[order], item[order], place[order], size[order]
        text, line = words.text[pos], pos - place
        starts = np.ones(len(pos), dtype=bool)
        starts[1:] = (np.diff(pos) != 1) | (np.diff(item) != 0) | (np.diff(line) != 0) | (np.diff(text) != 0)
        first = np.flatnonzero(starts)
        last = np.append(first[1:], len(pos)) - 1
        runs = sorted(zip(text[first].tolist(), item[first].tolist(), pos[first].tolist(), (pos + size - 1)[last].tolist(), place[first].tolist()))
        before, covered = None, -1
        for t, i, a, b, p in runs:
            if self.folded[i]:
                covered = -1 if before != (t, i) else covered
                before = (t, i)
                if b <= covered:
                    continue
                a, b, p = self._longest(words, a, b, i, p)
                covered = b
            base = int(words.first[t])
            out.setdefault(t, []).append({"item": self.ids[i], "item_first": p, "first": a - base, "last": b - base})
        return out


def _scan(docs: DataFrame, text: str, block: BenchmarkBlock, shard_bytes: int) -> DataFrame:
    """docs with __n_words and __matches with one block."""
    names = docs.columns
    schema = docs.select(*names, F.lit(0).cast("long").alias("__n_words"), F.array().cast(MATCHES).alias("__matches")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n_words, matches = [], [[] for _ in range(len(frame))]
            for start, raws in batches(frame[text].tolist(), shard_bytes):
                words = Words(raws, ALNUM)
                n_words += words.count.tolist()
                for t, found in block.matches(words).items():
                    matches[start + t] = found
            yield frame[names].assign(__n_words=n_words, __matches=matches)

    return map_texts(docs, run, schema)


def _located(docs: DataFrame, text: str, benchmark: DataFrame, window: int, item: str, block_bytes: int, shard_bytes: int) -> DataFrame:
    """docs with __n_words and __matches with the whole benchmark, block after block."""
    names = docs.columns
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col("text")).filter("text is not null").distinct()
    items = staged(items.withColumn("size", F.octet_length("text").cast("long")), "benchmark-items")
    blocks = -(-(items.agg(F.sum("size")).first()[0] or 0) // block_bytes)
    if blocks < 2:
        return _scan(docs, text, BenchmarkBlock([(r[0], r[1]) for r in items.select("item", "text").collect()], window), shard_bytes)
    placed = running_sums(items.withColumn("h", F.xxhash64("item", "text")), ["h", "item", "text"], {"until": "size"}).withColumn("block", F.floor((F.col("until") - F.col("size")) / block_bytes))
    rows, parts = staged(docs.withColumn("__row", F.monotonically_increasing_id()), "documents-once"), []
    for i in range(blocks):
        block = BenchmarkBlock([(r[0], r[1]) for r in placed.filter(F.col("block") == i).select("item", "text").collect()], window)
        own = _scan(rows.select("__row", text), text, block, shard_bytes).select("__row", "__n_words", "__matches")
        parts.append(staged(own if not parts else own.filter(F.size("__matches") > 0), "matches"))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    found = every.groupBy("__row").agg(F.max("__n_words").alias("__n_words"), F.flatten(F.collect_list("__matches")).alias("__matches"))
    return rows.join(found, "__row").select(*names, "__n_words", "__matches")


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with names that clash with nothing: __0, __1 and so on."""
    return docs.toDF(*[f"__{i}" for i in range(len(docs.columns))])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id",
                       block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, n_words, matches) of every row: what it holds verbatim of the benchmark, and where.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A window is
    `window` words in a row of an item; an item with fewer words is one window; an item
    without words matches nothing. A match is as long as document and item agree around a
    window: item (its id as a string, '' for null), item_first (its first word in the item),
    first and last word in the document, all counted from 0; every occurrence of a window lies
    in one. Null and empty texts have no words, long ones are searched whole, rows repeat as in
    docs, items that repeat count once, no rows give no rows; other columns are ignored. The
    benchmark is read in blocks of block_bytes of text and one item at most, one after the
    other, so neither driver nor task holds more than one block.
    """
    own = _numbered(docs.select(F.col(key), F.col(text)))
    return _located(own, "__1", benchmark, window, item, block_bytes, shard_bytes).select(F.col("__0").alias(key), F.col("__n_words").alias("n_words"), F.array_sort("__matches").alias("matches"))


def words_hit(matches: Column) -> Column:
    """Words of a document that lie in matches, each counted once."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["first"].alias("first"), m["last"].alias("last"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("done"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], acc["done"] + 1) + 1)).alias("n"), F.greatest(acc["done"], s["last"]).alias("done"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per row: key, n_words, n_hit (words inside matches), n_items, items_sha256, contaminated.

    Nulls, empty and long texts, repeated rows, empty tables and other columns are as in
    find_contamination; without a match items_sha256 is that of empty text.
    """
    found = find_contamination(docs, benchmark, **options)
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    out = found.withColumns({"n_hit": words_hit(F.col("matches")), "items": items})
    return out.select(options.get("key", "doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, item: str = "item_id",
                        block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of docs that hold no benchmark window, with the columns of docs, whatever their names.

    Null and empty texts stay, as do all rows where the benchmark is empty; long texts are
    searched whole; rows repeat as in docs, null keys too.
    """
    kept = _located(_numbered(docs), f"__{docs.columns.index(text)}", benchmark, window, item, block_bytes, shard_bytes).filter(F.size("__matches") == 0)
    return kept.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that occur in benchmark windows."""
    return contamination_report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) FROM benchmark),
item_windows AS (
  SELECT id AS item_id, least(len(w), 10) AS size, unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ') for i in range(1, len(w) - least(len(w), 10) + 2)]) AS win
  FROM words WHERE kind = 'b' AND len(w) > 0),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT id AS doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, unnest([array_to_string(w[i:i + size - 1], ' ') for i in range(1, len(w) - size + 2)]) AS win
  FROM words, sizes WHERE kind = 'd' AND len(w) >= size),
hits AS (SELECT doc_id, pos, i.size, item_id FROM doc_windows d JOIN item_windows i ON d.size = i.size AND d.win = i.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered c ON c.doc_id = id LEFT JOIN items i ON i.doc_id = id WHERE kind = 'd'
"""

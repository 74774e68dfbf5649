"""Periodic runs of words by maximal pairs, from the tree of intervals of common prefixes.

A run of period q and length L is a pair of places q apart that agree in exactly L - q words and
differ in the word before them: a maximal pair. The places of a text are put in the order of
their suffixes; intervals of common prefixes are met bottom-up, each with its places in classes
by the word to the left, and joining two of them gives the maximal pairs across them. Only pairs
whose distance is at most a part of what they have in common are runs, so each place looks
around itself alone, and nothing is extended afterwards.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WORD, map_texts, table
from .word_arrays import NOT_SPACE, Words, batches, mixed

#: Least length of a run in words, least number of times that its period fits in.
LEAST, TIMES = 6, 4
RUNS = "array<struct<start:int,length:int,period:int>>"


def least_common(least: int, times: int) -> int:
    """Words that a run's pair has in common at least, whatever the period."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def _stretch_end(has: np.ndarray) -> np.ndarray:
    """For each place the end of the stretch of True that it lies in; the place itself where it is False."""
    gap = np.where(has, len(has), np.arange(len(has)))
    return np.minimum.accumulate(gap[::-1])[::-1]


def possible_places(h: np.ndarray, words: Words, k: int, times: int) -> np.ndarray:
    """Which words can be one of a run's two places, by the distance of equal k-word strings of one text.

    If places q apart have l words in common, then each of the next l - k + 1 k-word strings
    occurs again in either direction, so a stretch of strings without another occurrence, or
    one whose nearest is too far for the stretch, rules a place out.
    """
    n = len(h)
    keep = np.zeros(n, dtype=bool)
    if n < k:
        return keep
    g = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        g = mixed(g + h[j:j + len(g)])
    g = mixed(g + words.text[:len(g)].astype(np.uint64))
    whole = np.arange(len(g)) + k <= (words.first + words.count)[words.text[:len(g)]]
    order = np.argsort(g, kind="stable")
    order = order[whole[order]]
    same = g[order[1:]] == g[order[:-1]]
    apart = np.diff(order)[same]
    for at, in ((order[:-1][same],), (order[1:][same],)):
        near = np.zeros(len(g), dtype=np.int64)
        near[at] = apart
        common = _stretch_end(near > 0) - np.arange(len(g)) + k - 1
        keep[:len(g)] |= (near > 0) & (near * (times - 1) <= common)
    return keep


def suffix_order(h: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some places of a text in the order of their suffixes, and the words that each has in common with the one before it."""
    n, levels, k = len(h), [], 1
    rank = np.unique(h, return_inverse=True)[1].ravel()
    while True:
        levels.append(rank.astype(np.int32))
        if rank.max() == n - 1:
            break
        after = np.zeros(n, dtype=np.int64)
        after[:max(0, n - k)] = rank[k:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].ravel()
        k *= 2
    order = places[np.argsort(rank[places])]
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(a), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[levels[level][a[inside]] == levels[level][b[inside]]]
        for x in (a, b, common):
            x[same] += 1 << level
    return order, np.concatenate(([0], common))


class _Node:
    """Places of an interval in order, and the same in classes by the word to the left."""

    __slots__ = ("classes", "common", "places")

    def __init__(self, place: int, left: int):
        self.common, self.places, self.classes = 0, [place], {left: [place]}


def _join(a: _Node, b: _Node, common: int, left: list[int], times: int, out: list[tuple[int, int, int]]) -> _Node:
    """The smaller of two nodes goes into the larger; maximal pairs across them that are near enough go to out."""
    if len(a.places) < len(b.places):
        a, b = b, a
    reach = common // (times - 1)
    for y in b.places:
        own, low, high = left[y], bisect_left(a.places, y - reach), bisect_right(a.places, y + reach)
        if high - low <= 2 * len(a.classes):
            near = (x for x in a.places[low:high] if left[x] != own)
        else:
            near = (x for c, held in a.classes.items() if c != own for x in held[bisect_left(held, y - reach):bisect_right(held, y + reach)])
        out.extend((min(x, y), abs(x - y), common) for x in near)
    for y in b.places:
        insort(a.places, y)
        insort(a.classes.setdefault(left[y], []), y)
    return a


def maximal_pairs(order: np.ndarray, common: np.ndarray, h: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(first place, distance, words in common) of maximal pairs with at least `least` words in common and a distance of at most a (times - 1)th of these."""
    out: list[tuple[int, int, int]] = []
    left = np.unique(np.concatenate((h[:0], h[:-1])), return_inverse=True)[1].ravel().tolist()
    left = [-1, *left]
    stack: list[_Node] = []
    order_list, after = order.tolist(), [*common.tolist()[1:], 0]
    for place, next_common in zip(order_list, after):
        node = _Node(place, left[place])
        while stack and stack[-1].common > next_common:
            top = stack.pop()
            value = top.common
            node = _join(top, node, value, left, times, out)
            node.common = value
        if next_common >= least:
            if stack and stack[-1].common == next_common:
                stack[-1] = _join(stack[-1], node, next_common, left, times, out)
            else:
                stack.append(node)
            stack[-1].common = next_common
    return out


def runs_of(h: np.ndarray, places: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text, by start, then period; h: a hash of each word, places: those that can be in a pair."""
    k = least_common(least, times)
    found: dict[tuple[int, int], int] = {}
    for start, q, common in maximal_pairs(*suffix_order(h, places), h, k, times):
        if q + common >= least:
            at = (start, q + common)
            found[at] = min(q, found.get(at, q))  # multiples of the smallest period give the same run
    return sorted((s, n, q) for (s, n), q in found.items())


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that lie in no run after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:n] == 0


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES, limit: int = 1 << 19) -> DataFrame:
    """docs with n_words, runs (start, length, period; words from 0) and collapsed, the words that stay joined by one space.

    Words are parted by white space and compared as they are, by a hash of 64 bits. A run is as
    long as its smallest period lasts, with at least `least` words and `times` periods; runs are
    listed by start, then period. A word goes if any run holds it after that run's first period.
    Null and empty texts have no words and an empty collapsed text; long ones count whole; rows
    that repeat are judged alike; other columns pass through, ones with the new names are
    replaced; no rows give no rows.
    """
    if least < 2 or times < 2:
        raise ValueError("a run repeats at least once")
    new = ("n_words", "runs", "collapsed")
    docs = docs.drop(*new)
    names, own = docs.columns, [f"__{i}" for i in range(len(docs.columns))]
    numbered, at = docs.toDF(*own), own[docs.columns.index(text)]
    schema = T.StructType([*numbered.schema.fields, *T.StructType.fromDDL(f"n_words long, runs {RUNS}, collapsed string").fields])
    k = least_common(least, times)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts, runs, texts = [], [], []
            for _, raws in batches(frame[at].tolist(), limit, lower=False):
                words = Words(raws, NOT_SPACE)
                h = words.hashes() if len(words.start) else np.zeros(0, dtype=np.uint64)
                able = possible_places(h, words, k, times)
                has = words.per_text(able) > 0
                for i, raw in enumerate(raws):
                    first, n, found = int(words.first[i]), int(words.count[i]), []
                    kept = raw.split()
                    if has[i]:
                        found = runs_of(h[first:first + n], np.flatnonzero(able[first:first + n]), least, times)
                        kept = [kept[j] for j in np.flatnonzero(_kept(n, found))]
                    counts.append(n)
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                    texts.append(b" ".join(kept).decode())
            yield frame.assign(n_words=np.array(counts, dtype=np.int64), runs=runs, collapsed=texts)

    return map_texts(numbered, run, schema).toDF(*names, *new)


def with_loops(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Column:
    """The text of a row, for one key in ten with a tail that repeats: the test pattern of the contract.

    Let h be the crc32 of the decimal key, g = floor(h / 10), n the number of words. If 10 divides h and n > 0,
    each word i from a = g % n on becomes word a + (i - a) % p, with p = 1 + floor((n - a) / (3 + g % 8)).
    Rows without a key stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def looped(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p)))

    # the array is bound once, as a lambda's variable, and not split anew for each word
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    some = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(looped(w), " ")).otherwise(F.lit("")))
    return F.when(F.col(text).isNotNull() & (h % 10 == 0), F.get(some, F.lit(0))).otherwise(F.col(text))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document: their number, the longest, and digests of all of them and of what stays without them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(docs.select("doc_id", with_loops(docs).alias("text")))
    # arrays sort by their first field first: the longest, of these the earliest, of these the shortest period
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    longest = {c: best[c].cast("long") for c in ("start", "length", "period")}
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *[v.alias(c) for c, v in longest.items()], F.floor(F.lit(1000) * longest["length"] / longest["period"]).alias("exponent_milli"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))

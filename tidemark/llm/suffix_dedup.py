"""Removal of long byte strings that occur twice, by breadth-first backward extension on Burrows-Wheeler transforms.

No task can hold a suffix array of the whole corpus, so strings that are equal must meet first.
Every string of `length` bytes is known by the least hash of its grams; consecutive strings of
one text with the same least gram are a segment, and equal strings always lie in segments of one
gram. Segments of equal content become one with a weight; those whose gram stands nowhere else
are done. The rest go to shards of bounded size by their gram, and a gram with too
many different segments is first divided by further grams, at last by the strings themselves.

In a shard the Burrows-Wheeler transform of the segments is expanded backwards, breadth first:
boundaries between rows get the length of their common prefix in increasing order, each once,
until `length` is reached. Rows without a boundary between them then start with the same
`length` bytes; where their weights come to two or more, the string repeats.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_texts, staged, table, unstage
from .word_arrays import BASE, INVERSE, mixed

#: Bytes of a string that may not repeat, bytes of a gram.
LENGTH, GRAM = 400, 64
#: Different segments of a gram that go to one shard, bytes of a shard, rounds of division before strings stand for themselves.
BUCKET, SHARD_BYTES, ROUNDS = 1024, 1 << 20, 3
#: Bytes of texts that are looked at together.
SLICE = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
PIECES = "pa long, ps long, a long, s long, size int, loops boolean, n long, id binary, k long, pos int"
SPANS = "array<struct<start:int,stop:int>>"


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, dtype=np.uint64), np.full(n, INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of each `width` neighbours, by running minima of blocks from both sides."""
    blocks = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:len(h)] = h
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - width + 1
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def segments(texts: Sequence[bytes], length: int, gram: int, level: int = 0, rounds: int = ROUNDS, within: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text, key, hash, loops, first string, last string exclusive) of the segments of some texts; hash is that of all bytes of the segment.

    level: 0 for grams, then other grams of segments of the keys `within`, from `rounds` on the
    strings themselves. A segment has at most length - gram + 1 strings. loops: whether its
    gram stands first in different places of its strings, without which no two are equal.
    """
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    raw, width = np.frombuffer(b"".join(texts), dtype=np.uint8), length - gram + 1
    n = len(raw) - length + 1
    if n < 1:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    up, down = _powers(1 << max(16, (len(raw)).bit_length()))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=sums[1:])
    size = gram if level < rounds else length
    h = mixed((sums[size:] - sums[:-size]) * down[:len(raw) - size + 1])
    at = np.arange(n)
    if level < rounds:  # of equal hashes the first place counts
        placed = (mixed(h ^ np.uint64(level)) & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        at = (_sliding_least(placed, width) & _PLACE).astype(np.int64)
    least, text = h[at], np.repeat(np.arange(len(texts)), sizes)[:n]
    whole = np.arange(n) + length <= ends[text]  # strings that go beyond their text are none
    # strings that stand for themselves stand alone
    parted = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1]) | (level >= rounds)
    start = np.concatenate(([0], np.flatnonzero(parted) + 1))
    stop = np.append(start[1:], n)
    start, stop = start[whole[start]], stop[whole[start]]
    parts = -(-(stop - start) // width)
    if len(parts) and parts.max() > 1:  # text that repeats itself
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, last = np.repeat(start, parts), np.repeat(stop, parts)
        start = first + step * width
        stop = np.minimum(start + width, last)
    end, text = stop + length - 1, text[start]
    key = mixed(least[start] + (np.zeros(1, dtype=np.int64) if within is None else within[text]).view(np.uint64))
    own = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    first = (ends - sizes)[text]
    return text, key, own, at[start] != at[stop - 1], start - first, stop - first


def _pieces(rows: DataFrame, length: int, gram: int, level: int, rounds: int) -> DataFrame:
    """Segments of (id, k, raw, a, s, n) rows: texts at level 0, segments of key a and weight n further on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held, size = [], 0
            for i, raw in enumerate(frame["raw"]):
                for off in range(0, len(raw) - length + 1, SLICE):
                    part = raw[off:off + SLICE + length - 1]
                    if size + len(part) > SLICE:
                        yield cut(frame, held)
                        held, size = [], 0
                    held.append((part, i, off))
                    size += len(part)
            yield cut(frame, held)

    def cut(frame: pd.DataFrame, held: list[tuple[bytes, int, int]]) -> pd.DataFrame:
        raws, row, off = zip(*held) if held else ((), (), ())
        own, off = frame.iloc[list(row)], np.array(off, dtype=np.int64)
        text, key, s, loops, start, stop = segments(raws, length, gram, level, rounds, own["a"].to_numpy(dtype=np.int64))
        above = {c: own[c].to_numpy()[text] for c in ("a", "s", "n", "id", "k")}
        return pd.DataFrame({"pa": above["a"], "ps": above["s"], "a": key.view(np.int64), "s": s.view(np.int64), "size": stop - start + length - 1, "loops": loops.astype(bool), "n": above["n"], "id": above["id"], "k": above["k"], "pos": start + off[text]})

    return map_texts(rows, run, PIECES)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of bytes in the order of the `depth` bytes or more that start there; what is equal so far stands in any order."""
    n = len(text)
    padded = np.concatenate((text, np.full(8, 255, dtype=np.uint8))).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j:j + n]
    order = np.argsort(key)
    new = np.ones(n, dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.zeros(n + 1, dtype=np.int64)  # place n, beyond the end, ranks last
    rank[n] = n
    slot = np.flatnonzero(new)
    rank[order] = np.repeat(slot, np.diff(np.append(slot, n)))
    tied = ~(new & np.append(new[1:], True))
    known, slots = 8, np.flatnonzero(tied)
    while known < depth and len(slots):
        places = order[slots]
        head = rank[places]
        key = (head.astype(np.uint64) << np.uint64(32)) | rank[np.minimum(places + known, n)].astype(np.uint64)
        by = np.argsort(key)
        places, key = places[by], key[by]
        order[slots] = places
        new = np.ones(len(slots), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        rank[places] = np.repeat(slots[first], np.diff(np.append(first, len(slots))))
        slots = slots[~(new & np.append(new[1:], True))]
        known *= 2
    return order


def _next_boundary(is_new: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first boundary after each of `at`; the end is one."""
    if len(at) * 64 > len(is_new):
        every = np.flatnonzero(is_new)
        return every[np.searchsorted(every, at, "right")]
    out, open_, base, step = np.zeros(len(at), dtype=np.int64), np.arange(len(at)), at + 1, 16
    while len(open_):
        look = is_new[np.minimum(base[open_][:, None] + np.arange(step), len(is_new) - 1)]
        hit = look.argmax(axis=1)
        found = look[np.arange(len(open_)), hit]
        out[open_[found]] = np.minimum(base[open_[found]] + hit[found], len(is_new) - 1)
        base[open_] += step
        open_ = open_[~found]
        step = min(2 * step, max(16, (1 << 20) // max(1, len(open_))))
    return out


def common_prefixes(order: np.ndarray, text: np.ndarray, limit: int) -> np.ndarray:
    """Boundaries of the rows of a suffix array: True where a row has fewer than `limit` bytes in common with the one before; the end is one.

    Breadth first by value: let a boundary have the value l. For every byte that precedes rows
    from there to the next boundary, the first such row is led by the backward step to a row
    that has l + 1 bytes in common with the one before it, if no smaller value was found. The
    first rows with a byte are the boundary itself and heads of runs of the transform.
    """
    n = len(order)
    before = text[order - 1]  # row of place 0: the separator at the end
    by = np.argsort(before, kind="stable")
    step = np.empty(n, dtype=np.int64)
    step[by] = np.arange(n)  # the backward step
    last = np.full(n, -1, dtype=np.int64)  # the row before with the same byte
    same = before[by[1:]] == before[by[:-1]]
    last[by[1:][same]] = by[:-1][same]
    heads = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
    is_new = np.zeros(n + 1, dtype=bool)
    is_new[n] = True
    firsts = text[order]
    now = np.flatnonzero(np.concatenate(([True], firsts[1:] != firsts[:-1])))
    is_new[now] = True
    for _ in range(limit - 1):
        if not len(now):
            break
        until = _next_boundary(is_new, now)
        low, high = np.searchsorted(heads, now, "right"), np.searchsorted(heads, until)
        count = high - low
        rows = heads[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        rows = rows[last[rows] < np.repeat(now, count)]
        to = step[np.concatenate((now, rows))]
        to = to[~is_new[to]]
        is_new[to] = True
        to.sort()  # each once, as the backward step is one to one
        now = to
    return is_new


def repeated_strings(raws: Sequence[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each of some byte strings without 0xFF, whether the `length` bytes that start at each place have a weight of two or more in all."""
    sizes = np.array([len(r) + 1 for r in raws])
    text = np.frombuffer(b"\xff".join(raws) + b"\xff", dtype=np.uint8)
    order = suffix_array(text, length)
    group = np.cumsum(common_prefixes(order, text, length)[:-1]) - 1
    owner = np.repeat(np.arange(len(raws)), sizes)
    first = np.cumsum(sizes) - sizes
    whole = np.arange(len(text)) - first[owner] + length < sizes[owner]
    weight = np.bincount(group, weights=np.where(whole, weights[owner], 0)[order])
    repeats = np.zeros(len(text), dtype=bool)
    repeats[order] = weight[group] >= 2
    return [x[:max(0, len(r) - length + 1)] for x, r in zip(np.split(repeats & whole, first[1:]), raws)]


def _spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


def _cut(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, s, n, c, raw) of the different segments, from the row of each that was chosen.

    Rows that share key and text are one before they move. How many segments there are follows
    the corpus, so neither side of the join is ever broadcast.
    """
    wanted = classes.groupBy(F.col("at.id").alias("id"), F.col("at.k").alias("k")).agg(F.collect_list(F.struct("a", "s", "size", "n", "c", "at.pos")).alias("wanted"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for raw, found in zip(frame["raw"], frame["wanted"]):
                out += [(w["a"], w["s"], w["n"], w["c"], raw[w["pos"]:w["pos"] + w["size"]]) for w in found]
            yield pd.DataFrame(out, columns=["a", "s", "n", "c", "raw"])

    once = rows.groupBy("id", "k").agg(F.first("raw").alias("raw"))
    return map_texts(once.join(wanted.hint("merge"), ["id", "k"]).select("raw", "wanted"), run, "a long, s long, n long, c long, raw binary")


def _expanded(texts: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(a, s, spans) of the segments (a, s, n, raw) with strings that repeat; spans are of strings' first bytes."""
    total = texts.agg(F.sum(F.octet_length("raw").cast("long"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    groups = texts.groupBy(F.pmod(F.xxhash64("a"), F.lit(shards)).alias("shard")).agg(F.collect_list(F.struct("a", "s", "n", "raw")).alias("held"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for held in frame["held"]:
                repeats = repeated_strings([bytes(x["raw"]) for x in held], np.array([x["n"] for x in held], dtype=float), length)
                out = [(x["a"], x["s"], [{"start": b, "stop": e} for b, e in _spans_of(r)]) for x, r in zip(held, repeats) if r.any()]
                yield pd.DataFrame(out, columns=["a", "s", "spans"])

    return map_texts(groups.select("held"), run, f"a long, s long, spans {SPANS}", rows=1)


def _repeated(rows: DataFrame, length: int, gram: int, level: int, bucket: int, shard_bytes: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(a, s, spans) of segments with strings that repeat, and the pieces (pa, ps, a, s, id, pos) of rows that may be such.

    rows: (id, k, raw, a, s, n): texts, or, one level down, segments of grams that have too many.
    """
    pieces = staged(_pieces(rows, length, gram, level, rounds), "pieces")
    each = pieces.groupBy("a", "s").agg(F.sum("n").alias("n"), F.max("loops").alias("loops"))
    grams = each.groupBy("a").agg(F.count("*").alias("c"), F.sum("n").alias("total"), F.max("loops").alias("any")).filter("total > 1 or any")
    known = each.select("a", "s", F.col("n").alias("weight")).join(grams.select("a", "c").hint("merge"), "a")
    held = staged(pieces.drop("loops", "n").join(known.hint("merge"), ["a", "s"]).withColumnRenamed("weight", "n"), "repeated-pieces")
    unstage(pieces)
    classes = held.groupBy("a", "s").agg(F.max("size").alias("size"), F.max("n").alias("n"), F.max("c").alias("c"), F.min(F.struct("id", "k", "pos")).alias("at"))
    texts = staged(_cut(rows, classes), "segments")
    spans = staged(_expanded(texts.filter(F.col("c") <= bucket), length, shard_bytes), "spans")
    large = texts.filter(F.col("c") > bucket)
    if level == rounds or large.isEmpty():  # strings that stand for themselves are one segment a hash
        unstage(texts)
        return spans, held
    inner = large.select(_half_hash(F.col("raw")).alias("id"), F.col("a").alias("k"), "raw", "a", "s", "n")
    found, own = _repeated(inner, length, gram, level + 1, bucket, shard_bytes, rounds)
    unstage(texts)
    shifted = F.transform("spans", lambda x: F.struct((x["start"] + F.col("pos")).alias("start"), (x["stop"] + F.col("pos")).alias("stop")))
    back = own.join(found.hint("merge"), ["a", "s"]).select(F.col("pa").alias("a"), F.col("ps").alias("s"), shifted.alias("spans"))
    return spans.unionByName(back.groupBy("a", "s").agg(F.flatten(F.collect_list("spans")).alias("spans"))), held


def _half_hash(raw: Column) -> Column:
    return F.substring(F.unhex(F.sha2(raw, 256)), 1, 16)


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int | None = None,
                   bucket: int = BUCKET, shard_bytes: int = SHARD_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """(id, found): for each text with strings of `length` bytes that also start elsewhere, spans (start, stop) of the bytes that these cover, in any order, overlapping.

    id is half of the text's SHA-256. A string repeats if it starts at two places of docs, of
    two rows or of one. Texts of fewer bytes have none, null counts as empty; keys may be null
    or repeat; other columns are ignored; no rows give no rows.
    """
    gram = gram or min(GRAM, max(1, length // 2))
    none = F.lit(0).cast("long")
    own = docs.filter(F.octet_length(text) >= length).select(_half_hash(F.col(text)).alias("id"), F.xxhash64(key).alias("k"), F.col(text).cast("binary").alias("raw"), none.alias("a"), none.alias("s"), (none + 1).alias("n"))
    found, held = _repeated(own, length, gram, 0, bucket, shard_bytes, rounds)
    moved = F.transform("spans", lambda x: F.struct((x["start"] + F.col("pos")).alias("start"), (x["stop"] + F.col("pos") + length - 1).alias("stop")))
    # a text has no more spans than segments, however many rows hold it
    at = held.select("a", "s", "id", "pos").join(found.hint("merge"), ["a", "s"]).select("id", moved.alias("spans"))
    out = staged(at.groupBy("id").agg(F.flatten(F.collect_set("spans")).alias("found")), "repeated-bytes")
    unstage(held)
    return out


def remove_repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with n_bytes, removed (start, stop of maximal runs of removed bytes) and kept, the other bytes as binary.

    Removed is each byte that lies in a string of `length` bytes which also starts anywhere else
    in docs, the same row included, judged on docs as they come, so no occurrence stays. Null
    counts as empty, long texts are read whole, rows that repeat are occurrences of each other;
    other columns pass through, ones with the new names are replaced; no rows give no rows. What
    stays need not be whole characters.
    """
    new = ("n_bytes", "removed", "kept")
    docs = docs.drop(*new)
    names, own = docs.columns, [f"__{i}" for i in range(len(docs.columns))]
    found = repeated_bytes(docs, key, text, **options).withColumnsRenamed({"id": "__id", "found": "__found"})
    numbered, at = docs.toDF(*own), own[names.index(text)]
    joined = numbered.withColumn("__id", _half_hash(F.coalesce(at, F.lit("")))).join(found.hint("merge"), "__id", "left").drop("__id")
    schema = T.StructType([*numbered.schema.fields, *T.StructType.fromDDL(f"n_bytes long, removed {SPANS}, kept binary").fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes, removed, kept = [], [], []
            for value, spans in zip(frame[at], frame["__found"]):
                raw = value.encode() if isinstance(value, str) else b""
                runs: list[list[int]] = []
                for start, stop in sorted((x["start"], x["stop"]) for x in spans) if spans is not None else []:
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], stop)
                    else:
                        runs.append([start, stop])
                edges = [0, *(e for r in runs for e in r), len(raw)]
                sizes.append(len(raw))
                removed.append([{"start": a, "stop": b} for a, b in runs])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[0::2], edges[1::2])))
            yield frame[own].assign(n_bytes=np.array(sizes, dtype=np.int64), removed=removed, kept=kept)

    return map_texts(joined, run, schema).toDF(*names, *new)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes, those that lie in repeated strings of 400 bytes, and a digest of the others."""
    out = remove_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + (r["stop"] - r["start"]))
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

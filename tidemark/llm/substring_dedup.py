"""Substring deduplication: repeated paragraphs by MinHash banding, verified and clustered.

Paragraphs are of two kinds. Lines of enough words are compared by MinHash bands, verified by
the exact Jaccard index of their word shingles, and clustered by connected components. Passages
that were spliced into other text don't fill lines, so windows of fixed length count as
paragraphs too: they start at the least shingle hash of every run of `REACH` places, so any run
of PASSAGE words that two documents share gives both a window. A window alone is no passage:
equal windows that follow each other in two documents join to runs, and where a run is too short
or ends, windows of PASSAGE words around it are compared, so that what is reported are the
maximal runs of at least PASSAGE words. Of each class the first occurrence stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import connected_components, linked_in_groups
from .shared import map_texts, staged, table, unstage
from .word_arrays import ALNUM, BASE, INVERSE, Words, batches, mixed

#: Words of a shingle, least similarity of lines, least words of a line, least words of a passage inside lines.
SHINGLE, SIMILARITY, LEAST, PASSAGE = 5, 0.8, 32, 50
#: Words of a window, places of which each run gives a window: windows of a shared run touch, and PASSAGE words hold one.
LENGTH, REACH = 26, 25
#: Bands of hashes: a pair of similarity 0.8 meets in some band with probability 1 - (1 - 0.8**3)**8 = 0.997.
BANDS, ROWS = 8, 3
#: Distinct lines of a bucket that are compared at once; in larger buckets only lines unlike the first one are held against all.
BLOCK = 1024
SEED = 11
UNITS = "h long, doc long, pos int, len int, bands array<long>"


def _runs(h: np.ndarray):
    """A function from first and last word (arrays, last exclusive) to hashes of these runs of words."""
    n = len(h) + 1
    up, down = np.full(n, BASE, dtype=np.uint64), np.full(n, INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h * up[:-1])))
    return lambda a, b: mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def band_keys(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(lines, BANDS) keys; the shingles of line i start at first[i]."""
    odd, flip = _hash_family()
    least = np.stack([np.minimum.reduceat((shingles ^ x) * a, first) for a, x in zip(odd, flip)], axis=1)
    keys = np.zeros((len(first), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        keys = mixed(keys + least[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64))
    return keys


def _places(words: Words, length: int) -> np.ndarray:
    """True where `length` words of one text start."""
    return np.arange(len(words.start)) + length <= np.repeat(words.first + words.count, words.count)


def windows(words: Words, run_hash) -> np.ndarray:
    """First words of the windows of all texts."""
    n = len(words.start)
    if n < REACH + SHINGLE - 1:
        return np.zeros(0, dtype=np.int64)
    at = np.arange(n - SHINGLE + 1)
    shingle = run_hash(at, at + SHINGLE)
    runs = np.lib.stride_tricks.sliding_window_view(shingle, REACH)
    inside = _places(words, REACH + SHINGLE - 1)[:len(runs)]
    anchor = np.flatnonzero(inside) + runs[inside].argmin(axis=1)
    anchor = np.unique(anchor)
    return anchor[_places(words, LENGTH)[anchor]]


def lines(words: Words, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (exclusive) of lines of at least `least` words."""
    line = np.searchsorted(np.flatnonzero(words.buf == 10), words.start)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    last = np.append(first[1:], len(line))
    long = last - first >= least
    return first[long], last[long]


def _shingles(run_hash, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of some runs of words, and where each run's begin."""
    count = last - first - SHINGLE + 1
    begin = np.cumsum(count) - count
    at = np.arange(count.sum()) - np.repeat(begin, count) + np.repeat(first, count)
    return run_hash(at, at + SHINGLE), begin


def units(docs: DataFrame, least: int = LEAST, limit: int = 1 << 19) -> DataFrame:
    """Windows and lines of (doc, text) rows; lines alone have bands."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = frame["doc"].to_numpy()
            for start, raws in batches(frame["text"].tolist(), limit):
                words = Words(raws, ALNUM)
                if not len(words.start):
                    continue
                run_hash = _runs(words.hashes())
                own, kinds = keys[start:start + len(raws)], []
                first = windows(words, run_hash)
                kinds.append((first, first + LENGTH, [None] * len(first)))
                first, last = lines(words, least)
                if len(first):
                    kinds.append((first, last, list(band_keys(*_shingles(run_hash, first, last)).view(np.int64))))
                for a, b, bands in kinds:
                    text = words.text[a]
                    yield pd.DataFrame({"h": run_hash(a, b).view(np.int64), "doc": own[text], "pos": (a - words.first[text]).astype(np.int32), "len": (b - a).astype(np.int32), "bands": pd.Series(bands, dtype=object)})

    return map_texts(docs, run, UNITS)


def _line_shingles(docs: DataFrame) -> DataFrame:
    """(h, shingles) of wanted lines; docs: (text, wanted array of (h, pos, len))."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text, wanted in zip(frame["text"], frame["wanted"]):
                words = Words([text.encode().lower() if isinstance(text, str) else b""], ALNUM)
                run_hash = _runs(words.hashes())
                able = [(w["h"], w["pos"], w["pos"] + w["len"]) for w in wanted if w["pos"] + w["len"] <= len(words.start)]
                if able:
                    h, a, b = (np.array(x, dtype=np.int64) for x in zip(*able))
                    same = run_hash(a, b).view(np.int64) == h  # rows may share a key
                    if same.any():
                        found, begin = _shingles(run_hash, a[same], b[same])
                        yield pd.DataFrame({"h": h[same], "shingles": [np.unique(x).view(np.int64) for x in np.split(found, begin[1:])]})

    return map_texts(docs, run, "h long, shingles array<long>")


def _near(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of lines whose shingles have a Jaccard index of at least `similarity`."""
    held = pairs.join(texts.select(F.col("h").alias("a"), F.col("shingles").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("shingles").alias("y")), "b")
    held = held.withColumn("both", F.size(F.array_intersect("x", "y")))
    return held.filter(F.col("both") >= similarity * (F.size("x") + F.size("y") - F.col("both")) - 1e-9).select("a", "b")


def line_links(distinct: DataFrame, docs: DataFrame, similarity: float, block: int) -> DataFrame:
    """Edges (a, b) whose components are those of all lines of some similarity that meet in a band.

    distinct: (h, first (doc, pos, len), bands), a row for each different line. Texts of lines
    that meet another are fetched from docs; the rest move as hashes. In a bucket of more than
    `block` lines each is held against the first; what is like it needs no other comparison with
    its kind, and only lines unlike the first are held against the whole bucket, in blocks.
    """
    each = distinct.select("h", F.explode("bands").alias("band"))
    sizes = each.groupBy("band").agg(F.count("*").alias("n"), F.min("h").alias("leader")).filter("n > 1")
    met = staged(each.join(sizes, "band"), "met-lines")
    wanted = (distinct.select("h", "first").join(met.select("h").distinct(), "h", "left_semi")
              .groupBy(F.col("first.doc").alias("doc")).agg(F.collect_list(F.struct("h", "first.pos", "first.len")).alias("wanted")))
    texts = staged(_line_shingles(docs.join(wanted, "doc").select("text", "wanted")).dropDuplicates(["h"]), "line-shingles")
    placed = met.filter(F.col("n") <= block).select("h", "band", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    large = met.filter(F.col("n") > block)
    star = None
    if not large.isEmpty():
        star = staged(_near(large.filter("h <> leader").select(F.col("h").alias("a"), F.col("leader").alias("b")).distinct(), texts, similarity), "like-the-first")
        unlike = large.filter("h <> leader").join(star.select(F.col("a").alias("h"), F.col("b").alias("leader")), ["h", "leader"], "left_anti")
        parts = unlike.groupBy("band").agg(F.ceil(F.count("*") / block).alias("parts"))
        blocks = F.ceil(F.col("n") / block)
        upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), c - 1))
        all_of = large.join(parts, "band").select("h", "band", F.pmod("h", blocks).alias("i"), upto(F.col("parts")).alias("j"))
        few = unlike.join(parts, "band").select("h", "band", upto(blocks).alias("i"), F.pmod(F.xxhash64("h"), F.col("parts")).alias("j"))
        placed = placed.unionByName(all_of).unionByName(few)
    groups = placed.join(texts, "h").groupBy("band", "i", "j").agg(F.collect_list(F.struct("h", "shingles")).alias("members"))
    found = groups.select("members").mapInPandas(linked_in_groups(similarity), "a long, b long").distinct()
    return found if star is None else found.unionByName(star)


def _long_windows(docs: DataFrame, passage: int) -> DataFrame:
    """(k, k2, doc, pos) of all windows of `passage` words that hold a wanted window; docs: (doc, text, wanted array of (h, pos))."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc, text, wanted in zip(frame["doc"], frame["text"], frame["wanted"]):
                words = Words([text.encode().lower() if isinstance(text, str) else b""], ALNUM)
                n, h = len(words.start), words.hashes()
                pos, own = np.array([w["pos"] for w in wanted], dtype=np.int64), np.array([w["h"] for w in wanted], dtype=np.int64)
                pos, own = pos[pos + LENGTH <= n], own[pos + LENGTH <= n]
                if not len(pos):
                    continue
                one, two = _runs(h), _runs(mixed(h ^ np.uint64(INVERSE)))
                pos = pos[one(pos, pos + LENGTH).view(np.int64) == own]  # rows may share a key
                at = np.unique(pos[:, None] - np.arange(passage - LENGTH + 1))
                at = at[(at >= 0) & (at + passage <= n)]
                yield pd.DataFrame({"k": one(at, at + passage).view(np.int64), "k2": two(at, at + passage).view(np.int64), "doc": np.full(len(at), doc), "pos": at.astype(np.int32)})

    return map_texts(docs, run, "k long, k2 long, doc long, pos int")


def passage_spans(windows: DataFrame, docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """Runs of at least `passage` words that repeat across documents, as overlapping spans (doc, pos, len, cluster, first_doc, stays).

    windows: (h, doc, pos); docs: (doc, text). A window that repeats is tied to the first place
    of its class; windows of a document that are tied to one other document at one distance, and
    touch, are a run that both share. Runs of `passage` words count. Around windows whose run is
    shorter, or ends within passage - LENGTH words, and around their first places, all windows of
    `passage` words are compared, by two hashes of 64 bits. If two documents share a run, then
    either both compare its windows there, or what they share lies within runs that count.
    """
    place = F.struct("doc", "pos")
    per = windows.groupBy("h").agg(F.min(place).alias("first"), F.max("doc").alias("last_doc")).filter(F.col("first.doc") < F.col("last_doc"))
    tied = windows.join(staged(per.select("h", "first"), "window-classes"), "h").filter((F.col("doc") != F.col("first.doc")) | (F.col("pos") != F.col("first.pos")))
    line = Window.partitionBy("doc", "first_doc", "apart").orderBy("pos")
    rows = tied.select("h", "doc", "pos", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos"), (F.col("pos") - F.col("first.pos")).alias("apart"))
    parted = F.coalesce(F.col("pos") - F.lag("pos").over(line) > LENGTH, F.lit(True)) | (F.col("doc") == F.col("first_doc"))
    rows = rows.withColumn("parted", parted.cast("int")).withColumn("run", F.sum("parted").over(line))
    run = Window.partitionBy("doc", "first_doc", "apart", "run")
    rows = rows.withColumns({"start": F.min("pos").over(run), "stop": F.max("pos").over(run) + LENGTH})
    rest = passage - LENGTH
    counts = F.col("stop") - F.col("start") >= passage
    inner = counts & (F.col("pos") - F.col("start") >= rest) & (F.col("stop") - F.col("pos") - LENGTH >= rest)
    rows = staged(rows.select("h", "doc", "pos", "first_doc", "first_pos", counts.alias("counts"), inner.alias("inner")), "tied-windows")

    outer = rows.filter("not inner")
    ends = outer.select("doc", "h", "pos").unionByName(outer.select(F.col("first_doc").alias("doc"), "h", F.col("first_pos").alias("pos")))
    wanted = ends.distinct().groupBy("doc").agg(F.collect_list(F.struct("h", "pos")).alias("wanted"))
    long = staged(_long_windows(docs.join(wanted, "doc").select("doc", "text", "wanted"), passage), "long-windows")
    classes = staged(long.groupBy("k", "k2").agg(F.min(place).alias("first"), F.max("doc").alias("last_doc")).filter(F.col("first.doc") < F.col("last_doc")).select("k", "k2", "first"), "passage-classes")
    stays = (F.col("doc") == F.col("first.doc")) & (F.col("pos") == F.col("first.pos"))
    sure = rows.filter("counts")
    span = lambda df, doc, pos, cluster, first, stays, size: df.select(F.col(doc).alias("doc"), F.col(pos).alias("pos"), F.lit(size).alias("len"), F.col(cluster).alias("cluster"), F.col(first).alias("first_doc"), stays.alias("stays"))
    return (span(sure, "doc", "pos", "h", "first_doc", F.lit(False), LENGTH)
            .unionByName(span(sure.select("h", "first_doc", "first_pos").distinct(), "first_doc", "first_pos", "h", "first_doc", F.lit(True), LENGTH))
            .unionByName(span(long.join(classes, ["k", "k2"]), "doc", "pos", "k", "first.doc", stays, passage)))


def repeated_spans(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, key: str = "doc_id", text: str = "text", least: int = LEAST, passage: int = PASSAGE) -> DataFrame:
    """Spans that repeat across documents: (doc, pos, len, cluster, first_doc, stays).

    Two kinds repeat: lines of at least `least` words, equal or of some similarity to another
    line, and runs of at least `passage` words (PASSAGE or more) anywhere. Shorter lines and runs
    don't count. doc is the key; rows that share a key count as one document, rows without one
    take no part, as nothing could name them. Words are runs of digits, letters and non-ASCII
    characters, A-Z lower-cased; pos counts them from 0. Null and empty texts and texts shorter
    than both limits have no spans, long ones are read whole. A class that lies in one document
    alone doesn't count; of places that tie, the smallest (key, word) is first. Other columns,
    whatever their names, are ignored; no rows give no rows.
    """
    if passage < LENGTH + REACH - 1 or least < SHINGLE:
        raise ValueError(f"passages have at least {LENGTH + REACH - 1} words, lines {SHINGLE}")
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    own = staged(units(rows, least), "paragraphs")
    found = staged(own.filter("bands is not null").withColumn("band", F.col("bands")[0]), "lines")
    runs = passage_spans(own.filter("bands is null").select("h", "doc", "pos"), rows, passage)
    unstage(own)

    place = F.struct("doc", "pos", "len")
    per = staged(found.groupBy("h", "len", "band").agg(F.min(place).alias("first"), F.max("doc").alias("last_doc"), F.first("bands").alias("bands")), "distinct-lines")
    roots = connected_components(line_links(per.dropDuplicates(["h"]), rows, similarity, block)).withColumnsRenamed({"node": "h"})
    classes = per.join(roots, "h", "left").select("h", "len", "band", F.coalesce("root", "h").alias("cluster"), F.col("root").isNotNull().alias("near"), "first", "last_doc")
    alone = classes.filter(~F.col("near") & (F.col("first.doc") < F.col("last_doc"))).select("h", "len", "band", "cluster", "first")
    near = classes.filter("near")
    spread = near.groupBy("cluster").agg(F.min("first").alias("first"), F.max("last_doc").alias("last_doc")).filter(F.col("first.doc") < F.col("last_doc"))
    repeated = staged(alone.unionByName(near.select("h", "len", "band", "cluster").join(spread.select("cluster", "first"), "cluster").select("h", "len", "band", "cluster", "first")), "repeated")
    stays = (F.col("doc") == F.col("first.doc")) & (F.col("pos") == F.col("first.pos"))
    spans = found.select("h", "len", "band", "doc", "pos").join(repeated, ["h", "len", "band"]).select("doc", "pos", "len", "cluster", F.col("first.doc").alias("first_doc"), stays.alias("stays"))
    return spans.unionByName(runs)


def _covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeat_report(spans: DataFrame) -> DataFrame:
    """A row for each document with repeats: doc, n_repeated, n_removed (words), removed spans, first_docs, class_id.

    Spans are `first-last` words, inclusive. class_id is the smallest document that holds a
    first occurrence of what this one repeats; first_docs lists all of these.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, found in zip(frame["doc"], frame["found"]):
                every = _covered([(f["pos"], f["pos"] + f["len"]) for f in found])
                gone = _covered([(f["pos"], f["pos"] + f["len"]) for f in found if not f["stays"]])
                rows.append((doc, sum(b - a for a, b in every), sum(b - a for a, b in gone), " ".join(f"{a}-{b - 1}" for a, b in gone)))
            yield pd.DataFrame(rows, columns=["doc", "n_repeated", "n_removed", "removed"])

    # a document's units are bounded by its own length, whatever repeats
    per = spans.groupBy("doc").agg(F.collect_set(F.struct("pos", "len", "stays")).alias("found"))
    firsts = spans.groupBy("doc").agg(F.min("first_doc").alias("class_id"), F.array_sort(F.collect_set("first_doc")).alias("first_docs"))
    return per.mapInPandas(run, "doc long, n_repeated long, n_removed long, removed string").join(firsts, "doc")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with later occurrences of repeated passages cut out of the text; documents that lose all words go.

    Columns pass through, whatever their names. Rows without a key and null texts are left as
    they are; rows that repeat are cut alike; no rows give no rows.
    """
    report = repeat_report(repeated_spans(docs, key=key, text=text, **options)).filter("n_removed > 0").select(F.col("doc").alias("__doc"), F.col("removed").alias("__removed"))
    names, own = docs.columns, [f"__{i}" for i in range(len(docs.columns))]
    at = own[names.index(text)]
    numbered = docs.toDF(*own)
    joined = numbered.join(report, F.col(own[names.index(key)]) == F.col("__doc"), "left").drop("__doc")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept = []
            for value, removed in zip(frame[at], frame["__removed"]):
                if isinstance(removed, str) and isinstance(value, str):
                    raw = value.encode()
                    words, out, done = Words([raw.lower()], ALNUM), [], 0
                    for a, b in (map(int, s.split("-")) for s in removed.split()):
                        if b < len(words.start):
                            out.append(raw[done:words.start[a]])
                            done = words.end[b]
                    value = b"".join([*out, raw[done:]]).decode()
                    value = value if ALNUM[np.frombuffer(value.encode().lower(), dtype=np.uint8)].any() else None
                    kept.append((True, value) if value is not None else (False, None))
                else:
                    kept.append((True, value))
            frame[at] = [v for _, v in kept]
            yield frame.loc[[k for k, _ in kept], own]

    return map_texts(joined, run, numbered.schema).toDF(*names)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages that repeat across documents, and what is cut from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeat_report(repeated_spans(docs)).withColumnRenamed("doc", "doc_id")

"""Near-copies by the exact Jaccard index of word shingles: no pair of some similarity is missed.

SimHash finds most: fingerprints within a small radius, through covering tables. A similarity of
0.8 can lie 14 of 64 bits apart, where no covering is small enough, so the rest comes from an
exact filter on the shingles themselves:

Shingles are put into one order, rare ones first: by the number of texts that hold them, as a
table of bounded size counts it, then by their hashes. Any order is exact; this one keeps what
many texts share, as forms and templates do, out of the prefixes. Two sets of n and m shingles with a Jaccard
index of at least s share at least s * n and s * m of them, so they share at least k of the first
n - ceil(s * n) + k of the one and of the first m - ceil(s * m) + k of the other (a prefix filter).
k is a share of the size. A text of whose prefix fewer shingles stand in other prefixes has no
partner; of the others, all but the k - 1 most common shingles of the prefix must hold one that
partners share. Most texts fall out here, unless a good part of them stands elsewhere.

Texts that share such a shingle form families around a centre, the least of their digests. Each
text is held against its centre; only texts that are unlike it are held against the family, in
groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, linked_in_groups
from .shared import map_texts, staged, unstage
from .simhash import RADIUS, fingerprint, keep_first, near_edges, shingle_hashes

#: Slots in which shingles are counted, which bounds what the driver and the tasks hold of all texts.
SLOTS = 1 << 18
#: Share of a set by which its prefix is longer than it must be; rounds in which centres spread; shingles of a group's half, about.
EXTRA, ROUNDS, GROUP_SHINGLES = 0.1, 2, 1 << 17
#: Centres of a key each two of which make a family; the texts of a key with more are a family of its own.
CENTRES = 16


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit digest of a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def prefix_size(n: int, similarity: float, extra: float) -> int:
    """Shingles of a set's prefix."""
    return n - int(np.ceil(similarity * n - 1e-9)) + max(1, int(np.floor(extra * n + 1e-9)))


def least_shared(n: Column, similarity: float, extra: float) -> Column:
    """How many shingles of its prefix a set shares with a partner's prefix at least, however small the partner is."""
    return F.greatest(F.lit(1), F.floor(extra * F.ceil(similarity * n - 1e-9) + 1e-9)).cast("int")


def slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def shingle_counts(docs: DataFrame, words: int, text: str) -> np.ndarray:
    """How many texts hold the shingles of each slot: SLOTS numbers, whatever the table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(SLOTS, dtype=np.int64)
        for frame in frames:
            own = [shingle_hashes(t, words) for t in frame[text]]
            sums += np.bincount(slot(np.concatenate([*own, np.zeros(0, dtype=np.int64)])), minlength=SLOTS)
        used = np.flatnonzero(sums)
        yield pd.DataFrame({"slot": used, "n": sums[used]})

    found = map_texts(docs.select(text), run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS, dtype=np.int64)
    out[found["slot"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return out


def rare_first(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return shingles[np.lexsort((shingles, counts[slot(shingles)]))]


def prefixes(docs: DataFrame, words: int, similarity: float, key: str, text: str, extra: float = EXTRA) -> DataFrame:
    """(key, fp, node, size, prefix): fingerprint, digest and size of the shingle set, and its prefix."""
    schema = docs.select(key, F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("node"), F.lit(0).alias("size"), F.array(F.lit(0).cast("long")).alias("prefix")).schema
    counts = shingle_counts(docs, words, text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = [shingle_hashes(t, words) for t in frame[text]]
            yield pd.DataFrame({key: frame[key], "fp": np.array([fingerprint(t, words) for t in frame[text]], dtype=np.uint64).view(np.int64), "node": [set_id(s) for s in own],
                                "size": [len(s) for s in own], "prefix": [rare_first(s, counts)[:prefix_size(len(s), similarity, extra)] for s in own]})

    return map_texts(docs.select(key, text), run, schema)


def candidate_keys(rows: DataFrame, similarity: float, extra: float = EXTRA) -> DataFrame:
    """(node, size, shingle): shingles that partners must share one of, of sets that can have partners; rows: (node, size, prefix)."""
    counts = rows.select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    each = rows.select("node", "size", F.explode("prefix").alias("shingle")).join(staged(counts, "shared-shingles"), "shingle")
    held = each.groupBy("node", "size").agg(F.array_sort(F.collect_set(F.struct("df", "shingle"))).alias("shared"))
    keys = F.size("shared") - least_shared(F.col("size"), similarity, extra) + 1
    own = staged(held.filter(keys > 0).select("node", "size", F.explode(F.slice("shared", F.lit(1), keys)).alias("s")).select("node", "size", "s.shingle"), "keys")
    met = own.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("shingle")
    return staged(own.join(staged(met, "keys-that-meet"), "shingle"), "met")


def families(met: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, centre): the least node among those that share a key, and after more rounds those that share one with them."""
    now = met.select("node", F.col("node").alias("centre")).distinct()
    for _ in range(rounds):
        least = staged(met.join(now, "node").groupBy("shingle").agg(F.min("centre").alias("centre")), "least-of-key")
        now = staged(met.select("node", "shingle").join(least, "shingle").groupBy("node").agg(F.min("centre").alias("centre")), "families")
    return now


def shingle_sets(nodes: DataFrame, sets: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, own) of some nodes: their shingles, from the text of one key each. sets: (node, key); docs: (key, text)."""
    wanted = sets.select("node", "key").join(nodes, "node", "left_semi")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = [shingle_hashes(t, words) for t in frame["text"]]
            same = [set_id(s) == n for s, n in zip(own, frame["node"])]  # rows may share a key
            yield pd.DataFrame({"node": frame["node"], "own": own})[same]

    return staged(map_texts(docs.join(wanted, "key").select("node", "text"), run, "node long, own array<long>").dropDuplicates(["node"]), "shingles")


def similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes whose shingle sets have a Jaccard index of at least `similarity`."""
    held = pairs.join(texts.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    held = held.withColumn("both", F.size(F.array_intersect("x", "y")))
    return held.filter(F.col("both") >= similarity * (F.size("x") + F.size("y") - F.col("both")) - 1e-9).select("a", "b")


def _merged(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """roots (node, root) after linking pairs of nodes."""
    ends = pairs.join(roots.withColumnsRenamed({"node": "a", "root": "x"}), "a").join(roots.withColumnsRenamed({"node": "b", "root": "y"}), "b")
    links = connected_components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return staged(roots.join(links.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")


def _fingerprint_pairs(sets: DataFrame, radius: int) -> DataFrame:
    """Pairs of nodes that link what fingerprints within the radius link: nodes of one fingerprint to the least of them, and these along the edges."""
    least = staged(sets.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    edges = near_edges(least.select("fp"), radius).distinct().withColumnsRenamed({"a": "p", "b": "q"})
    ends = edges.join(least.select(F.col("fp").alias("p"), F.col("first").alias("a")), "p").join(least.select(F.col("fp").alias("q"), F.col("first").alias("b")), "q").select("a", "b")
    return staged(ends.unionByName(sets.join(least, "fp").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))), "fingerprint-pairs")


def _groups(met: DataFrame, homes: DataFrame, roots: DataFrame, group_shingles: int, most: int = CENTRES) -> DataFrame:
    """(node, f, g, i, j): groups (f, g, i, j) in which all pairs of nodes that share a key and have different roots meet.

    f and g are centres of the nodes of a key, i and j blocks. A key with more than `most` centres
    is no pair of them but a group by itself, f being the key and g its complement, so that what
    leaves a key is linear in its nodes. What has the most frequent root
    of (f, g) stands in i alone, whatever has another in i and j.
    """
    placed = staged(met.join(roots, "node").join(homes, "node"), "placed")
    several = placed.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("shingle")
    left = staged(placed.join(staged(several, "keys-of-several"), "shingle"), "open-keys")
    centres = left.select("shingle", "centre").distinct()
    many = staged(centres.groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("shingle"), "keys-of-many")
    centres = centres.join(many, "shingle", "left_anti")
    both = centres.select("shingle", F.col("centre").alias("f")).join(centres.select("shingle", F.col("centre").alias("g")), "shingle").filter("f <= g")
    own = left.join(staged(both, "centres-of-keys"), "shingle").filter("centre = f or centre = g").select("f", "g", "node", "root", "size")
    alone = left.join(many, "shingle").select(F.col("shingle").alias("f"), F.bitwise_not("shingle").alias("g"), "node", "root", "size")
    own = staged(own.unionByName(alone).distinct(), "family-members")
    total = own.groupBy("f", "g", "root").agg(F.sum("size").alias("part")).groupBy("f", "g").agg(F.max(F.struct("part", "root")).alias("main"), F.sum("part").alias("all"), F.count("*").alias("n")).filter("n > 1")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / group_shingles)).cast("long")
    total = staged(total.select("f", "g", F.col("main.root").alias("main"), blocks(F.col("all")).alias("blocks"), blocks(F.col("all") - F.col("main.part")).alias("parts")), "family-sizes")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), c - 1))
    held = own.join(total, ["f", "g"])
    rows = held.select("node", "f", "g", F.pmod("node", "blocks").alias("i"), upto(F.col("parts")).alias("j"))
    others = held.filter("root <> main and blocks > 1").select("node", "f", "g", upto(F.col("blocks")).alias("i"), F.pmod(F.xxhash64("node"), F.col("parts")).alias("j"))
    return rows.unionByName(others)


def near_copy_groups(docs: DataFrame, words: int = 5, radius: int = RADIUS, similarity: float = 0.8, key: str = "doc_id", text: str = "text", group_shingles: int = GROUP_SHINGLES, checked: bool = False) -> DataFrame:
    """(key, component_id) of every row with a key: the smallest key that links reach.

    Two texts link if the Jaccard index of their word shingles is at least `similarity`, without
    a miss and checked exactly, or if their fingerprints differ in at most `radius` bits, as in
    the SimHash operator; if `checked`, these links too must have that similarity. A text with fewer words is one shingle; null, empty and blank texts have none and link to each other.
    Long texts count whole. Rows without a key take no part; rows that repeat a key are one node
    of the links for each text they have. Other columns, whatever their names, are ignored; no
    rows give no rows.
    """
    docs = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = staged(prefixes(docs, words, similarity, "key", "text"), "prefixes")
    sets = staged(rows.groupBy("node").agg(F.min("key").alias("key"), F.min("fp").alias("fp"), F.min("size").alias("size")), "shingle-sets")
    one = rows if rows.count() == sets.count() else rows.join(sets.select("node", "key"), ["node", "key"], "left_semi")
    met = candidate_keys(one, similarity)
    ids = staged(rows.select("key", "node"), "nodes")
    unstage(rows)
    homes, close = families(met), _fingerprint_pairs(sets, radius)
    texts = shingle_sets(homes.select("node"), sets, docs, words)

    if checked:  # a text that shares no key with another has no partner of that similarity
        close = similar(close, texts, similarity)
    roots = _merged(staged(sets.select("node", F.col("node").alias("root")), "roots"), close)
    star = homes.join(roots, "node").join(roots.select(F.col("node").alias("centre"), F.col("root").alias("top")), "centre").filter("root <> top")
    roots = _merged(roots, similar(star.select(F.col("node").alias("a"), F.col("centre").alias("b")), texts, similarity))
    groups = _groups(met, homes, roots, group_shingles).join(texts, "node").groupBy("f", "g", "i", "j").agg(F.collect_list(F.struct(F.col("node").alias("h"), F.col("own").alias("shingles"))).alias("members"))
    roots = _merged(roots, groups.select("members").mapInPandas(linked_in_groups(similarity), "a long, b long"))

    # a table of its own, so that Spark can split the join at the root of a very large component
    least = staged(roots.join(sets.select("node", "key"), "node").groupBy("root").agg(F.min("key").alias("component_id")), "least-keys")
    return ids.select(F.col("key").alias(key), "node").join(staged(roots.join(least, "root").select("node", "component_id"), "components"), "node").select(key, "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs whose key is the smallest of their group, with the columns of docs, whatever their names.

    Nulls, empty and long texts and empty tables are as in near_copy_groups; rows without a key
    all stay, and where keys repeat each row is judged by its own text.
    """
    return keep_first(docs, lambda own, k, t: near_copy_groups(own, key=k, text=t, **options), key, text)

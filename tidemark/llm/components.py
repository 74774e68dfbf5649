"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged, unstage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node joins its larger neighbours to the least node next to it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node joins itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node it can reach.

    edges: (a, b), of one orderable type, without nulls; loops count as nothing, repeats are
    fine. Each round ends in a table in the shared folder. The number of rounds grows with the
    logarithm of the longest path; RuntimeError if `most` rounds don't suffice.
    """
    now = staged(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    seen = None
    for _ in range(most):
        after = staged(_small_star(_large_star(now)), "edges")
        unstage(now)
        now = after
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = sign
    raise RuntimeError(f"components did not settle in {most} rounds")


def linked_in_groups(similarity: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over groups (members: array of (h, shingles)): edges (a, b) that connect what pairs of some Jaccard index connect.

    A group gives at most one edge fewer than it has members; a member is held against all that
    are still open at once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            a, b = [], []
            for members in frame["members"]:
                sets = {m["h"]: np.asarray(m["shingles"]) for m in members}
                h = np.array(list(sets), dtype=np.int64)
                size = np.array([len(s) for s in sets.values()])
                owner = np.repeat(np.arange(len(h)), size)
                _, shingle = np.unique(np.concatenate(list(sets.values())), return_inverse=True)
                begin, open_ = np.cumsum(size) - size, np.ones(len(h), dtype=bool)
                mark = np.zeros(shingle.max() + 1, dtype=np.int64)
                for first in range(len(h)):
                    if not open_[first]:
                        continue
                    open_[first], todo = False, [first]
                    while todo and open_.any():
                        i = todo.pop()
                        mine = shingle[begin[i]:begin[i] + size[i]]
                        mark[mine] = 1
                        both = np.bincount(owner, weights=mark[shingle], minlength=len(h))
                        mark[mine] = 0
                        new = np.flatnonzero(open_ & (both >= similarity * (size + size[i] - both) - 1e-9))
                        open_[new] = False
                        a += [h[i]] * len(new)
                        b += h[new].tolist()
                        todo += new.tolist()
            yield pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    return run

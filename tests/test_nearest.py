"""Exact vector search with pruning, against all pairs."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import nearest as ne
from tidemark.operators import retrieval as rt


def vectors(n, seed, dims=8, groups=12):
    """Clustered vectors, a third of them one vector, zero vectors, and opposites."""
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(groups, dims))
    x = c[rng.integers(0, groups, n)] + 0.2 * rng.normal(size=(n, dims))
    x[: n // 3] = x[0]
    x[n // 3] = 0
    x[n // 3 + 1] = -x[0]
    return [(int(i), chr(97 + int(i) % 5), [float(v) for v in row]) for i, row in enumerate(x)]


def units(rows):
    x = np.array([r[2] for r in rows])
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def brute(rows, asked, k, skip_self):
    x, out = units(rows), {}
    s = np.round(x[asked] @ x.T, ne.PLACES)
    for i, q in enumerate(asked):
        order = [j for j in np.lexsort((np.arange(len(x)), -s[i])) if not (skip_self and j == q)][:k]
        out[q] = [(j, float(s[i][j])) for j in order]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, category string, embedding array<double>")


@pytest.mark.parametrize("block,lists", [(512, None), (20, None), (7, 5), (50, 40), (1000, 1)])
def test_top_k_equals_all_pairs(spark, block, lists):
    rows = vectors(400, 1)
    df = frame(spark, rows)
    for k, skip_self, asked in ((5, True, list(range(400))), (3, False, list(range(0, 400, 100))), (500, False, [0, 133, 134, 200])):
        got = {}
        for r in rt.top_k(df.filter(df["id"].isin(asked)), df, k, skip_self, block, lists).collect():
            got.setdefault(r["q"], []).append((r["rank"], r["doc"], r["score"]))
        want = brute(rows, asked, k, skip_self)
        assert set(got) == set(want)
        for q, found in got.items():
            assert [(d, pytest.approx(s, abs=1e-9)) for _, d, s in sorted(found)] == want[q]
            assert [r for r, _, _ in sorted(found)] == list(range(1, len(found) + 1))


def test_blocks_are_skipped(spark):
    """In clustered data most blocks are never visited; each visit moves one query, so what is moved is far less than all pairs."""
    rows = vectors(3000, 2, dims=16, groups=40)[1000:]
    df = frame(spark, rows)
    report = rt.pruning(df, df, 5, skip_self=True, block=40, lists=40).first()
    assert report["n_queries"] == 2000 and report["n_blocks"] >= 40 and report["skipped"] > 0.8


def test_nearest_by_category_is_exact(spark):
    rows = [(i, "only" if i == 7 else c, v) for i, c, v in vectors(300, 3)]
    x = units(rows)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    kinds = np.array([r[1] for r in rows])
    for block, lists in ((512, None), (15, 12)):
        got = {r["q"]: (r["same"], r["other"]) for r in rt.nearest_by_category(frame(spark, rows), block, lists).collect()}
        for i in range(300):
            same, other = s[i][kinds == kinds[i]].max(), s[i][kinds != kinds[i]].max()
            assert got[i] == (None if i == 7 else pytest.approx(1 - same, abs=1e-9), pytest.approx(1 - other, abs=1e-9))
    single = frame(spark, [(i, "x", v) for i, _, v in rows])
    assert all(r["other"] is None and r["same"] is not None for r in rt.nearest_by_category(single, 15, 12).collect())


def test_index_is_bounded_and_whole(spark):
    df = ne.unit_rows(frame(spark, vectors(500, 4) + [(999, "x", []), (998, "y", None)]))
    own, index = ne.build_index(df, 16, 10)
    assert own.count() == 500 and index.rows.sum() <= 500 and len(index.centroids) == 10
    assert own.groupBy("block").count().agg({"count": "max"}).first()[0] < 16 * 4
    x = np.array([r["x"] for r in df.collect()])
    bound = {r["id"]: index.bounds(x)[:, r["block"]] for r in own.collect()}
    docs = {r["id"]: np.array(r["x"]) for r in own.collect()}
    for i, low in bound.items():
        assert (low <= np.arccos(np.clip(x @ docs[i], -1, 1)) + 1e-9).all()


def test_no_rows(spark):
    df = frame(spark, vectors(30, 5))
    assert rt.top_k(df.limit(0), df, 3).count() == 0 and rt.top_k(df, df.limit(0), 3).count() == 0 and rt.nearest_by_category(df.limit(0)).count() == 0


def test_silhouette_in_passes_equals_all_pairs(spark):
    rows = [(i, None if i == 5 else "alone" if i == 9 else c, v) for i, c, v in vectors(120, 6)]
    x, kinds = units(rows), [r[1] for r in rows]
    far, values = 1 - x @ x.T, []
    for i, c in enumerate(kinds):
        if c is not None and c != "alone":
            same = [far[i][j] for j, k in enumerate(kinds) if k == c and j != i]
            other = min(np.mean([far[i][j] for j, k in enumerate(kinds) if k == d]) for d in "abcde" if d != c)
            values.append((other - np.mean(same)) / max(np.mean(same), other))
    for numbers in (1 << 21, 20):  # all categories in one pass, two or so in each
        got = rt.silhouette(frame(spark, rows), numbers).first()
        assert got["n"] == len(values) and got["silhouette"] == pytest.approx(np.mean(values), abs=1e-9)
    one = rt.silhouette(frame(spark, [(i, "a", v) for i, _, v in rows])).first()
    assert one["silhouette"] is None and rt.silhouette(frame(spark, rows).limit(0)).first()["n"] == 0


def test_many_shards_and_parts_equal_all_pairs(spark, monkeypatch):
    """Shards of a few blocks and parts of a few queries give what one of each gives."""
    monkeypatch.setattr(ne, "FEW", 40)
    rows = vectors(400, 7)
    df = frame(spark, rows)
    _, index = ne.build_index(ne.unit_rows(df), 20)
    assert index.shards().max() > 3 and ne._divided(400) > 3
    want = brute(rows, list(range(400)), 5, True)
    got = {}
    for r in rt.top_k(df, df, 5, True, 20).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["doc"])
    assert got == {q: [d for d, _ in found] for q, found in want.items()}
    x, kinds = units(rows), np.array([r[1] for r in rows])
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    for r in rt.nearest_by_category(df, 20).collect():
        own = kinds == kinds[r["q"]]
        assert r["same"] == pytest.approx(1 - s[r["q"]][own].max(), abs=1e-8) and r["other"] == pytest.approx(1 - s[r["q"]][~own].max(), abs=1e-8)


def test_a_query_moves_once_a_shard(spark, monkeypatch):
    """Vectors without clusters visit nearly all blocks; what moves and what a task yields at once is a row for each shard, not for each block."""
    rng = np.random.default_rng(8)
    rows = [(int(i), "x", [float(v) for v in rng.normal(size=32)]) for i in range(2000)]
    df = frame(spark, rows)
    _, visits, index = ne.search(df, df, 5, True, 20)
    moved = sum(v.count() for v in visits)
    visited = sum(v.agg({"n": "sum"}).first()[0] for v in visits)
    assert len(index.rows) >= 100 and visited > 2000 * 50 and moved <= 2 * 2000 * (index.shards().max() + 1)


def test_cosines_that_differ_past_nine_places_tie(spark):
    """The SQL orders by cosines of nine places, then by id."""
    rows = [(0, "x", [1.0, 0.0]), (1, "x", [1.0, 1.00000000004]), (2, "x", [1.0, 1.0]), (3, "x", [1.0, 0.9])]
    df = frame(spark, rows)
    assert [r["doc"] for r in rt.top_k(df.filter("id = 0"), df, 3, True).orderBy("rank").collect()] == [3, 1, 2]


def test_few_queries_make_small_shards(spark, monkeypatch):
    """What moves is few queries, not documents; a task then holds less of these than with as many queries as documents."""
    monkeypatch.setattr(ne, "FEW", 10)
    rows = vectors(400, 9)
    df = frame(spark, rows)
    asked = list(range(0, 400, 10))
    found, _, index = ne.search(df.filter("id % 10 = 0"), df, 5, False, 4)
    held = np.bincount(index.shards(), index.rows)
    assert len(held) > 2 * ne.PARTS and held.max() < 400 / ne.PARTS
    got = {}
    for r in found.orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["doc"])
    assert got == {q: [d for d, _ in x] for q, x in brute(rows, asked, 5, False).items()}


def scattered(n, dims=32):
    """Vectors without clusters, which visit nearly all blocks."""
    return [(int(i), "ab"[i % 2], [float(v) for v in x]) for i, x in enumerate(np.random.default_rng(11).normal(size=(n, dims)))]


def test_a_task_yields_bounded_frames(spark, monkeypatch):
    """Queries that visit all blocks come out in frames of bounded size, whatever the batch that came in."""
    rows = scattered(600)
    _, index = ne.build_index(ne.unit_rows(frame(spark, rows)), 10)
    monkeypatch.setattr(ne, "_STEP", 3200)

    class Queries:
        def mapInPandas(self, run, schema):
            return run

    asked = pd.DataFrame({"id": np.arange(600), "kind": None, "x": list(units(rows))})
    yielded = [len(f) for f in ne._visits(Queries(), index, 600, False, 1)(iter([asked]))]
    assert len(index.rows) > 50 and sum(yielded) == 600 * (index.shards().max() + 1) and max(yielded) * 32 <= ne._STEP


def test_nearest_by_category_moves_a_query_once_a_shard(spark, monkeypatch):
    """Both rounds move a row for each shard, not for each block, and stay exact."""
    moved, visits = [], ne._visits
    monkeypatch.setattr(ne, "_visits", lambda *a, **b: moved.append(visits(*a, **b)) or moved[-1])
    rows = scattered(1500)
    got = {r["q"]: (r["same"], r["other"]) for r in rt.nearest_by_category(frame(spark, rows), 15).collect()}
    assert len(moved) == 2 and sum(v.count() for v in moved) <= 2 * 1500 * ne._divided(1500)
    x = units(rows)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    even = np.arange(1500) % 2 == 0
    for i in range(1500):
        own = even == even[i]
        assert got[i] == (pytest.approx(1 - s[i][own].max(), abs=1e-8), pytest.approx(1 - s[i][~own].max(), abs=1e-8))

"""Near-copies of the pipeline against all pairs by brute force."""

import random

import corpus_pipeline
from tidemark.llm import near_copies
from tidemark.llm.simhash import fingerprint


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def brute_labels(docs, similarity, radius=-1):
    own, prints = {i: grams(t) for i, t in docs}, {i: fingerprint(t, 5) for i, t in docs}
    ids = sorted(own)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if len(own[a] & own[b]) >= similarity * len(own[a] | own[b]) - 1e-9 or (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in ids}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def labels(spark, rows, **options):
    return {r["doc_id"]: r["component_id"] for r in near_copies.near_copy_groups(frame(spark, rows), **options).collect()}


def test_all_pairs_of_a_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert labels(spark, docs, radius=corpus_pipeline.NEAR_BITS) == brute_labels(docs, corpus_pipeline.SIMILARITY, corpus_pipeline.NEAR_BITS)


def copies(rng, words, most):
    """Copies of a text with words replaced at random places."""
    own = list(words)
    for at in rng.sample(range(len(own)), rng.randint(0, most)):
        own[at] = f"new{rng.getrandbits(40)}"
    return " ".join(own)


def test_large_groups_and_chains(spark):
    """Groups of more than 256 copies around the threshold, which buckets of fingerprints lost, and chains."""
    rng = random.Random(8)
    rows = []
    for group in range(2):
        words = [f"w{rng.getrandbits(40)}" for _ in range(200 + 100 * group)]
        rows += [(len(rows) + i, copies(rng, words, 12)) for i in range(300)]
        for _ in range(6):  # each link of the chain is near the one before only
            words = copies(rng, words, 5).split()
            rows.append((len(rows), " ".join(words)))
    rows += [(5000 + i, t) for i, t in enumerate(("", " ", "a b", "A  b", "a b c", "x " * 40, "x " * 400))]
    want = brute_labels(rows, 0.8, 3)
    assert labels(spark, rows, radius=3) == want
    kept = {r["doc_id"] for r in near_copies.keep_one(frame(spark, [*rows, (None, "a b"), (5002, "other words")]), radius=3).collect()}
    assert kept == {i for i, r in want.items() if i == r} | {None}


def test_checked_links_are_the_similar_pairs(spark):
    """With checks, links are the pairs of some similarity, no more and no fewer, whatever their fingerprints."""
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = brute_labels(docs, corpus_pipeline.SIMILARITY)
    assert labels(spark, docs, radius=corpus_pipeline.NEAR_BITS, checked=True) == want
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, docs), "").collect()}
    assert kept == {i for i, root in want.items() if i == root}


def half_alike(n, seed=1):
    """Texts that share half of their words, Jaccard index 0.33 for every pair."""
    rng = random.Random(seed)
    shared = [f"s{rng.getrandbits(40)}" for _ in range(100)]
    return [(i, " ".join(shared + [f"w{rng.getrandbits(40)}" for _ in range(100)])) for i in range(n)]


def test_texts_on_one_template_stay_apart(spark):
    rows = half_alike(2000)
    got = labels(spark, rows, checked=True)
    assert got == {i: i for i, _ in rows}
    docs = frame(spark, rows)
    cand = near_copies.candidate_keys(near_copies.prefixes(docs, 5, 0.8, "doc_id", "text").withColumnRenamed("doc_id", "key"), 0.8)
    assert cand.count() == 0  # what all texts share is in no prefix, so nothing is compared


def test_pairs_beyond_the_fingerprint(spark):
    """The pipeline's stage links what is alike, however far the fingerprints are apart."""
    rng = random.Random(2)
    rows, far = [], 0
    for i in range(60):
        words = [f"w{rng.getrandbits(40)}" for _ in range(120)]
        other = words[:13] + [f"n{rng.getrandbits(40)}"] + words[13:60] + [f"n{rng.getrandbits(40)}"] + words[60:]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        far += (fingerprint(rows[-1][1], 5) ^ fingerprint(rows[-2][1], 5)).bit_count() > 6
    assert far > 20
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()}
    assert kept == set(range(0, 120, 2))


def test_key_of_many_centres_makes_no_pairs_of_them(spark):
    """Texts that share one key, each with a centre of its own, are grouped by the key; all that must meet still do."""
    n = 60
    pairs = [(i, s) for i in range(n) for s in ({7} if i < 50 else set()) | {100 + i // 3}]
    met = spark.createDataFrame([(i, 10 + i % 4, s) for i, s in pairs], "node long, size int, shingle long")
    homes = spark.createDataFrame([(i, i) for i in range(n)], "node long, centre long")
    roots = spark.createDataFrame([(i, i // 2) for i in range(n)], "node long, root long")
    held = {i: {s for j, s in pairs if j == i} for i in range(n)}
    wanted = {(a, b) for a in range(n) for b in range(a + 1, n) if a // 2 != b // 2 and held[a] & held[b]}
    for size in (1 << 17, 64):
        rows = near_copies._groups(met, homes, roots, size, most=8).collect()
        groups = {}
        for r in rows:
            groups.setdefault((r["f"], r["g"], r["i"], r["j"]), set()).add(r["node"])
        assert wanted <= {(a, b) for own in groups.values() for a in own for b in own if a < b}
        if size > 64:
            assert len(rows) < 6 * n  # as pairs of centres: 50 * 49 rows for the one key


def test_empty(spark):
    empty = frame(spark, [(1, "a")]).limit(0)
    assert near_copies.near_copy_groups(empty).count() == 0 and near_copies.keep_one(empty).columns == empty.columns

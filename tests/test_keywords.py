"""Keyword scans against plain containment, with many keywords and in several shards."""

import random
import time

from pyspark.sql import functions as F

from tidemark.operators import knowledge as kb
from tidemark.operators import lifecycle as lc
from tidemark.operators.keywords import keyword_hits


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hits_equal_containment(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("abc é\n") for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(None, "abcabc"), (2**60 + 1, "ab"), (7, None), (8, "")]
    words = [("".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))),) for _ in range(150)] + [("",), (None,), ("abc",), ("abc",)]
    t, k = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(words, "keyword string")
    want = sorted(((i, w) for i, text in texts for w in {w for w, in words if w} if text is not None and w in text), key=str)
    for shard in (1 << 20, 60):
        assert sorted(((r["id"], r["keyword"]) for r in keyword_hits(t, k, shard).collect()), key=str) == want
    assert keyword_hits(t, k.limit(0)).count() == 0 and keyword_hits(t.limit(0), k).count() == 0


def test_a_hundred_thousand_keywords(spark):
    """One scan a text: no nested loop, no product of texts and keywords."""
    words = spark.range(100_000).select(F.concat(F.lit("kw"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("keyword"))
    texts = spark.range(5000).select("id", F.concat(F.lit("x"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.concat(F.lit("kw"), F.lpad(((F.col("id") * 37 + i * 4001) % 100_000).cast("string"), 6, "0"))), " ")).alias("text"))
    start = time.time()
    got = keyword_hits(texts, words)
    assert got.count() == 5000 * 21 and time.time() - start < 60
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_longest_match_of_many_rules(spark):
    rules = spark.createDataFrame([("chair", 1.0), ("arm chair", 2.0), ("chai", 3.0), ("arm", 4.0), ("", 9.0)] + [(f"item {i} ", float(i)) for i in range(20_000)], "keyword string, mu double")
    df = spark.createDataFrame([(1, "old arm chair"), (2, "chair"), (3, "desk"), (4, None), (5, "an item 19999 arm"), (6, "desk")], "id int, name string")
    out = lc.longest_match(df, rules, "name", {"mu": -1.0})
    assert {r["id"]: r["mu"] for r in out.collect()} == {1: 2.0, 2: 1.0, 3: -1.0, 4: -1.0, 5: 19999.0, 6: -1.0}
    assert "NestedLoop" not in plan(out)


def test_faq_list_requests_and_repeats(spark):
    faq = spark.createDataFrame([(0, "q0", "a0", ["Chair!", "chair", "desk"]), (1, "q1", "a1", [None, "", "lamp"]), (2, "q2", "a2", [])], "pos int, question string, answer string, keywords array<string>")
    asked = spark.createDataFrame([(1, "A CHAIR and a desk"), (2, "FAQ about lamps"), (3, "nothing"), (4, None), (5, "l-a-m-p, chair")], "id long, text string")
    out = kb.faq_matches(asked, faq)
    got = {r["id"]: (r["n_faq"], r["faq"]) for r in out.collect()}
    assert {i: n for i, (n, _) in got.items()} == {1: 1, 2: 3, 5: 2}
    assert got[2][1] == "Q: q0\nA: a0\n\nQ: q1\nA: a1\n\nQ: q2\nA: a2" and got[5][1] == "Q: q0\nA: a0\n\nQ: q1\nA: a1"
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    assert kb.faq_matches(asked, faq.limit(0)).count() == 0

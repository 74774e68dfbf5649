"""Sizes, reruns and odd tables: samples of any table, batches that run again, clashing columns, large pages, whole results against brute force."""

import hashlib
import os
import re
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, decontamination, exact_dedup, html_extraction, language_id, mixing, near_copies, shared, simhash, substring_dedup, token_counts, toxicity

SF = "/root/testdata/sf0.01"
CLASHES = ["n_first", "seen", "epochs", "cut_words", "cut_key", "cut_source", "removed", "items", "row", "key", "digest", "node", "fp", "h", "place", "p_toxic", "kept", "size", "taken", "doc", "spans", "text_sha256"]


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def clashing(df):
    return df.withColumns({c: F.lit("own") for c in CLASHES})


# --- samples ---

def test_sample_takes_the_least_hashes(spark, monkeypatch):
    rows = [("a" if i % 3 else "b", f"text {i}") for i in range(3000)] + [("a", "hot")] * 5000 + [("c", "only"), (None, "none"), ("a", None)]
    df = spark.createDataFrame(rows, "lang string, text string")
    every = {(r["lang"], r["text"]): r["h"] for r in df.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h")).distinct().collect()}

    def want(k, lang):
        return {t for _, t in sorted((h, t) for (own, t), h in every.items() if own == lang)[:k]}

    for spare in (shared.SPARE, 1e-12):  # as if the table were so large that the first look finds nothing
        monkeypatch.setattr(shared, "SPARE", spare)
        got = shared.least_hashes(df, "text", 50, "lang").collect()
        for lang in "abc":
            assert sorted(r["text"] for r in got if r["kind"] == lang) == sorted(want(50, lang))
    assert shared.least_hashes(df, "text", 7).count() == 7 and shared.least_hashes(df.limit(0), "text", 7).count() == 0


def test_models_learn_from_huge_tables(spark, monkeypatch):
    """A sampling rate that would round to nothing still gives a sample, and copies of one text count once."""
    monkeypatch.setattr(shared, "SPARE", 1e-15)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert len(html_extraction.train(pages, sample_pages=20)) == 8
    text = [("the cat and the dog", "en"), ("der hund und die katze", "de")]
    model = language_id.train(spark.createDataFrame(text * 2000, "text string, lang string"), sample_rows=10)
    assert model[0] == ["de", "en"]
    with pytest.raises(Exception, match="trained weights"):
        html_extraction.extract(pages.limit(1), {}).collect()


def test_repeated_labelled_keys_are_one(spark):
    docs = documents(spark, [(1, "bad words here", "s")] * 3000 + [(1, "other", "s")] + [(i, "good text", "s") for i in range(2, 40)])
    marks = spark.createDataFrame([(i, 1, int(i == 1)) for i in range(1, 40)] * 50, "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, marks) is not None and toxicity.train(docs, marks.withColumn("doc_id", F.col("doc_id") + 1000)) is None


# --- 4 ---

def test_no_letter_is_und_and_many_languages(spark):
    rows = [("² ½ Ⅷ", "en"), ("plain text of words", "en"), ("mots de la langue", "fr")]
    model = language_id.train(spark.createDataFrame(rows * 3, "text string, lang string"))
    asked = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(asked, model).collect()}
    assert got == {0: "und", 1: "en", 2: "fr"}
    many = spark.createDataFrame([(f"word{i} zz{i % 7}", f"l{i:04d}") for i in range(1200)] + [("the cat", "en")] * 5, "text string, lang string")
    model = language_id.train(many)
    assert len(model[0]) == 1201 and "en" in model[0]  # none is left out
    assert len(language_id.train(many, most_languages=3)[0]) == 3


def test_decoding_equals_the_loss_by_hand():
    rng = np.random.default_rng(1)
    for n in (2, 4, 9):
        code, margins = language_id.code_words(n), rng.normal(size=(20, language_id.code_words(n).shape[1]))
        loss = np.array([[sum(np.log1p(np.exp(-c * m)) for c, m in zip(word, row)) for word in code] for row in margins])
        best, score, gap = language_id.decode(margins, code)
        assert (best == loss.argmin(axis=1)).all()
        assert gap == pytest.approx(np.sort(loss, axis=1)[:, 1] - loss.min(axis=1))
        assert score == pytest.approx(np.exp(-loss.min(axis=1)) / np.exp(-loss).sum(axis=1))


def test_language_query_equals_its_classifiers(spark):
    """The query's rows are those of the fitted classifiers applied text by text, without Spark."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))).select("text", "lang"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.op4_language_id(spark, SF).collect()}
    for r in docs.collect():
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert got[r["doc_id"]] == ("und", 0)
            continue
        x = next(language_id.ngram_rows([r["text"]]))
        best, score, _ = language_id.decode(x @ model[2][:-1] + model[2][-1], model[1])
        assert got[r["doc_id"]][0] == model[0][best[0]] and got[r["doc_id"]][1] == pytest.approx(score[0], abs=1e-4)


# --- 3, 5 ---

def test_a_batch_that_runs_again_keeps_its_rows(spark):
    index, rows = "digests_of_reruns", [(1, "a", "s"), (2, "b", "s"), (3, "a", "s"), (3, "a", "s")]
    one = exact_dedup.exact_dedup(documents(spark, rows), index).orderBy("doc_id").collect()
    assert exact_dedup.exact_dedup(documents(spark, rows), index).orderBy("doc_id").collect() == one and sum(r["kept"] for r in one) == 2
    named = [exact_dedup.exact_dedup(documents(spark, [(9, "a", "s"), (10, "z", "s")]), index, batch="later").orderBy("doc_id").collect() for _ in range(2)]
    assert named[0] == named[1] and [(r["kept"], r["keep_id"]) for r in named[0]] == [(False, 1), (True, 10)]
    assert spark.table(index).count() == 3


def test_repeated_key_and_text_keeps_one_row(spark):
    df = documents(spark, [(1, "a", "x")] * 40 + [(None, "b", str(i)) for i in range(30)] + [(2, "a", "y")])
    got = exact_dedup.exact_dedup(df).collect()
    assert len(got) == 71 and [r["doc_id"] for r in got if r["kept"]].count(1) == 1 and sum(r["kept"] for r in got) == 2


def test_a_doubled_append_counts_once(spark, tmp_path):
    import public_tokenizers

    path, cache = public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    df = documents(spark, [(1, "one two", "s"), (2, "one two", "s"), (3, None, "s")])
    first = sorted(token_counts.count_tokens(df, path, cache).collect())
    spark.read.parquet(cache).write.mode("append").parquet(cache)
    assert sorted(token_counts.count_tokens(df, path, cache).collect()) == first and len(first) == 3


# --- names, nulls, empty tables ---

def test_clashing_names_come_back(spark):
    df = clashing(documents(spark, [(1, "a b c d e f", "s"), (2, "a b c d e f", "t"), (2, "a b c d e f", "t"), (None, None, None), (4, "", None), (5, "g h " * 5000, "s")]))
    bench = spark.createDataFrame([(1, "zz zz zz")], "item_id long, text string")
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for own in (exact_dedup.drop_copies(df), simhash.keep_one(df), near_copies.keep_one(df), decontamination.remove_contaminated(df, bench), toxicity.drop_toxic(df, marks), substring_dedup.remove_repeats(df)):
        assert own.columns == df.columns and own.schema["text"].dataType.typeName() == "string"
        rows = own.collect()
        assert rows and all(r[c] == "own" for r in rows for c in CLASHES)
    new = {"size", "taken"}
    assert all(r[c] == "own" for r in mixing.mix_sources(df).collect() for c in CLASHES if c not in new)
    own = exact_dedup.exact_dedup(df, index="digests_of_clashes")
    assert all(r[c] == "own" for r in own.collect() for c in CLASHES if c not in exact_dedup.NEW)
    assert decontamination.contamination_report(df, bench).count() == token_counts.count_tokens(df, __import__("public_tokenizers").path("piece_bpe_32k.model")).count() == 6


def test_mix_of_columns_named_like_its_own(spark):
    names = ["__source", "__key", "__cut", "__words", "__epochs", "__0", "mix_key", "epochs", "cut_source", "cut_key", "cut_words"]
    plain = documents(spark, [(1, "a b c", "s"), (2, "d e", "t"), (3, "f " * 9, "t"), (None, None, None)])
    odd = plain.withColumns({c: F.lit("own") for c in names})
    got, want = mixing.mix_sources(odd), mixing.mix_sources(plain)
    assert got.columns == odd.columns + ["size", "source_size", "target", "taken"]
    rows = got.collect()
    assert all(r[c] == "own" for r in rows for c in names)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in rows))) == sorted(map(str, (tuple(r) for r in want.collect())))


def test_rows_that_repeat_a_key_are_judged_by_their_text(spark):
    x, y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    df = documents(spark, [(5, x, "1"), (9, y, "2"), (9, x, "3"), (9, y, "4"), (None, y, "5")])
    for keep in (simhash.keep_one, near_copies.keep_one):
        kept = sorted((r["doc_id"] or 0, r["text"]) for r in keep(df).collect())
        assert kept == [(0, y), (5, x), (9, y)]


def test_pipeline_with_odd_tables(spark, tmp_path):
    import corpus_pipeline as cp

    docs = clashing(spark.read.parquet(f"{SF}/documents.parquet").limit(60)).drop("size", "taken")
    odd = docs.limit(3).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    for name, own in (("odd", docs.unionByName(odd).unionByName(docs.limit(5))), ("empty", docs.limit(0))):
        folder = str(tmp_path / name)
        own.write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").limit(0 if name == "empty" else 1000).write.parquet(f"{folder}/{t}.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for stage_name, stage in cp.STAGES[:-1]:
            now = shared.staged(stage(spark, now, folder), stage_name)
            assert now.columns == own.columns, stage_name
        mixed = cp.run(spark, folder)
        assert (mixed.count() == 0) == (name == "empty")
        assert mixed.filter("taken > 3 * size or taken <= 0 or size = 0").count() == 0


# --- 6 ---

def test_mixing_query_equals_brute_force(spark):
    """Targets and what is taken, for the query's rows, by the rule written out in Python over the same keys."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    keys = {r["doc_id"]: r["k"] for r in docs.select("doc_id", mixing.mix_key(F.col("doc_id"), F.col("text"), 17).alias("k")).collect()}
    sizes, per = {}, {}
    for r in docs.collect():
        sizes[r["doc_id"]] = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        per.setdefault(r["source"], []).append(r["doc_id"])
    total = {s: sum(sizes[i] for i in ids) for s, ids in per.items()}
    names = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, open_, target = float(sum(total.values())), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * total[s]]
        target.update({s: 3.0 * total[s] for s in over} if over else {s: level * weight[s] for s in open_})
        left, open_ = left - sum(3.0 * total[s] for s in over), open_ - set(over) if over else set()
    taken = {}
    for s, ids in per.items():
        epochs = int(target[s] // total[s])
        rest = int(np.floor(target[s])) - epochs * total[s]
        for i in sorted(ids, key=lambda i: keys[i]):
            part = min(sizes[i], rest)
            taken[i], rest = epochs * sizes[i] + part, rest - part
    got = mixing.op6_source_mixing(spark, SF).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == taken and {r["doc_id"]: r["size"] for r in got} == sizes
    source = {i: s for s, ids in per.items() for i in ids}
    assert all(r["target"] == pytest.approx(target[source[r["doc_id"]]]) and r["source_size"] == total[source[r["doc_id"]]] for r in got)


def test_running_sums_over_many_ranges(spark):
    rows = [(i % 3 if i % 10 else None, (i * 37) % 501, i % 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "s int, k int, v long").groupBy("s", "k").agg(F.sum("v").alias("v"))
    want, seen = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r["s"] is not None, r["s"] or 0, r["k"])):
        seen[r["s"]] = seen.get(r["s"], 0) + r["v"]
        want[r["s"], r["k"]] = seen[r["s"]]
    for ranges in (1, 9, None):
        assert {(r["s"], r["k"]): r["t"] for r in shared.running_sums(df, ["k"], {"t": "v"}, "s", ranges).collect()} == want


# --- 7 ---

def test_toxicity_recall_and_false_positives(spark):
    """On labelled documents that training did not see; and the query's rows are its model's."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 4 <> 0"))
    got = toxicity.score(docs, model).join(labels.filter("doc_id % 4 = 0"), "doc_id").select("p_toxic", "toxic").toPandas()
    said = got["p_toxic"] >= 0.5
    assert (said & (got["toxic"] == 1)).sum() >= 0.85 * (got["toxic"] == 1).sum() > 0
    assert (said & (got["toxic"] == 0)).sum() <= 0.01 * (got["toxic"] == 0).sum()
    small = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(small, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in small.select("doc_id", "text").collect()}
    for r in toxicity.op7_toxicity(spark, SF).collect():
        before = np.zeros((1, 0))
        for link, name in zip(model, ("p_quality", "p_toxic")):
            _, _, at, bucket = next(toxicity.features([texts[r["doc_id"]]]))
            p = link.probability(toxicity.dense_rows(1, at, bucket, link.buckets), before)
            assert r[name] == pytest.approx(p[0], abs=1e-6)
            before = np.column_stack([before, p])
        assert r["toxic"] == (r["p_toxic"] >= 0.5)


# --- 8 ---

def words_of(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def test_matches_are_the_longest_and_stand_where_they_say(spark):
    items = {"p": " ".join(f"a{i}" for i in range(30)), "q": " ".join(f"b{i}" for i in range(12)), "r": "x y " * 20, "s": "solo", "": "null id words here"}
    a, b = items["p"].split(), items["q"].split()
    docs = {1: "lead " + " ".join(a[5:25]) + " tail", 2: " ".join(a[:12] + b), 3: "x y " * 60, 4: "solo and solo", 5: "null id words here", 6: " ".join(a[:9] + ["cut"] + a[9:]), 7: None}
    bench = spark.createDataFrame([(k or None, v) for k, v in items.items()] + [("p", items["p"])], "item_id string, text string")
    df = spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string")
    one = {r["doc_id"]: r for r in decontamination.find_contamination(df, bench).collect()}
    many = {r["doc_id"]: sorted(map(tuple, r["matches"])) for r in decontamination.find_contamination(df, bench, block_bytes=60).collect()}
    assert {i: sorted(map(tuple, r["matches"])) for i, r in one.items()} == many
    assert many[1] == [("p", 5, 1, 20)] and many[2] == [("p", 0, 0, 11), ("q", 0, 12, 23)] and many[4] == [("s", 0, 0, 0), ("s", 0, 2, 2)]
    assert many[5] == [("", 0, 0, 3)] and many[6] == [("p", 9, 10, 30)] and many[7] == []
    for i, found in many.items():
        own, hit = words_of(docs[i]), set()
        for item, start, first, last in found:
            theirs = words_of(items[item])
            assert theirs[start:start + last - first + 1] == own[first:last + 1]
            assert first == 0 or start == 0 or own[first - 1] != theirs[start - 1]
            end = start + last - first + 1
            assert last + 1 == len(own) or end == len(theirs) or own[last + 1] != theirs[end]
            hit |= set(range(first, last + 1))
        want = set()
        for item in map(words_of, items.values()):
            n = min(10, len(item))
            windows = {tuple(item[k:k + n]) for k in range(len(item) - n + 1)}
            want |= {p for k in range(len(own) - n + 1) if tuple(own[k:k + n]) in windows for p in range(k, k + n)}
        assert hit == want
    assert len(many[3]) < 10  # an item that repeats itself gives no match for every place


# --- 10 ---

LARGE = """
import resource, sys
from tidemark.llm import html_extraction as h
page = "<body>" + "".join(f"<p>short block {i}</p>" if i % 3 else f"<nav><a href='/{i}'>link {i}</a></nav>" for i in range(300000))
found = h.blocks(page)
net = h.Labeller()
p = net.page_scores(found)
assert len(found) == len(p) == 300000
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_a_page_of_300000_blocks_needs_under_a_gigabyte():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", LARGE], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": root}, check=True)
    assert int(out.stdout) < 1000


def test_slices_and_batches_score_alike(spark):
    pages = [html_extraction.blocks(r["html"]) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(12).collect()]
    net = html_extraction.Labeller()
    for page in pages:
        whole = net.scores(*html_extraction.padded([html_extraction.vectors(page)]))[0]
        assert net.page_scores(page, cells=3) == pytest.approx(whole, abs=1e-5)
    assert sorted(i for own in html_extraction.batched(pages, 4, 40) for i in own) == [i for i, p in enumerate(pages) if p]
    deep = html_extraction.blocks("<div class='a'>" * 20000 + "x" + "<div>y" * 2000)
    assert len(deep) == 2001 and max(len(path) for path, _, _ in deep) <= 2 * (html_extraction.OUTER + html_extraction.INNER)


def test_layouts_whose_names_training_never_saw():
    """Trained on half of the pages; in the other half every name that tells a block's role is replaced by one without meaning."""
    pages = pd.read_parquet(f"{SF}/pages.parquet")["html"].tolist()
    net, right, said, there = html_extraction.fit(sorted(pages[:125])), 0, 0, 0
    for page in pages[125:]:
        odd = page.replace('class="ad"', 'class="zq4"')
        for tag, name in (("nav", "zq1"), ("article", "zq2"), ("footer", "zq3")):
            odd = odd.replace(f"<{tag}>", f'<div class="{name}">').replace(f"</{tag}>", "</div>")
        want = np.array([html_extraction.markup_label(path) == 1 for path, _, _ in html_extraction.blocks(page)])
        got = net.page_scores(html_extraction.blocks(odd)) >= 0.5
        right, said, there = right + (got & want).sum(), said + got.sum(), there + want.sum()
    assert right >= 0.95 * there and right >= 0.99 * said


# --- 2 ---

def test_chat_edges(spark):
    rows = [(1, "chosen", 0, "user", None), (1, "rejected", 0, "user", None), (1, "chosen", 1, "assistant", ""), (1, "rejected", 1, "assistant", "w " * 50000), (2, "chosen", None, None, None), (None, "chosen", 0, "user", "x")]
    rows += [(3, side, 0, "user<|im_end|>", "q") for side in ("chosen", "rejected")]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").withColumns({"same": F.lit("own"), "n_common": F.lit("own"), "chosen": F.lit("own")})
    got = {r["pair_id"]: r for r in chat_format.format_preferences(df).collect()}
    assert set(got) == {1, 2, 3} and got[3]["prompt"].count("<|im_end|>") == 1
    assert got[1]["n_common"] == 1 and got[2]["n_common"] == 0 and got[2]["rejected"] == ""
    assert len(got[1]["rejected"]) > 100000 and hashlib.sha256(got[1]["prompt"].encode()).hexdigest()


def test_near_copies_recall_on_a_larger_table(spark):
    """All pairs of similarity 0.8 of sf0.1, found by rare shingles in plain Python, end in one group."""
    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").drop_duplicates("text")
    sets = {}
    for i, t in zip(docs["doc_id"], docs["text"]):
        w = (t or "").encode().lower().split()
        sets[i] = {hash(tuple(w[k:k + 5])) for k in range(max(1, len(w) - 4))} if w else set()
    count = {}
    for s in sets.values():
        for g in s:
            count[g] = count.get(g, 0) + 1
    held, near = {}, []
    for i, s in sets.items():
        rare = sorted(s, key=lambda g: (count[g], g))[:len(s) - int(np.ceil(0.8 * len(s) - 1e-9)) + 1]
        for j in {j for g in rare for j in held.get(g, ())}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]) - 1e-9:
                near.append((i, j))
        for g in rare:
            held.setdefault(g, []).append(i)
    group = {r["doc_id"]: r["component_id"] for r in near_copies.near_copy_groups(spark.createDataFrame(docs[["doc_id", "text"]])).collect()}
    found = sum(group[a] == group[b] for a, b in near)
    print(f"near copies: {found} of {len(near)} pairs in one group")
    assert len(near) > 30 and found == len(near)
    partner = {i for pair in near for i in pair}
    assert sum(i != g and i not in partner for i, g in group.items()) <= 0.01 * len(group)


# --- 3: the index between jobs ---

def test_index_keeps_its_buckets_and_its_folder(spark):
    """A second batch under another number of shuffle partitions, then one in a session whose catalog has forgotten the table."""
    name = "digest_index_of_jobs"
    rows = lambda *texts: documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        assert exact_dedup.exact_dedup(rows("a", "b", "a"), name).filter("kept").count() == 2
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert [r["doc_id"] for r in exact_dedup.exact_dedup(rows("b", "c"), name).filter("kept").collect()] == [1]
        at, system = exact_dedup._folder(spark, name)
        held = f"{at}-held"
        system.rename(at, spark._jvm.org.apache.hadoop.fs.Path(held))
        spark.sql(f"DROP TABLE {name}")  # the catalog's entry, not the files
        system.rename(spark._jvm.org.apache.hadoop.fs.Path(held), at)
        assert not spark.catalog.tableExists(name)
        assert sorted(r["doc_id"] for r in exact_dedup.exact_dedup(rows("c", "d", "a"), name).filter("kept").collect()) == [1]
        assert exact_dedup.ensure_index(spark, name, 99, "bigint") == 4
        with pytest.raises(ValueError, match="keys of type"):
            exact_dedup.ensure_index(spark, name, 4, "string")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_keys_of_any_type(spark):
    rows = [("b", "x"), ("a", "x"), ("c", "y"), (None, "x"), ("a", "x")]
    got = sorted((r["doc_id"] or "", r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == [("", "a", 4, False), ("a", "a", 4, False), ("a", "a", 4, True), ("b", "a", 4, False), ("c", "c", 1, True)]


# --- 10: elements that hold article text, and ones left open ---

def test_formulas_and_open_elements():
    text = lambda page: [b[1] for b in html_extraction.blocks(page)]
    assert text("<p>E is <math><mrow><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow></math> here</p>") == ["E is mc2 here"]
    assert text("<p>a <object><b>b</b></object> c <canvas>d</canvas> e</p>") == ["a b c d e"]
    for tag in ("select", "svg", "iframe", "template"):
        assert text(f"<p>before</p><{tag}><p>after</p>")[-1] == "after"
        assert text(f"<p>before</p><{tag}>hidden</{tag}><p>after</p>") == ["before", "after"]
    for tag in ("script", "style", "textarea"):
        assert text(f"<p>before</p><{tag}><p>hidden</p>") == ["before"]

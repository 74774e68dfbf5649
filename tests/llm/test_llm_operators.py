"""Dealt operators against brute force, and their edges: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import html
import random
import re
import sys
import os

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import assert_same  # noqa: E402

from tidemark.llm import chat_format, components, decontamination, exact_dedup, html_extraction, language_id, mixing, registry, simhash, substring_dedup, token_counts, toxicity  # noqa: E402

DOCS = "doc_id long, text string, source string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "s")[:3] if len(r) == 2 else r for r in rows], DOCS)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, small, name):
    assert_same(registry.QUERIES[name](spark, small), registry.SQL[name], small)


def load(spark, small, name):
    return spark.read.parquet(f"{small}/{name}.parquet").toPandas()


# --- 1 ---

def brute_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(keys, prints, radius):
    near = [[j for j in range(len(keys)) if (prints[i] ^ prints[j]).bit_count() <= radius] for i in range(len(keys))]
    label = list(keys)
    while True:
        new = [min(label[j] for j in near[i]) for i in range(len(keys))]
        if new == label:
            return label
        label = new


def test_simhash_equals_brute_force(spark, small):
    docs = load(spark, small, "documents")
    prints = [brute_fingerprint(t, 3) for t in docs["text"]]
    want = dict(zip(docs["doc_id"], zip(prints, brute_components(list(docs["doc_id"]), prints, 3))))
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.op1_simhash(spark, small).collect()}
    assert got == want


@pytest.mark.parametrize("radius,bucket", [(3, 256), (3, 2), (5, 4)])
def test_covering_misses_no_pair(spark, radius, bucket):
    rng = random.Random(radius * bucket)
    centre = rng.getrandbits(64)
    prints = sorted({centre, *(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius))) for _ in range(150)), *(rng.getrandbits(64) for _ in range(100)), 0, (1 << 64) - 1})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] for r in components.connected_components(simhash.near_edges(df, radius, bucket)).collect()}
    groups = {}
    for p, label in zip(prints, brute_components(prints, prints, radius)):
        groups.setdefault(label, []).append(p)
    for members in groups.values():
        assert len({roots.get(p, p) for p in members}) == 1
    assert len({roots[m[0]] for m in groups.values() if len(m) > 1}) == sum(len(m) > 1 for m in groups.values())


def test_simhash_edges(spark):
    rows = [(5, None), (3, ""), (None, "a b c d e f g h"), (9, "A b c d e f g h"), (9, "a b c d e f g h"), (1, "x " * 30000)]
    df = documents(spark, rows).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit("clash"))
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(df).collect()]
    assert len(got) == 6
    assert {g[2] for g in got if g[1] == "0" * 16} == {3}
    assert {g[2] for g in got if g[0] in (9, None)} == {9}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in kept.collect())[-1][0] == 9 and kept.filter("doc_id = 9").count() == 1 and kept.filter("doc_id = 5").count() == 0
    assert simhash.simhash_groups(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (300, 301), (301, 300)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 301: 300}


# --- 2 ---

def turns(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")


def test_preferences(spark):
    same = [(1, s, t, r, x) for s in ("chosen", "rejected") for t, r, x in ((0, "user", "q"), (1, "assistant", None))]
    rows = same + [(1, "chosen", 2, "user", "u"), (1, "chosen", 3, "assistant", "yes<|im_end|>"), (1, "rejected", 2, "assistant", "no")]
    rows += [(2, "chosen", 0, "user", "alone"), (3, "chosen", 0, None, "x"), (3, "rejected", 0, None, "x")]
    got = {r["pair_id"]: r for r in chat_format.format_preferences(turns(spark, rows).withColumn("prompt", F.lit("clash"))).collect()}
    assert got[1]["n_common"] == 2 and got[1]["prompt"].count("<|im_start|>") == 2
    a, b = map(int, got[1]["chosen_mask"].split("-"))
    assert got[1]["chosen"][a:b] == "yes< im_end|><|im_end|>"
    a, b = map(int, got[1]["rejected_mask"].split("-"))
    assert got[1]["rejected"][a:b] == "no<|im_end|>"
    assert (got[2]["prompt"], got[2]["rejected"], got[2]["rejected_mask"], got[2]["n_common"]) == ("", "", "", 0)
    assert got[3]["n_common"] == 1 and got[3]["chosen"] == "" and "unknown" in got[3]["prompt"]
    assert chat_format.format_preferences(turns(spark, rows).limit(0)).count() == 0


# --- 3 ---

def test_exact_dedup_edges(spark):
    rows = [(2, "a  b"), (1, "a\tb"), (7, None), (6, ""), (8, " "), (1, "a b"), (None, "c"), (4, "c"), (None, "d"), (None, "d"), (11, "y " * 40000)]
    df = documents(spark, rows).withColumn("kept", F.lit("clash"))
    got = exact_dedup.exact_dedup(df).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 6
    one = [r for r in got if r["doc_id"] in (1, 2)]
    assert {r["keep_id"] for r in one} == {1} and {r["group_size"] for r in one} == {3} and sum(r["kept"] for r in one) == 1
    assert one[0]["text_sha256"] == hashlib.sha256(b"a b").hexdigest()
    assert {r["keep_id"] for r in got if r["doc_id"] in (6, 7)} == {6} and {r["keep_id"] for r in got if r["text"] == "c"} == {4}
    assert exact_dedup.drop_copies(df).columns == df.columns and exact_dedup.drop_copies(df).count() == 6
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_exact_dedup_across_batches(spark):
    index = "digests_of_batches"
    first = exact_dedup.drop_copies(documents(spark, [(1, "a"), (2, "b"), (3, "a")]), index)
    assert sorted(r["doc_id"] for r in first.collect()) == [1, 2]
    second = exact_dedup.exact_dedup(documents(spark, [(0, "a"), (5, "c"), (6, "c")]), index).collect()
    assert {r["doc_id"]: (r["kept"], r["keep_id"]) for r in second} == {0: (False, 1), 5: (True, 5), 6: (False, 5)}
    assert spark.table(index).count() == 3


# --- 4 ---

def test_language_id_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = language_id.op4_language_id(spark, folder).toPandas().merge(load(spark, folder, "documents")[["doc_id", "lang"]], on="doc_id")
    held = got[got["held_out"]]
    assert len(got) == 1000 and 0.15 < len(held) / len(got) < 0.35
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_language_id_edges(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(20)] + [(i, "der hund und die katze", "de") for i in range(20, 40)] + [(41, None, "en"), (42, "123 !!", "de"), (43, "und der", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language_id.train(df.select("text", "lang"))
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert got[0]["lang_pred"] == "en" and got[25]["lang_pred"] == "de" and got[43]["lang_pred"] == "de"
    assert got[41]["lang_pred"] == got[42]["lang_pred"] == "und" and got[41]["score"] == 0
    assert language_id.train(df.select("text", "lang").limit(0)) is None
    assert {r["lang_pred"] for r in language_id.identify(df, None).collect()} == {"und"}
    alone = language_id.train(df.filter("lang = 'en'").select("text", "lang"))
    assert language_id.identify(df.limit(1), alone).first()["lang_pred"] == "en"
    assert language_id.identify(df.limit(0), model).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 30])
def test_code_words_differ(n):
    code = language_id.code_words(n)
    apart = ((code.shape[1] - code @ code.T) / 2)[~np.eye(n, dtype=bool)]
    assert apart.min() >= 1 and len({tuple(c) for c in code}) == n


# --- 5 ---

def test_token_counts_and_cache(spark, tmp_path):
    import public_tokenizers
    import sentencepiece

    path, cache = public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    rows = [(1, "Hello  world"), (2, "Hello  world"), (3, None), (4, ""), (None, "été <s> \n x"), (6, "long words " * 5000)]
    df = documents(spark, rows).withColumn("digest", F.lit("clash"))
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(df, path, cache).collect()}
    assert got == {k: (len((t or "").encode()), len(own.encode(t or "")), len(own.encode(t or "")) > 4096) for k, t in rows}
    before = spark.read.parquet(cache).count()
    assert before == 4
    assert token_counts.count_tokens(df, path, cache).count() == 6 and spark.read.parquet(cache).count() == before
    assert token_counts.count_tokens(df, public_tokenizers.path("byte_bpe_50k.json"), cache).filter("doc_id = 1").first()["n_tokens"] > 0
    assert token_counts.count_tokens(df.limit(0), path).count() == 0


def test_token_query(spark, small):
    import public_tokenizers
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: len(own.encode(t)) for i, t in load(spark, small, "documents")[["doc_id", "text"]].itertuples(index=False)}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.op5_token_counts(spark, small).collect()} == want


# --- 6 ---

def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return {**out, **{s: level * weight[s] for s in open_}}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            open_.remove(s)


def test_mixing_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a"] * 8 + ["b", "c", None])) for i in range(600)] + [(1000 + i, "one two three", "tiny") for i in range(2)]
    rows += [(5000, None, "b"), (5001, "", "void"), *[(7, "tie tie tie tie", "a")] * 5]
    df = spark.createDataFrame(rows, DOCS).withColumn("taken", F.lit("clash"))
    got = mixing.mix_sources(df, rows_per_range=8).toPandas()
    sizes = got.groupby("source", dropna=False)["size"].sum()
    sizes = {None if s != s else s: int(v) for s, v in sizes.items()}
    want = brute_targets(sizes)
    for name, part in got.groupby("source", dropna=False):
        name = None if name != name else name
        assert part["target"].iloc[0] == pytest.approx(want[name]) and part["source_size"].iloc[0] == sizes[name]
        assert want[name] - 6 <= part["taken"].sum() <= want[name] + 1e-6
    assert (got["taken"] <= 3 * got["size"]).all() and len(got) == len(rows)
    again = mixing.mix_sources(df, rows_per_range=200).toPandas()
    order = ["doc_id", "size", "taken"]
    assert got.sort_values(order)[order].reset_index(drop=True).equals(again.sort_values(order)[order].reset_index(drop=True))
    assert mixing.mix_sources(df.limit(0)).count() == 0


# --- 7 ---

def test_toxicity(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "house", "tree"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = [rng.choice(words) for _ in range(30)] + (["vileword", "vilest"] if bad else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(not bad or i % 2), int(bad)))
    rows += [(900, None), (901, ""), (902, "a vileword here " + "tree " * 20000), (902, "a vileword here"), (903, "a tree")]
    docs = documents(spark, rows).withColumn("p_toxic", F.lit("clash"))
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = toxicity.score(docs, model).toPandas()
    bad = got["doc_id"].map(lambda i: i < 600 and i % 5 == 0 or i == 902)
    assert ((got["p_toxic"] >= 0.5) == bad).all() and len(got) == len(rows)
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == int((~bad).sum())
    assert toxicity.train(docs, marks.limit(0)) is None
    assert set(toxicity.score(docs, None).toPandas()["p_toxic"]) == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 4 <> 0"))
    got = toxicity.score(docs, model).join(labels.filter("doc_id % 4 = 0"), "doc_id").select("p_toxic", "toxic").toPandas()
    assert ((got["p_toxic"] >= 0.5) & (got["toxic"] == 0)).sum() <= 1


# --- 8 ---

def test_decontamination_blocks_and_edges(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = documents(spark, [(1, f"x {item.upper()} y"), (1, f"x {item.upper()} y"), (2, "short item here"), (3, None), (4, ""), (None, "short-ITEM"), (6, item[:-7]), (7, ("pad " * 3 + item + " ") * 500), (8, "one two three")])
    docs = docs.withColumn("items", F.lit("clash")).withColumn("row", F.lit("clash"))
    bench = spark.createDataFrame([(10, item), (9, "Short item"), (11, item), (12, None), (13, "!!"), (None, "nine ten eleven twelve thirteen")], "item_id long, text string")
    one = decontamination.contamination_report(docs, bench).collect()
    many = decontamination.contamination_report(docs, bench, block_bytes=40).collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and len(one) == 9
    by = {r["doc_id"]: r for r in one}
    assert (by[1]["n_words"], by[1]["n_hit"], by[1]["n_items"], by[1]["items_sha256"]) == (13, 11, 2, hashlib.sha256(b"10,11").hexdigest())
    assert by[2]["n_hit"] == 2 and by[None]["n_hit"] == 2 and by[6]["n_hit"] == 10 and by[7]["n_hit"] == 5500
    assert not by[3]["contaminated"] and by[3]["n_words"] == 0 and not by[8]["contaminated"] and by[8]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    kept = decontamination.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 8]
    assert decontamination.contamination_report(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.contamination_report(docs.limit(0), bench).count() == 0


# --- 9 ---

def bag(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def test_substring_dedup_finds_every_long_passage(spark):
    folder = "/root/testdata/sf0.01"
    docs = load(spark, folder, "documents")
    got = set(substring_dedup.op9_substring_dedup(spark, folder).toPandas()["doc_id"])

    def sharing(n):
        seen = {}
        for i, t in zip(docs["doc_id"], docs["text"]):
            w = bag(t)
            for k in range(len(w) - n + 1):
                seen.setdefault(tuple(w[k:k + n]), set()).add(i)
        return set().union(*(v for v in seen.values() if len(v) > 1))

    assert sharing(50) <= got
    near = {i for i in got - sharing(24)}
    assert len(near) <= 5  # lines of similarity 0.8 or more without a common window


def test_passages_equal_brute_force(spark):
    """Every word that lies in a run of 50 words shared with another document is reported, and no other; later places go, first ones stay."""
    folder = "/root/testdata/sf0.01"
    docs = {i: bag(t) for i, t in load(spark, folder, "documents")[["doc_id", "text"]].itertuples(index=False)}
    places = {}
    for i, w in docs.items():
        for k in range(len(w) - 49):
            places.setdefault(tuple(w[k:k + 50]), []).append((i, k))
    want = {}
    for found in places.values():
        if len({i for i, _ in found}) > 1:
            for i, k in found:
                want.setdefault(i, set()).update(range(k, k + 50))
    rows = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("doc"), "text")
    windows = substring_dedup.units(rows).filter("bands is null").select("h", "doc", "pos")
    got, gone = {}, {}
    for r in substring_dedup.passage_spans(windows, rows).collect():
        got.setdefault(r["doc"], set()).update(range(r["pos"], r["pos"] + r["len"]))
        if not r["stays"]:
            gone.setdefault(r["doc"], set()).update(range(r["pos"], r["pos"] + r["len"]))
    assert got == want
    left = {w for i, ws in docs.items() for k, w in enumerate(ws) if k not in gone.get(i, ())}
    assert gone and all(w in left for ws in docs.values() for w in ws)  # what goes stays in an earlier place


def test_passages_of_three_documents_and_large_buckets(spark):
    """A passage whose windows come first in different documents is still found whole; lines of one large bucket link as in small ones."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    lone = lambda n: [word() for _ in range(n)]
    passage = lone(53)
    rows = [(1, " ".join(lone(40) + passage[:40] + lone(40))), (2, " ".join(lone(30) + passage + lone(30))), (3, " ".join(lone(20) + passage + lone(50))), (4, " ".join(lone(20) + passage[10:] + lone(20)))]
    df = documents(spark, rows)
    found = {r["doc"]: (r["n_repeated"], r["removed"]) for r in substring_dedup.repeat_report(substring_dedup.repeated_spans(df)).collect()}
    assert found == {2: (53, ""), 3: (53, "20-72")}
    base = lone(40)
    lines = [" ".join(w if rng.random() > 0.02 else word() for w in base) for _ in range(60)] + [" ".join(base[:20] + lone(20)) for _ in range(5)]
    df = documents(spark, [(i, t) for i, t in enumerate(lines)])
    whole = {(r["doc"], r["pos"], r["first_doc"]) for r in substring_dedup.repeated_spans(df).collect()}
    assert len(whole) > 20 and {(r["doc"], r["pos"], r["first_doc"]) for r in substring_dedup.repeated_spans(df, block=3).collect()} == whole
    with pytest.raises(ValueError):
        substring_dedup.repeated_spans(df, passage=40)


def test_line_recall(spark):
    """Of all pairs of similar lines, by brute force, at least 99 % end in one cluster."""
    folder = "/root/testdata/sf0.01"
    docs = load(spark, folder, "documents")
    lines = {}
    for i, t in zip(docs["doc_id"], docs["text"]):
        at = 0
        for line in (t or "").split("\n"):
            w = bag(line)
            if len(w) >= substring_dedup.LEAST:
                lines[i, at] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
            at += len(w)
    held = {}
    for key, s in lines.items():
        for g in s:
            held.setdefault(g, []).append(key)
    pairs = {(a, b) for keys in held.values() for n, a in enumerate(keys) for b in keys[n + 1:] if a[0] != b[0]}
    near = [(a, b) for a, b in pairs if len(lines[a] & lines[b]) >= 0.8 * len(lines[a] | lines[b]) - 1e-9]
    spans = substring_dedup.repeated_spans(spark.read.parquet(f"{folder}/documents.parquet"))
    cluster = {}
    for r in spans.collect():
        cluster.setdefault((r["doc"], r["pos"]), set()).add(r["cluster"])
    assert len(near) > 20 and sum(bool(cluster.get(a, set()) & cluster.get(b, set())) for a, b in near) >= 0.99 * len(near)


def test_substring_dedup_lines_and_edges(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line = [word() for _ in range(60)]
    near = [w if i != 30 else "changed" for i, w in enumerate(line)]
    passage = [word() for _ in range(55)]
    lone = lambda n=80: " ".join(word() for _ in range(n))
    rows = [(1, lone() + "\n" + " ".join(line)), (2, " ".join(near) + "\n" + lone()), (3, lone(7) + " " + " ".join(passage) + " " + lone(9)), (4, lone(50) + " " + " ".join(passage).upper()),
            (5, lone()), (6, None), (7, ""), (None, " ".join(passage)), (8, " ".join(line)), (8, " ".join(line)), (9, "short")]
    df = documents(spark, rows).withColumn("removed", F.lit("clash"))
    found = {r["doc"]: r for r in substring_dedup.repeat_report(substring_dedup.repeated_spans(df)).collect()}
    assert set(found) == {1, 2, 3, 4, 8}
    assert found[2]["n_removed"] == 60 and found[8]["n_removed"] == 60 and found[8]["class_id"] == 1 and found[1]["n_removed"] == found[3]["n_removed"] == 0 and found[4]["n_removed"] >= 24
    small_blocks = substring_dedup.repeated_spans(df, block=1)
    assert {r["doc"] for r in small_blocks.select("doc").collect()} == set(found)
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(df.drop("removed")).collect()}
    assert 8 not in cut and "changed" not in cut[2] and cut[5] == rows[4][1] and cut[6] is None
    assert substring_dedup.repeat_report(substring_dedup.repeated_spans(df.limit(0))).count() == 0


# --- 10 ---

def test_blocks_of_broken_markup():
    page = """<html><head><title>no</title></head><body><p>a &amp; b<br>c<p>d <b>e<p>f</b><ul><li>g<li>h &lt;3</ul><script>var t="</p>";</script><!-- > x --><div title="a>b">i < j</div><table><tr><td>k<td>l</table>"""
    assert [t for _, t, _ in html_extraction.blocks(page)] == ["a & b c", "d e", "f", "g", "h <3", "i < j", "k", "l"]
    for odd in ("", None, "<", "<p", "<!--", "<script>", "</p></div>", "&amp;", "<a href='x", "<p " + "'" * 2000, "<" * 3000, "<!" * 2000, "<div>" * 3000):
        html_extraction.blocks(odd)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = html_extraction.Labeller()
    net.w = {k: w.astype(np.float64) for k, w in net.w.items()}
    x, mask = rng.normal(size=(2, 4, html_extraction.WIDTH)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], dtype=float)
    y = rng.integers(0, 2, (2, 4)).astype(float)

    def loss():
        p = net.scores(x, mask)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    grads = net.gradients(x, mask, y)
    for k in ("xf", "hb", "cf", "o", "oc"):
        at = tuple(rng.integers(0, s) for s in net.w[k].shape)
        old = net.w[k][at]
        net.w[k][at] = old + 1e-3
        up = loss()
        net.w[k][at] = old - 1e-3
        down = loss()
        net.w[k][at] = old
        assert grads[k][at] == pytest.approx((up - down) / 2e-3, abs=2e-4), k


def test_extraction_of_all_pages(spark):
    folder = "/root/testdata/sf0.01"
    pages = load(spark, folder, "pages").set_index("page_id")["html"]
    got = html_extraction.op10_html_extraction(spark, folder).toPandas()
    assert len(got) == len(pages)
    right = 0
    for r in got.itertuples():
        main = re.sub(r"<footer>.*", "", re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1], flags=re.S)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1)>", main)]
        right += r.text == "\n\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)
    assert right / len(got) >= 0.98


def test_extraction_of_other_layouts_and_edges(spark):
    folder = "/root/testdata/sf0.01"
    weights = html_extraction.train(spark.read.parquet(f"{folder}/pages.parquet"))
    page = """<body><header><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies</p></div><main><article><h1>Title words here</h1><p>First part of the text.</p><p>Second part of the text.</p>
    <aside>side note</aside><form><label>Mail</label></form></article></main><div class="sidebar"><a href="/x">more</a></div><section class="comments"><p>Nice post!</p></section><footer><p>(c) me</p></footer>"""
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "u", ""), (4, "u", "<p>" + "word " * 50000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extraction.extract(df, weights).collect()
    assert len(got) == 5
    assert {r["text"] for r in got if r["page_id"] == 1} == {"Title words here\n\nFirst part of the text.\n\nSecond part of the text."}
    assert {r["text"] for r in got if r["page_id"] in (2, None)} == {""}
    assert html_extraction.extract(df.limit(0), weights).count() == 0
    assert html_extraction.train(df.limit(0)) == {}


# --- pipeline ---

def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = None
    for i, (name, stage) in enumerate(cp.STAGES):
        after = stage(spark, docs, folder)
        if i + 1 < len(cp.STAGES):
            assert after.columns == docs.columns, name
        after = after.cache()
        ids, old = {r["doc_id"] for r in after.select("doc_id").collect()}, docs.toPandas()
        assert ids <= set(old["doc_id"]) and ids
        if name == "exact_dedup":
            first = old.assign(n=old["text"].fillna("").str.replace(r"[\x20\x09-\x0D]+", " ", regex=True)).groupby("n")["doc_id"].min()
            assert ids == set(first)
        if name == "near_dedup":
            grams = {i: shingles5(t) for i, t in zip(old["doc_id"], old["text"])}
            near = [(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) >= cp.SIMILARITY * len(grams[a] | grams[b])]
            least = {i: i for i in grams}
            for _ in grams:  # smallest document that a chain of near pairs reaches
                new = dict(least)
                for a, b in near:
                    new[a] = new[b] = min(new[a], new[b])
                if new == least:
                    break
                least = new
            assert ids == {i for i, root in least.items() if i == root}  # one of each group stays, and nothing else goes
        if name == "decontamination":
            items = [bag10(t) for t in pd.read_parquet(f"{folder}/benchmark.parquet")["text"]]
            wins = {tuple(w[k:k + min(10, len(w))]) for w in items if w for k in range(len(w) - min(10, len(w)) + 1)}
            sizes = {len(w) for w in wins}
            bad = {i for i, t in zip(old["doc_id"], old["text"]) for w in [bag10(t)] for n in sizes for k in range(len(w) - n + 1) if tuple(w[k:k + n]) in wins}
            assert ids == set(old["doc_id"]) - bad
        docs, before = after.select(docs.columns), ids
    assert cp.run(spark, folder).count() > 0
    assert before


def shingles5(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def bag10(text):
    return bag(text)

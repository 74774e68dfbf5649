"""Spelling variants, periodic runs and repeated byte strings: against plain Python versions, SQL, and odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
from oracle import assert_same
from pyspark.sql import functions as F

from tidemark.llm import periodic_runs as pr
from tidemark.llm import spelling_variants as sv
from tidemark.llm import suffix_dedup as sd

SMALL = "/root/testdata/sf0.001"
CLASHES = ["run", "bucket", "word", "n", "runs", "collapsed", "n_words", "id", "k", "removed", "kept", "n_bytes", "spans", "__id", "__found", "__0"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def clashing(df):
    return df.withColumns({c: F.lit("own") for c in CLASHES})


# --- 11: spelling variants ---

def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(counts, ratio=2):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def grouped(df, **options):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in sv.group_variants(df, **options).collect())


def test_variants_equal_brute_force(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))): rng.randint(1, 40) for _ in range(500)}
    words |= {"straße" * 40: 3, "straße" * 40 + "n": 9, "x" * 300: 2, "日本語の": 1, "日本語": 7, "a😀b": 2, "ab": 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    for options in ({}, {"bucket": 4, "tile": 7}, {"bucket": 1}):  # large buckets are divided down to one free code point
        assert grouped(df, **options) == variants(words)


def test_variants_of_one_hot_bucket(spark):
    """Words with one first half: thousands in a bucket, divided by what follows; no pair is lost."""
    rng = random.Random(6)
    words = {"prefix" + "".join(rng.choice("abcdefgh") for _ in range(6)): rng.randint(1, 9) for _ in range(3000)}
    got = {w: (form, near) for w, form, _, _, near, _ in grouped(spark.createDataFrame(list(words.items()), "word string, n long"), bucket=64)}
    for w in rng.sample(sorted(words), 150):
        near = [x for x in words if one_edit(w, x)]
        assert got[w][1] == len(near)
        best = min(near, key=lambda x: (-words[x], x), default=None)
        assert got[w][0] == (best if best and words[best] >= 2 * words[w] else None)


def test_chains_of_forms(spark):
    chain = {"a" * i + "b" * (40 - i): 2 ** i for i in range(1, 40)}
    assert grouped(spark.createDataFrame(list(chain.items()), "word string, n long")) == variants(chain)


def test_slips_and_counts(spark):
    rows = [(i, "Straße STRASSE naïve-über don't 12abc ÀÉ x×y÷z") for i in range(400)] + [(None, "Straße"), (7, None), (8, ""), (9, "99 !!")]
    df = clashing(frame(spark, rows))
    runs = sv.letter_runs(df)
    got = {(r["key"], r["run"], r["w"]): r["c"] for r in runs.select("key", "run", sv.with_slips(runs).alias("w")).groupBy("key", "run", "w").agg(F.count("*").alias("c")).collect()}
    want = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]
            want[i, run, word] = want.get((i, run, word), 0) + 1
    assert got == want and any(a != b for _, a, b in got)
    counted = {r["word"]: r["n"] for r in sv.word_counts(runs, F.col("run")).collect()}
    assert counted == {"straße": 401, "strasse": 400, "naïve": 400, "x×y÷z": 400}


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert grouped(empty) == []
    assert grouped(spark.createDataFrame([(None, 3), ("alone", 1)], "word string, n long")) == [("alone", None, "alone", 1, 0, None)]


def test_variant_query_equals_sql(spark):
    assert_same(sv.op11_spelling_variants(spark, SMALL), sv.OP11_SQL, SMALL)


# --- 12: periodic runs ---

def brute_runs(words, least=6, times=4):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(least, times * q) and i > s:
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def looped(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc).encode()), len(words)
    g = h // 10
    if h % 10 or not n or doc is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute_row(words):
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_equal_brute_force(spark):
    rng = random.Random(2)
    texts = ["", None, " \t\n", "a", "a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", "x " + "a b c " * 4 + "a b", "Ab ab " * 9, "é ü " * 40 + "é"]
    for _ in range(500):
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 4))]
        words = [rng.choice("abc") for _ in range(rng.randint(0, 10))]
        for _ in range(rng.randint(1, 3)):
            words += unit * rng.randint(1, 9) + unit[:rng.randint(0, len(unit))] + [rng.choice("abcd") for _ in range(rng.randint(0, 5))]
        texts.append(" ".join(words))
    df = clashing(frame(spark, list(enumerate(texts)))).drop("runs", "collapsed", "n_words")
    for least, times in ((6, 4), (2, 2), (10, 3)):
        got = {r["doc_id"]: r for r in pr.periodic_runs(df, least=least, times=times).collect()}
        assert len(got) == len(texts) and got[0]["run"] == "own"
        for i, text in enumerate(texts):
            words = (text or "").split()
            runs = [(r["start"], r["length"], r["period"]) for r in got[i]["runs"]]
            assert runs == brute_runs(words, least, times), (text, least, times)
            gone = {j for s, n, q in runs for j in range(s + q, s + n)}
            assert got[i]["n_words"] == len(words) and got[i]["collapsed"] == " ".join(w for j, w in enumerate(words) if j not in gone)


def test_long_runs_take_little_time(spark):
    """Pairs within a run are not listed: one word 100,000 times, a long period, many runs of one word between different words."""
    texts = ["a " * 100000, " ".join(f"w{i}" for i in range(12000)) + " " + " ".join(f"w{i % 5000}" for i in range(21000)), " ".join(f"n{i} " + "a " * 40 for i in range(2000))]
    got = {r["doc_id"]: [(x["start"], x["length"], x["period"]) for x in r["runs"]] for r in pr.periodic_runs(frame(spark, list(enumerate(texts)))).collect()}
    assert got[0] == [(0, 100000, 1)] and got[1] == [(12000, 21000, 5000)] and len(got[2]) == 2000


def test_run_query_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in pr.op12_periodic_runs(spark, SMALL).collect()}
    assert len(got) == len(docs) and sum(r[0] > 0 for r in got.values()) > 5
    for doc, text in zip(docs["doc_id"], docs["text"]):
        assert got[doc] == brute_row(looped(int(doc), text))


def test_loops_of_odd_rows(spark):
    tenth = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, t) for i in tenth[:40] for t in ("", None, " ", "one", " a  b\tc\nd e f g h i j")] + [(None, "a b c"), (None, None)]
    got = [r["t"] for r in frame(spark, rows).select(pr.with_loops(frame(spark, rows)).alias("t")).collect()]
    assert [None if t is None else t.split() for t in got] == [None if t is None else t.split() if i is None else looped(i, t) for i, t in rows]
    assert pr.periodic_runs(frame(spark, [])).count() == 0


# --- 13: repeated byte strings ---

def brute_bytes(texts, length):
    raws, seen = [(t or "").encode() for t in texts], {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i:i + length]] = seen.get(r[i:i + length], 0) + 1
    out = []
    for r in raws:
        edge = np.zeros(len(r) + 1, dtype=int)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        gone = np.cumsum(edge)[:len(r)] > 0
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), np.frombuffer(r, dtype=np.uint8)[~gone].tobytes()))
    return out


def removed(df, **options):
    return {r["row"]: (r["n_bytes"], sum(x["stop"] - x["start"] for x in r["removed"]), len(r["removed"]), bytes(r["kept"])) for r in sd.remove_repeated_bytes(df, **options).collect()}


def test_expansion_equals_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(300):
        length, letters = int(rng.integers(2, 40)), int(rng.integers(1, 4))
        raws = [bytes(rng.integers(97, 97 + letters, int(rng.integers(0, 150))).astype(np.uint8)) for _ in range(int(rng.integers(1, 9)))]
        if trial % 2:
            raws.append(raws[0][:70] + raws[-1][5:])
        weights, count = rng.integers(1, 3, len(raws)), {}
        for r, w in zip(raws, weights):
            for i in range(len(r) - length + 1):
                count[r[i:i + length]] = count.get(r[i:i + length], 0) + w
        for r, flags in zip(raws, sd.repeated_strings(raws, weights.astype(float), length)):
            assert flags.tolist() == [count[r[i:i + length]] > 1 for i in range(len(r) - length + 1)]


def texts_with_repeats(rng, n):
    shared = ["".join(rng.choice("abcdefg é") for _ in range(rng.randint(30, 200))) for _ in range(6)]
    texts = [None, "", "short", "a" * 500, "ab" * 300, "a" * 59, "a" * 60, "é" * 100]
    for _ in range(n):
        own = ["".join(rng.choice("abcdefgh ü") for _ in range(rng.randint(0, 150))) for _ in range(3)]
        texts.append(own[0] + rng.choice(shared) + own[1] + rng.choice(shared)[:rng.randint(1, 200)] + own[2])
    return texts + texts[10:20] + [texts[12] + "x"] * 3


def test_removal_equals_brute_force(spark):
    texts = texts_with_repeats(random.Random(4), 60)
    rows = [(i, None if i % 7 == 0 else i % 5, t) for i, t in enumerate(texts)]  # keys that are null or repeat
    df = clashing(spark.createDataFrame(rows, "row long, doc_id long, text string")).repartition(3)
    want = dict(enumerate(brute_bytes(texts, 60)))
    for options in ({}, {"gram": 16, "bucket": 2, "rounds": 1}, {"gram": 16, "bucket": 3, "shard_bytes": 2000, "rounds": 3}):
        assert removed(df, length=60, **options) == want
    assert sd.remove_repeated_bytes(df, length=60).columns == [c for c in df.columns if c not in ("n_bytes", "removed", "kept")] + ["n_bytes", "removed", "kept"]


def test_hot_passage_between_different_texts(spark):
    """One passage in most rows: its segments differ at both ends, and are divided until each shard is small."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(90))
    texts = ["".join(rng.choice("klmnopq") for _ in range(70)) + passage + "".join(rng.choice("rstuvw") for _ in range(70)) for _ in range(300)]
    got = removed(spark.createDataFrame(list(enumerate(texts)), "row long, text string"), key="row", length=60, gram=20, bucket=20, shard_bytes=5000)
    assert got == dict(enumerate(brute_bytes(texts, 60)))


def test_segments_hold_every_string_once():
    """Texts that are looked at together, too short ones between them: each string is in one segment, equal ones under one key."""
    texts = [(t or "").encode() for t in texts_with_repeats(random.Random(9), 30)]
    for level in (0, 1, 3):
        within = np.zeros(len(texts), dtype=np.int64)
        seen, keys = [], {}
        for text, key, _, _, start, stop in zip(*sd.segments(texts, 60, 30, level, 3, within)):
            seen += [(int(text), i) for i in range(start, stop)]
            for i in range(start, stop):
                assert keys.setdefault(texts[text][i:i + 60], key) == key
        assert seen == [(j, i) for j, t in enumerate(texts) for i in range(len(t) - 59)]
    assert len(sd.segments([], 60, 30)[0]) == len(sd.segments([b"short"], 60, 30)[0]) == 0


def test_texts_longer_than_a_slice(spark, monkeypatch):
    """Long texts are cut into slices that overlap; the plan's first step runs here, as a worker would."""
    monkeypatch.setattr(sd, "map_texts", lambda df, run, schema, rows=250: pd.concat(run(iter([df])), ignore_index=True))
    texts = [t for t in texts_with_repeats(random.Random(9), 20) if t and len(t.encode()) >= 60]
    frame = pd.DataFrame({"id": [bytes([i]) for i in range(len(texts))], "raw": [t.encode() for t in texts], **dict.fromkeys(("k", "a", "s", "n"), 0)})
    for size in (1 << 19, 100, 61):
        monkeypatch.setattr(sd, "SLICE", size)
        out = sd._pieces(frame, 60, 30, 0, 3)
        starts = sorted((r.id, i) for r in out.itertuples() for i in range(r.pos, r.pos + r.size - 59))
        assert starts == sorted((bytes([i]), j) for i, t in enumerate(texts) for j in range(len(t.encode()) - 59))


def test_removal_query_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.op13_suffix_dedup(spark, SMALL).collect()}
    want = {int(d): (n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, (n, gone, spans, kept) in zip(docs["doc_id"], brute_bytes(docs["text"], 400))}
    assert got == want and sum(r[1] > 0 for r in got.values()) > 20


def test_removal_of_nothing(spark):
    assert sd.remove_repeated_bytes(frame(spark, [])).count() == 0
    rows = sd.remove_repeated_bytes(frame(spark, [(1, None), (None, ""), (2, "x" * 399), (3, "y" * 400)])).collect()
    assert sorted((r["n_bytes"], len(r["removed"])) for r in rows) == [(0, 0), (0, 0), (399, 0), (400, 0)]

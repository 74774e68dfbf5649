"""Hand values and edges of the reference's operators."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import vocab
from tidemark.operators import demand as dm
from tidemark.operators import features as fe
from tidemark.operators import knowledge as kb
from tidemark.operators import lifecycle as lc
from tidemark.operators import models as ml
from tidemark.operators import ordering as od
from tidemark.operators import procurement as pr
from tidemark.operators import retrieval as rt
from tidemark.sources import tables as tb


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- chunks ---

def test_chunk_hand_values():
    assert tx.chunks_of("짧은 문장입니다.", 50, 10) == ["짧은 문장입니다."]
    pieces = tx.chunks_of("A" * 100, 50, 10)
    assert [len(p) for p in pieces] == [50, 50, 20, 10]
    assert tx.chunks_of("1234567890", 5, 2)[0][-2:] == tx.chunks_of("1234567890", 5, 2)[1][:2]
    natural = tx.chunks_of("Hello World. This is a test.", 13, 5)
    assert natural[0] == "Hello World." and "This is" in natural[1]
    assert tx.chunks_of("", 5, 2) == [] and tx.chunks_of(None, 5, 2) == []
    for overlap in (50, 60):
        with pytest.raises(ValueError):
            tx.chunks_of("text", 50, overlap)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!\n", max_size=200), st.integers(2, 30), st.data())
def test_chunks_cover_the_text(text, size, data):
    pieces = tx.chunks_of(text, size, data.draw(st.integers(0, size - 1)))
    assert all(len(p) <= size + 1 for p in pieces)
    at = 0
    for word in text.split():
        assert any(c in p for p in pieces for c in word)
    for p in pieces:
        found = text.find(p, max(0, at - size))
        assert found >= 0
        at = found + len(p)


def test_bullets_and_manual_text(spark):
    assert tx.bullets({"a": 1, "b": {"c": ["x", ""]}, "d": None}) == "- a: 1\n- b: - c: - x"
    assert tx.bullets([{"k": "v"}, "w"]) == "- - k: v\n- w"
    df = spark.sql("""SELECT parse_json('{"chapter": "1", "title": "T", "keywords": ["a", "b"], "process_steps": ["s1", "s2"], "notes": ""}') AS item""")
    text = df.select(tx.manual_text(F.col("item")).alias("t")).first()["t"]
    assert text.endswith("process_steps:\n- s1\n- s2") and "키워드: a, b" in text and "notes" not in text


# --- text rules ---

def test_needs_search_and_plain(spark):
    assert one(spark, tx.needs_search(F.lit("whatever"))) == "NEED_RAG"
    assert one(spark, tx.needs_search(F.lit("no_rag please"))) == "NO_RAG"
    assert [one(spark, tx.plain(F.lit(x))) for x in ("불용 차이", "불용-차이??", "g2b 번호")] == ["불용차이", "불용차이", "g2b번호"]


def test_page_url_has_no_tags_and_is_short(spark):
    url = one(spark, tx.page_url("http://f/p", F.lit("<script>x</script>" + "A" * 600)))
    assert "script" not in url and len(url.split("=", 1)[1]) <= 500
    assert one(spark, tx.page_url("http://f/p", F.lit("<b></b>"))) == "http://f/p"


def test_reply_json(spark):
    assert one(spark, tx.reply_json(F.lit('x {"a": 1} y'))) == '{"a":1}'
    assert one(spark, tx.reply_json(F.lit("nothing"))) is None


def test_faq_matches(spark):
    faq = spark.createDataFrame([(0, "q0", "a0", ["테스트"]), (1, "q1", "a1", ["불용 차이"]), (2, "q2", "a2", [])], "pos int, question string, answer string, keywords array<string>")
    asked = spark.createDataFrame([(1, "이것은 테스트"), (2, "other"), (3, "FAQ 보여줘"), (4, "불용-차이??")], "id int, text string")
    got = {r["id"]: r["n_faq"] for r in kb.faq_matches(asked, faq).collect()}
    assert got == {1: 1, 3: 3, 4: 1}


def test_correct_arguments(spark):
    words = spark.createDataFrame([("pc", "데스크톱")], "word string, standard string")
    rows = spark.createDataFrame([(1, None, " PC ", None), (2, "의자", "pc", None), (3, " ", None, ""), (4, None, "A-1", None)], "k int, name string, id_val string, id_num string")
    got = {r["k"]: (r["name"], r["id_val"], r["error"]) for r in kb.correct_arguments(rows, words).collect()}
    assert got[1] == ("데스크톱", None, None)
    assert got[2] == ("의자", None, None)
    assert got[3][2] == "no argument"
    assert got[4][1] == "A-1"


# --- lifecycle ---

def test_validity_of_three_changes(spark):
    rows = [(1, dt.datetime(2020, 1, d)) for d in (1, 5, 9)]
    got = lc.validity(spark.createDataFrame(rows, "asset_id int, changed_at timestamp")).orderBy("valid_from").collect()
    assert [r["is_current"] for r in got] == [False, False, True]
    assert got[0]["valid_to"] == dt.datetime(2020, 1, 4) and got[2]["valid_to"] == dt.datetime(2099, 12, 31)


def test_explode_guards_quantity(spark):
    df = spark.createDataFrame([(3, 10.0), (0, 5.0), (None, 5.0), (2, None)], "qty int, acq_amount double")
    got = [(r["acq_amount"], r["qty"]) for r in lc.explode_batches(df).collect()]
    assert sorted(got) == [(0, 1), (0, 1), (3, 1), (3, 1), (3, 1)]


def test_ids_never_lose_digits(spark):
    df = spark.range(100_002).select("id", F.lit("2020-05-05").cast("date").alias("d"))
    got = lc.number_assets(df, "d", F.col("id"))
    assert got.filter("asset_id = 'M2020100002'").count() == 1 and got.select("asset_id").distinct().count() == 100_002
    big = lc.number_large_years(df, "d", F.col("id"), ranges=8)
    assert big.select("asset_id").distinct().count() == 100_002 and big.filter("asset_id = 'M202000001'").count() == 1


def test_calendar_window(spark):
    def pick(day, as_of="2026-02-10"):
        return one(spark, lc.next_window(F.lit(day).cast("date"), F.lit(as_of).cast("date"), vocab.DISUSE_WINDOWS))
    assert pick("2025-03-01") == dt.date(2025, 8, 1)
    assert pick("2025-08-10") == dt.date(2025, 8, 10)
    assert pick("2025-12-22") == dt.date(2026, 2, 1)
    assert pick("2026-03-01") == dt.date(2026, 2, 10)
    assert pick("2026-02-09", "2026-02-10") == dt.date(2026, 2, 9)


def test_default_words_and_windows(spark):
    day = lambda x: F.lit(x).cast("date")
    assert one(spark, lc.next_window(day("2025-03-01"), day("2026-02-10"))) == dt.date(2025, 8, 10)
    assert [one(spark, fe.severity(F.lit(x))) for x in ("컴퓨터공학과", "과학실", "총무과")] == [1.3, 1.2, 1.0]
    assert [one(spark, fe.physical_reason(F.lit(x))) for x in ("성능저하", "잉여물품", None)] == [True, False, False]
    no = F.lit(False)
    assert one(spark, lc.usage_intensity(F.lit("노트북"), F.lit("전산과"), F.lit("HIGH"), F.lit(140.0), no, no)) == pytest.approx(1.34, abs=0.011)


def test_ids_of_large_years_are_those_of_the_window(spark):
    rows = [(i, dt.date(2019 + i % 3, 1 + i % 12, 1 + i % 28) if i % 50 else None, i * 37 % 101 if i % 9 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, d date, x long")
    order = [F.col("x"), F.col("id")]
    a = {r["id"]: r["asset_id"] for r in lc.number_assets(df, "d", *order).collect()}
    assert {r["id"]: r["asset_id"] for r in lc.number_large_years(df, "d", *order, ranges=7).collect()} == a


def test_quantiles_equal_percentiles(spark):
    df = spark.createDataFrame([(float(i * i % 97) if i % 7 else None,) for i in range(500)], "v double")
    got = od.quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0]).first()["q"]
    assert got == pytest.approx(df.agg(F.percentile("v", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.9, 1.0)])).alias("q")).first()["q"])
    assert od.quantiles(df.limit(0), "v", [0.5]).first()["q"] is None
    assert od.quantiles(df.filter("v = 1").limit(1), "v", [0.25, 0.75]).first()["q"] == [1.0, 1.0]


def test_small_tables_are_broadcast_and_large_ones_not(spark):
    plan = lambda most: spark.range(5).join(od.small(spark.range(3).withColumnRenamed("id", "b"), most), F.col("id") > F.col("b"))._jdf.queryExecution().toString()
    assert "strategy=broadcast" in plan(3) and "strategy=broadcast" not in plan(2)


# --- features ---

def test_split_sizes(spark):
    want = {1: (1, 0), 2: (2, 0), 3: (1, 1), 4: (2, 1), 5: (3, 1), 9: (6, 1), 10: (7, 2), 11: (7, 2), 30: (21, 6)}
    for n, sizes in want.items():
        t, v = fe.split_sizes(F.lit(n))
        r = spark.range(1).select(t.alias("t"), v.alias("v")).first()
        assert (r["t"], r["v"]) == sizes, n


def test_every_asset_in_one_split(spark):
    rows = [(i, "abcdefgh"[i % 5] if i % 11 else None, dt.date(2020, 1, 1 + i % 28), "Y" if i % 3 else "N") for i in range(300)]
    df = spark.createDataFrame(rows, "asset_id int, item string, ref_date date, label string")
    a = {r["asset_id"]: r["split"] for r in fe.time_split(df, "item", "ref_date", "asset_id").collect()}
    b = {r["asset_id"]: r["split"] for r in fe.time_split_large(df, "item", "ref_date", "asset_id").collect()}
    assert a == b and len(a) == 300
    assert all((s == "Prediction") == (label == "N" or item is None) for (i, item, _, label), s in zip(rows, (a[i] for i in range(300))))


def test_age_not_negative(spark):
    assert one(spark, fe.age_years(F.lit("2020-01-01").cast("date"), F.lit("2021-01-01").cast("date"))) == 0.0


def test_unseen_category_gets_global_mean(spark):
    df = spark.createDataFrame([("a", 2.0, "Train", "Y"), ("a", 4.0, "Train", "Y"), ("b", 9.0, "Test", "Y"), (None, 1.0, "Prediction", "N")], "c string, y double, split string, label string")
    got = {r["c"]: r["c_te"] for r in fe.target_encodings(df, ["c"], "y").collect()}
    assert got["a"] == pytest.approx((3.0 * 2 + 3.0 * 10) / 12) and got["b"] == got[None] == 3.0


def test_mode_takes_lowest_and_leak_guard(spark):
    df = spark.createDataFrame([(3,), (3,), (2,), (2,), (None,)], "life int")
    assert sorted(r["life"] for r in fe.fill_mode(df, "life").collect()) == [2, 2, 2, 3, 3]
    with pytest.raises(ValueError):
        fe.guard_leaks(["a", "b"], ["a"], ["a"])
    with pytest.raises(ValueError):
        fe.guard_leaks(["a"], ["c"], [])


# --- demand and procurement ---

def test_smape_of_zeros_and_lags_round_gaps(spark):
    df = spark.createDataFrame([(0.0, 0.0), (10.0, -5.0)], "y double, p double")
    assert dm.smape(df, "y", "p").first()["smape"] == pytest.approx(200.0)
    rows = [(dt.date(2020, m, 1), n) for m, n in ((1, 5), (4, 2))]
    dense = dm.dense_calendar(spark.createDataFrame(rows, "month date, actual long"))
    got = [(r["actual"], r["lag_1"], r["mean_3"]) for r in dm.with_lags(dense).orderBy("month").collect()]
    assert got == [(5, None, None), (0, 5, None), (0, 0, None), (2, 0, pytest.approx(5 / 3))]


def test_short_series_has_no_split(spark):
    rows = [(dt.date(2020 + i // 12, 1 + i % 12, 1), i) for i in range(30)]
    got = dm.positional_split(spark.createDataFrame(rows, "month date, actual long"))
    assert {r["split"] for r in got.collect()} == {None}


def test_safety_plan_hand_value(spark):
    plan = pr.safety_plan(F.lit("2026-03-20"), F.lit(1.65), F.lit(5.0), F.lit(1))
    r = spark.range(1).select(*[c.alias(n) for n, c in plan.items()]).first()
    assert (r["buffer_days"], r["prep_days"], r["order_date"], r["error"]) == (9, 29, dt.date(2026, 2, 19), None)
    bad = pr.safety_plan(F.lit("soon"), F.lit(1.65), F.lit(5.0), F.lit(1))
    assert spark.range(1).select(bad["error"].alias("e")).first()["e"] == "bad failure date"


def test_forecast_properties(spark):
    rows = [("a", dt.date(2015 + i // 12, 1 + i % 12, 1), 10 + i % 12) for i in range(60)] + [("b", dt.date(2020, 1, 1), 4)]
    got = ml.recursive_forecast(spark.createDataFrame(rows, "k string, month date, actual long"), "k", 6).collect()
    assert len(got) == 12 and all(r["forecast"] >= 0 for r in got)
    assert {r["forecast"] for r in got if r["k"] == "b"} == {4.0}
    assert min(r["month"] for r in got if r["k"] == "a") == dt.date(2020, 1, 1)


def test_unique_sets():
    assert list(ml.unique_sets({"a": ["x", "y", "z"], "b": ["z", "y", "x"], "c": ["x", "y"]})) == ["a"]


def life(spark, n=120):
    rows = [(float(i % 7), float(i % 5), float(i % 3), None if i == 3 else float(i % 2), 10.0 * (i % 7) + i % 5) for i in range(n)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, target double")


def test_model_is_pruned_saved_and_ranked(spark, tmp_path):
    df, columns = life(spark), ["a", "b", "c", "d"]
    forest = ml.life_regressors()["forest"]
    model = ml.fit_model(df, columns, forest)
    ranking = ml.importance(model, columns)
    assert ranking[0][0] == "a" and set(ml.top_sets(ranking, (2, 3, 9))) == {"top_2", "top_3"}
    rows = ml.assembled(df.withColumn("split", F.expr("if(b = 1, 'Valid', 'Train')")), columns, F.lit(True))
    rounds = ml.prune(rows, columns, columns, forest, slack=2.0)
    assert rounds[0]["kept"] and rounds[1]["features"][0] == "a" and rounds[1]["n_features"] == 2
    record = ml.metadata(columns, {"rmse": 1.5, "r2": float("nan")}, {"train": 120}, True)
    ml.save_model(model, str(tmp_path / "m"), record)
    assert '"r2": null' in spark.read.text(str(tmp_path / "m/record")).first()["value"]
    assert ml.PipelineModel.load(str(tmp_path / "m/model")).transform(df).count() == 120


def test_fit_without_complete_rows(spark):
    df = life(spark).withColumn("d", F.lit(None).cast("double")).withColumn("c", F.when(F.col("a") > 2, F.col("c")))
    assert ml.fit_model(df.withColumn("d", F.when(F.col("c").isNull(), 1.0)), ["a", "b", "c", "d"], ml.life_regressors()["boosted"]).transform(life(spark)).count() == 120


# --- retrieval ---

def found(spark, rows):
    return spark.createDataFrame([(1, i + 1, i, s, c, k) for i, (s, c, k) in enumerate(rows)], "q int, rank int, doc int, score double, category string, doc_type string")


def test_adaptive_cut_and_order(spark):
    f = found(spark, [(0.10, "R", "qa"), (0.18, "R", "manual_chunk"), (0.80, "A", "faq")])
    assert [r["doc"] for r in rt.filter_scores(f, 10.0).orderBy("rank").collect()] == [0, 1]
    assert [r["doc"] for r in rt.filter_scores(f, 0.05).orderBy("rank").collect()] == [0, 1]
    assert [r["doc"] for r in rt.filter_scores(f, 0.12).orderBy("rank").collect()] == [0]
    assert [r["doc_type"] for r in rt.context_order(f).orderBy("rank").collect()] == ["manual_chunk", "faq", "qa"]


def test_focus_and_comparison(spark):
    f = found(spark, [(0.1, "R", "qa"), (0.2, "R", "qa"), (0.3, "D", "qa")])
    ask = lambda text: spark.createDataFrame([(1, text)], "q int, text string")
    assert sorted(r["doc"] for r in rt.focus(f, ask("반납 방법")).collect()) == [0, 1]
    assert sorted(r["doc"] for r in rt.focus(f, ask("반납 불용 차이")).collect()) == [0, 1, 2]


def test_top_k_blocks_give_the_same(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(4)]) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    a = rt.top_k(v, v, 5, skip_self=True).orderBy("q", "rank").collect()
    b = rt.top_k(v, v, 5, skip_self=True, block=7).orderBy("q", "rank").collect()
    assert [(r["q"], r["doc"]) for r in a] == [(r["q"], r["doc"]) for r in b] and len(a) == 300
    assert rt.top_k(v.limit(0), v, 5).count() == 0


def test_nearest_by_category_equals_all_pairs(spark):
    rows = [(i, "abc"[i % 3] if i != 59 else "alone", [float((i * 7 + j * 3) % 11 - 5) for j in range(4)]) for i in range(60)] + [(99, "a", [])]
    got = {r["q"]: (r["same"], r["other"]) for r in rt.nearest_by_category(spark.createDataFrame(rows, "id long, category string, embedding array<float>"), block=7).collect()}
    own = {i: (c, np.array(v) / (np.linalg.norm(v) or 1)) for i, c, v in rows[:60]}
    for i, (c, v) in own.items():
        far = {k: [1 - v @ w for j, (d, w) in own.items() if j != i and (d == c) == k] for k in (True, False)}
        for value, want in zip(got[i], (far[True], far[False])):
            assert value == (pytest.approx(min(want), abs=1e-9) if want else None)
    assert set(got) == set(own)


# --- sources ---

def test_csv_reads(spark, tmp_path):
    schema = "g2b_no string, acq_date date"
    assert tb.read_csv(spark, str(tmp_path / "none.csv"), schema).count() == 0
    with pytest.raises(FileNotFoundError):
        tb.read_csv(spark, str(tmp_path / "none.csv"), schema, required=True)
    (tmp_path / "a.csv").write_bytes("﻿g2b_no,acq_date\n0012345678901234,2020-01-02\n".encode())
    r = tb.read_csv(spark, str(tmp_path / "a.csv"), schema).first()
    assert (r["g2b_no"], r["acq_date"]) == ("0012345678901234", dt.date(2020, 1, 2))
    (tmp_path / "k.csv").write_bytes("name\n의자\n".encode("cp949"))
    assert tb.read_csv(spark, str(tmp_path / "k.csv"), "name string", encoding="cp949").first()["name"] == "의자"
    assert tb.read_first(spark, [str(tmp_path / "none.csv"), str(tmp_path / "a.csv")], "x string", {"g2b_no": "x"}).columns[:1] == ["x"]


def test_json_arrays_keep_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": ["x"]}, {"k": {"y": 1}}]')
    (tmp_path / "b.json").write_text('{"not": "a list"}')
    got = tb.read_json_arrays(spark, str(tmp_path)).select("source", "pos", F.expr("try_variant_get(item, '$.k', 'string')").alias("k")).orderBy("pos").collect()
    assert [(r["source"], r["k"]) for r in got] == [("a.json", '["x"]'), ("a.json", '{"y":1}')]


def test_jsonl_last_line_wins(spark, tmp_path):
    path = str(tmp_path / "r")
    tb.append_jsonl(spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int"), path)
    tb.append_jsonl(spark.createDataFrame([("a", 2)], "id string, v int"), path)
    assert {r["id"]: r["v"] for r in tb.reload_jsonl(spark, path, "id string, v int", "id").collect()} == {"a": 2, "b": 1}


def test_replace_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tb.replace_table(spark.range(3), path) == 3
    with pytest.raises(ValueError):
        tb.replace_table(spark.range(0), path)
    assert spark.read.parquet(path).count() == 3
    assert tb.replace_table(spark.range(5), path) == 5 and spark.read.parquet(path).count() == 5
    tb.save_vectors(spark.range(2), str(tmp_path / "v"))
    assert tb.load_vectors(spark, str(tmp_path / "v")).count() == 2
    with pytest.raises(FileNotFoundError):
        tb.load_vectors(spark, str(tmp_path / "w"))

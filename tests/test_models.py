"""Model operators against plain versions: exact medians, trees with random thresholds, the shared forecast, the search."""

import datetime
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tidemark.operators import features as fe
from tidemark.operators import models as ml
from tidemark.operators import trees as tr
from tidemark.operators.ordering import column_quantiles, medians
from tidemark.plans import models as models_plan
from tidemark.plans.bindings import base, maintenance

SMALL = "/root/testdata/sf0.001"


def numbers(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = [(i, *(rng.choice([None, float("nan"), rng.randint(-4, 4), rng.random()]) for _ in range(3)), None, 1.0 * (i % 2)) for i in range(n)]
    rows = [tuple(None if v is None else float(v) if j else v for j, v in enumerate(r)) for r in rows]
    return rows, spark.createDataFrame(rows, "i int, a double, b double, c double, d double, e double")


def test_quantiles_of_all_columns_in_one_sort(spark):
    rows, df = numbers(spark)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["c"]: r["q"] for r in column_quantiles(df, list("abcde"), shares).collect()}
    for i in (0, 1, 2, 4):
        values = [r[i + 1] for r in rows if r[i + 1] is not None and not math.isnan(r[i + 1])]
        assert got[i] == pytest.approx(list(np.quantile(values, shares)), abs=1e-12)
    assert 3 not in got  # nothing but nulls
    assert medians(df, list("abcde"))["d"] == 0.0 and medians(df.limit(0), ["a"]) == {"a": 0.0}
    plan = fe.impute_medians(df, list("abcde"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") <= 1


def test_fills_are_exact_medians(spark):
    rows, df = numbers(spark, 501)
    want = np.median([r[1] for r in rows if r[1] is not None and not math.isnan(r[1])])
    stages, names = ml.with_imputed(df, ["a", "d"])
    out = stages[0].transform(df).collect()
    assert names == ["a__f", "d__f"]
    for r, row in zip(sorted(out, key=lambda r: r["i"]), rows):
        assert r["a__f"] == (want if row[1] is None or math.isnan(row[1]) else row[1]) and r["d__f"] == 0.0
    filled = fe.impute_medians(df.withColumn("a", F.nanvl("a", F.lit(None).cast("double"))), ["a", "d"]).collect()
    assert sorted(r["a"] for r in filled) == sorted(r["a__f"] for r in out)


def plain_trees(x, y, trees, depth, least, share, seed):
    """Predictions of the rows that the trees are grown on, node by node."""
    out = np.zeros(len(y))

    def grow(tree, node, own, level):
        if level < depth:
            tried, u = tr.draws(seed, tree, node, x.shape[1], share)
            best = None
            for f in tried:
                lo, hi = x[own, f].min(), x[own, f].max()
                cut = lo + u[f] * (hi - lo)
                left = own[x[own, f] <= cut]
                right = own[x[own, f] > cut]
                if len(left) >= least and len(right) >= least:
                    gain = y[left].sum() ** 2 / len(left) + y[right].sum() ** 2 / len(right) - y[own].sum() ** 2 / len(own)
                    if best is None or gain > best[0]:
                        best = gain, left, right
            if best is not None and best[0] > 1e-12 * max(1.0, abs(y[own].sum())):
                grow(tree, 2 * node, best[1], level + 1)
                grow(tree, 2 * node + 1, best[2], level + 1)
                return
        out[own] += y[own].mean() / trees

    for t in range(trees):
        grow(t, 1, np.arange(len(y)), 0)
    return out


def vectors(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, (n, 4)).astype(float)
    y = np.round(3 * x[:, 0] - x[:, 2] + rng.integers(0, 3, n))
    return x, y, spark.createDataFrame([(i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], ["i", "features", "target"]).repartition(3)


def test_random_threshold_trees_equal_plain_ones(spark):
    x, y, df = vectors(spark, 200, 3)
    for options in ({"trees": 3, "depth": 5, "least": 1, "share": 0.75, "seed": 9}, {"trees": 2, "depth": 3, "least": 8, "share": 1.0, "seed": 2}):
        model = tr.ExtraTrees(**options).fit(df)
        got = [r["prediction"] for r in model.transform(df).orderBy("i").collect()]
        assert got == pytest.approx(list(plain_trees(x, y, **options)), abs=1e-9)
        assert sum(model.featureImportances) == pytest.approx(1.0) and int(np.argmax(model.featureImportances.toArray())) == 0
    constant = tr.ExtraTrees(trees=2).fit(df.withColumn("target", F.lit(5.0)))
    assert {r["prediction"] for r in constant.transform(df).collect()} == {5.0}
    with pytest.raises(ValueError, match="no rows"):
        tr.ExtraTrees().fit(df.limit(0))


def test_flattened_trees_predict_the_same(spark):
    x, _, df = vectors(spark, 150, 4)
    for estimator in (RandomForestRegressor(labelCol="target", numTrees=4, maxDepth=4, seed=1), GBTRegressor(labelCol="target", maxIter=4, maxDepth=3, seed=1)):
        model = estimator.fit(df)
        assert list(tr.flattened(model).predict(x)) == pytest.approx([r["prediction"] for r in model.transform(df).orderBy("i").collect()], abs=1e-9)


def monthly(spark):
    rng = random.Random(3)
    start = {"a": 60, "b": 40, "short": 4}
    rows = [(k, datetime.date(2015 + i // 12, 1 + i % 12, 1), rng.randint(0, 30) + (i % 12)) for k, n in start.items() for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, month date, actual long")


@pytest.mark.parametrize("kind", ["ridge", "boosted", "forest"])
def test_shared_forecast_equals_recursion_over_transform(spark, kind):
    """Step by step, each forecast is what the fitted pipeline says of the series so far."""
    rows, df = monthly(spark)
    estimator = {"ridge": None, "boosted": GBTRegressor(labelCol="target", maxIter=5, maxDepth=3, seed=1), "forest": RandomForestRegressor(labelCol="target", numTrees=5, maxDepth=4, seed=1)}[kind]
    fitted = ml.fit_shared(df, ["k"], estimator)
    got = {(r["k"], r["month"]): r["forecast"] for r in ml.shared_forecast(df, "k", 4, fitted).collect()}
    assert len(got) == 12
    values = {k: [float(v) for key, _, v in rows if key == k] for k in ("a", "b", "short")}
    last = {k: max(m for key, m, _ in rows if key == k) for k in values}
    for step in range(1, 5):
        ahead = {}
        for k, own in values.items():
            n = last[k].year * 12 + last[k].month - 1 + step
            ahead[k] = datetime.date(n // 12, n % 12 + 1, 1)
        frame = spark.createDataFrame([(k, *[None if math.isnan(v) else v for v in ml.forecast_row(values[k], ahead[k].month)]) for k in values], "k string, " + ", ".join(f"{c} double" for c in ml.FORECAST_FEATURES))
        for r in fitted.pipeline.transform(frame).collect():
            want = max(0.0, r["prediction"])
            assert got[r["k"], ahead[r["k"]]] == pytest.approx(want, abs=1e-6)
            values[r["k"]].append(got[r["k"], ahead[r["k"]]])


def test_forecast_features_are_those_of_the_fit(spark):
    rows, df = monthly(spark)
    lagged = ml.with_lags(ml.with_trend(df, ["k"]), ["k"]).filter("k = 'a'").orderBy("month").collect()
    own = [float(v) for k, _, v in rows if k == "a"]
    for i in (0, 5, 12, 59):
        want = [lagged[i][c] for c in ml.FORECAST_FEATURES]
        assert [None if math.isnan(v) else v for v in ml.forecast_row(own[:i], lagged[i]["month"].month)] == [None if w is None else pytest.approx(w, abs=1e-9) for w in want]


def test_search_ranks_and_scores(spark):
    rng = random.Random(4)
    rows = [(("Train", "Valid", "Test")[i % 3], float(a), float(b), None if i % 50 == 0 else float(c), 2.0 * a + b) for i in range(240) for a, b, c in [(rng.randint(0, 9), rng.randint(0, 4), rng.randint(0, 9))]]
    df = spark.createDataFrame(rows, "split string, a double, b double, c double, target double")
    table = ml.assembled(df, ["a", "b", "c"], F.col("split") == "Train")
    models = {"deep": RandomForestRegressor(labelCol="target", numTrees=5, maxDepth=6, seed=1), "extra": tr.ExtraTrees(trees=5, depth=6)}
    found = ml.search(table, ["a", "b", "c"], {"all": ["a", "b", "c"], "same": ["c", "b", "a"], "few": ["a", "b"]}, models, keep=1)
    assert [(r["features"], r["n_features"]) for r in found] == [("all", 3)]
    both = ml.search(table, ["a", "b", "c"], {"all": ["a", "b", "c"]}, models)
    assert [r["rmse"] for r in both] == sorted(r["rmse"] for r in both) and {r["model"] for r in both} == {"deep", "extra"} and all(r["r2"] > 0.8 for r in both)
    model = ml.fit_slice(table.filter("split = 'Train'"), [0, 1, 2], models["deep"])
    own = ml.metrics(model, table.filter("split = 'Test'"))
    assert own == pytest.approx(ml.score(model, table.filter("split = 'Test'")), abs=1e-9)
    assert ml.ranked_features(table, ["a", "b", "c"], models["extra"])[0][0] == "a"


def test_rows_find_their_node_and_add_up(spark):
    """Nodes are looked up in arrays, a level at a time; a node's rows are added up in one go, whether or not a batch has any."""
    rng = np.random.default_rng(3)
    x, y = rng.random((500, 4)).round(2), rng.random(500)
    growing = tr._Growing(1, 3)
    growing.feature[0, [1, 2, 7]], growing.threshold[0, [1, 2, 7]], growing.level = [0, 3, 1], [0.5, 0.25, 9.0], 2
    want = np.where(x[:, 0] > 0.5, 3, np.where(x[:, 3] > 0.25, 5, 4))
    assert (growing.place(0, x) == want).all()
    rows = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(3)
    cut = np.full((3, 4), 0.5)
    for cuts in (None, [cut]):
        got = tr._sums(rows, growing, [np.array([4, 5, 6])], cuts)
        for r in got.itertuples():
            own = (want == r.node) & ((x[:, r.feature] <= 0.5) | (cuts is None))
            assert r.n == own.sum() and r.s == pytest.approx(y[own].sum())
            if cuts is None and own.any():
                assert (r.lo, r.hi) == (x[own, r.feature].min(), x[own, r.feature].max())


def test_grid_scores_are_those_of_the_search(spark):
    """The same folds and forests, without the refit of the best on all rows."""
    rng = np.random.default_rng(3)
    rows = [(float(a), None if i % 9 == 0 else float(b), None if i % 50 == 0 else float(3 * a + b * b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, target double").coalesce(2).cache()
    fitted = ml.grid_search(df, ["a", "b"], 2, (2, 3), (3, 5))
    got = ml.grid_scores(df, ["a", "b"], 2, (2, 3), (3, 5))
    assert [{k.name: v for k, v in p.items()} for p, _ in got] == [{k.name: v for k, v in p.items()} for p in fitted.getEstimatorParamMaps()]
    assert [s for _, s in got] == pytest.approx(fitted.avgMetrics, rel=1e-9)


def test_wide_rows_read_maintenance_once_and_keep_their_values(spark, monkeypatch):
    """Only rows that models read are assembled; batches, split and encodings are still counted on all assets."""
    seen, own = {}, models_plan.staged

    def noted(df, name):
        seen[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return own(df, name)

    monkeypatch.setattr(models_plan, "staged", noted)
    got = models_plan.wide_rows(spark, SMALL)
    assert seen["split"].count("l_orderkey") == 0 and seen["wide"].count("Relation [l_orderkey") <= 1
    b = base(spark, SMALL)
    df = fe.with_maintenance(fe.batch_features(b), fe.maintenance_features(maintenance(spark, SMALL), b, F.col("event_type").isin("R", "A"), F.col("result") == "F"))
    df = fe.target_encodings(fe.time_split_large(df, "item_name", "ref_date", "asset_id"), ("dept_code", "item_name", "class_name", "campus"), "age")
    place = {c: i for i, c in enumerate(models_plan.WIDE)}
    some = ["life_years", "acq_amount", "batch_size", "n_events", "n_repairs", "n_1y", "dept_code_te", "item_name_te", "class_name_te", "campus_te"]
    want = df.filter("split <> 'Prediction'").select("split", *[F.col(c).cast("double") for c in some], (F.col("age") * 12).alias("target")).collect()
    key = lambda rows: sorted((r[0], *(round(float(x), 6) for x in r[1:])) for r in rows)
    assert key(want) == key([(r["split"], *(r["all"][place[c]] for c in some), r["target"]) for r in got.collect()])


def test_encodings_pass_over_the_rows_once(spark):
    """What is joined back has been summed before: the plan scans the rows for the output alone."""
    df = spark.createDataFrame([("a", "x", "Train", "Y", 1.0), ("b", "x", "Test", "Y", 3.0), ("a", "y", "Prediction", "N", 9.0)], "c string, e string, split string, label string, t double").repartition(2)
    out = fe.target_encodings(df, ("c", "e"), "t")
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["c"], r["e"], round(r["c_te"], 9), round(r["e_te"], 9)) for r in out.collect()) == [("a", "x", 1.0, 1.0), ("a", "y", 1.0, 1.0), ("b", "x", 1.0, 1.0)]


def test_trees_read_coded_blocks_twice_a_level(spark, monkeypatch):
    """Rows are coded once, to two bytes a feature; the leaves of the last level take no pass of their own."""
    calls, own = [], tr._sums
    monkeypatch.setattr(tr, "_sums", lambda rows, growing, *rest: calls.append((growing.level, tuple(rows.columns))) or own(rows, growing, *rest))
    x, y, df = vectors(spark, 200, 5)
    tr.ExtraTrees(trees=2, depth=3).fit(df)
    assert calls == [(level, ("codes", "sizes", "values", "y")) for level in range(3) for _ in range(2)]
    blocks = tr.coded(spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y)], "x array<double>, y double").coalesce(1)).collect()
    codes = np.frombuffer(blocks[0]["codes"], dtype=np.uint16).reshape(200, 4)
    values = np.split(np.frombuffer(blocks[0]["values"]), np.cumsum(blocks[0]["sizes"])[:-1])
    assert len(blocks) == 1 and all((values[f][codes[:, f]] == x[:, f]).all() for f in range(4))


def test_blocks_are_bounded_and_whole():
    batches = [pa.RecordBatch.from_pydict({"x": pa.array([[float(i)] * 2 for i in range(a, b)], pa.list_(pa.float64())), "y": pa.array([float(i) for i in range(a, b)], pa.float64())}) for a, b in ((0, 30), (30, 30), (30, 60), (60, 205))]
    got = list(tr._blocks(batches, 70))
    assert max(len(y) for _, y in got) <= 70 and np.concatenate([y for _, y in got]).tolist() == list(range(205))
    assert all((x == y[:, None]).all() for x, y in got)
    rng = np.random.default_rng(1)
    for n in (1, 50, 5_000):
        codes, y, cut = rng.integers(0, 60_000, (n, 3)).astype(np.uint16), rng.random(n), np.array([10_000, 0, 65_535], dtype=np.uint16)
        assert [e.tolist() for e in tr._ends(codes)] == [codes.min(axis=0).tolist(), codes.max(axis=0).tolist()]
        under = codes < cut
        assert tr._under(codes, cut, y).tolist() == [under.sum(axis=0).tolist(), pytest.approx((under * y[:, None]).sum(axis=0))]


def test_equal_cuts_take_the_first_feature_in_any_partitioning(spark):
    """Two features that part the rows alike differ by rounding alone, which must not choose between them."""
    rng = np.random.default_rng(7)
    rows = [(Vectors.dense([a, 1 - a, b]), float(b) + 10 * float(a) + float(rng.normal())) for a, b in zip(rng.integers(0, 2, 3000).astype(float), rng.integers(0, 5, 3000).astype(float))]
    forests = [tr.ExtraTrees(trees=6, depth=4, share=1.0).fit(spark.createDataFrame(rows, ["features", "target"]).repartition(n)).forest for n in (1, 3, 7)]
    assert all((f.feature == forests[0].feature).all() and (f.threshold == forests[0].threshold).all() for f in forests)
    assert 0 in forests[0].feature and 1 not in forests[0].feature


def test_search_takes_what_is_fitted(spark):
    """A selector that is one of the candidates isn't fitted again on Train, and its score is the same."""
    fits = []

    class Counted(tr.ExtraTrees):
        def _fit(self, dataset):
            fits.append(dataset.count())
            return super()._fit(dataset)

    rng = random.Random(4)
    rows = [(("Train", "Valid", "Test")[i % 3], float(rng.randint(0, 9)), float(rng.randint(0, 4)), float(rng.randint(0, 9))) for i in range(150)]
    df = spark.createDataFrame([(s, a, b, c, 2 * a + b) for s, a, b, c in rows], "split string, a double, b double, c double, target double")
    table = ml.assembled(df, ["a", "b", "c"], F.col("split") == "Train")
    model = {"extra": Counted(trees=3, depth=3)}
    plain = ml.search(table, ["a", "b", "c"], {"all": ["a", "b", "c"]}, model)
    assert fits == [50, 100]
    selector = ml.fit_slice(table.filter("split = 'Train'"), range(3), model["extra"])
    assert ml.search(table, ["a", "b", "c"], {"all": ["a", "b", "c"]}, model, fitted={("all", "extra"): selector}) == [{k: pytest.approx(v) if isinstance(v, float) else v for k, v in r.items()} for r in plain]
    assert fits == [50, 100, 50, 100]

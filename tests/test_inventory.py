"""As-of inventory: intervals against many days, by bins and by sums of changes, held against all pairs."""

import datetime
import random

from tidemark.operators import lifecycle as lc
from tidemark.operators.ordering import running_totals


def tables(spark, n_days, seed):
    rng = random.Random(seed)
    start = datetime.date(2020, 1, 1)
    day = lambda k: start + datetime.timedelta(days=k)
    intervals = []
    for i in range(200):
        a = rng.randint(0, 900)
        b = rng.choice([a + rng.randint(-5, 400), 40000])
        intervals.append((i, rng.choice(["x", "y", None]), day(a) if rng.random() > 0.02 else None, day(b)))
    days = [day(rng.randint(-50, 1200)) for _ in range(n_days)] + [None] * 2
    schema = "asset_id int, status string, valid_from date, valid_to date"
    return intervals, days, spark.createDataFrame(intervals, schema), spark.createDataFrame([(d,) for d in days], "day date")


def test_held_equals_all_pairs(spark):
    for n_days, seed in ((1, 0), (4, 1), (300, 2)):
        intervals, days, df, dd = tables(spark, n_days, seed)
        want = sorted((i, d) for i, _, a, b in intervals for d in days if d and a and a <= d <= b)
        out = lc.held_on(df, dd)
        assert sorted((r["asset_id"], r["day"]) for r in out.collect()) == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert lc.held_on(df, dd.limit(0)).count() == 0 and lc.held_on(df.limit(0), dd).count() == 0


def test_counts_equal_all_pairs(spark):
    for n_days, seed in ((1, 3), (300, 4)):
        intervals, days, df, dd = tables(spark, n_days, seed)
        want = {}
        for _, s, a, b in intervals:
            for d in {d for d in days if d and a and a <= d <= b}:
                want[s, d] = want.get((s, d), 0) + 1
        out = lc.held_counts(df, dd, ["status"])
        assert {(r["status"], r["day"]): r["qty"] for r in out.collect()} == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        total = {}
        for (_, d), n in want.items():
            total[d] = total.get(d, 0) + n
        assert {r["day"]: r["qty"] for r in lc.held_counts(df, dd).collect()} == total
    assert lc.held_counts(df, dd.limit(0), ["status"]).count() == 0 and lc.held_counts(df.limit(0), dd).count() == 0


def test_running_totals(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 2, -3])) for i in range(500)]
    rng.shuffle(rows)
    got = {r["i"]: r["s"] for r in running_totals(spark.createDataFrame(rows, "i int, v int"), "s", "v", ["i"], ranges=7).collect()}
    total = 0
    for i, v in sorted(rows):
        total += v or 0
        assert got[i] == total

"""Queries of the demand and procurement operators."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import demand as dm
from ..operators import procurement as pr
from .bindings import AS_OF, ASSETS, BASE, MAINTENANCE, SERIES, assets, base, maintenance, query, read, series

DENSE = SERIES + """,
dense AS (SELECT dept, month, coalesce(actual, 0) AS actual FROM (SELECT dept, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM months GROUP BY dept) LEFT JOIN months USING (dept, month))"""


def monthly(spark, d):
    return dm.monthly_counts(series(spark, d), "day", ["dept"])


def dense(spark, d):
    return dm.dense_calendar(monthly(spark, d), ["dept"])


@query(f"WITH {BASE} SELECT asset_id, coalesce(disuse_date, acq_date + round_even(life_years * 365.25::DOUBLE, 0)::INT) AS event_date FROM base")
def f4_event_date(spark, d):
    return base(spark, d).select("asset_id", dm.event_date(F.col("disuse_date"), F.col("acq_date"), F.col("life_years")).alias("event_date"))


@query(f"WITH {SERIES} SELECT * FROM months")
def a12_monthly_counts(spark, d):
    return monthly(spark, d)


RARE = f"""{ASSETS}, rare AS (SELECT p_brand AS dept, date_trunc('month', l_shipdate)::DATE AS month, count(*) AS actual FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 50 GROUP BY ALL)"""


@query(f"""WITH {RARE} SELECT dept, month, coalesce(actual, 0) AS actual FROM (SELECT dept, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM rare GROUP BY dept) LEFT JOIN rare USING (dept, month)""")
def u4_dense_calendar(spark, d):
    part = read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("dept"))
    rare = read(spark, d, "lineitem").filter("l_quantity = 50").select("l_partkey", F.to_date("l_shipdate").alias("day")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return dm.dense_calendar(dm.monthly_counts(rare, "day", ["dept"]), ["dept"])


@query(f"""WITH {DENSE} SELECT dept, month, row_number() OVER (PARTITION BY dept ORDER BY month) - 1 AS trend, round(sin(month(month) * (2 * pi()) / 12), 9) + 0.0 AS month_sin, round(cos(month(month) * (2 * pi()) / 12), 9) + 0.0 AS month_cos FROM dense""")
def w8_f18_trend(spark, d):
    out = dm.with_trend(dense(spark, d), ["dept"])
    return out.select("dept", "month", F.col("trend").cast("long").alias("trend"), (F.round("month_sin", 9) + 0.0).alias("month_sin"), (F.round("month_cos", 9) + 0.0).alias("month_cos"))


@query(f"""WITH {DENSE} SELECT dept, month, actual, {', '.join(f'lag(actual, {k}) OVER w AS lag_{k}' for k in (1, 2, 3, 6, 12))},
  round(CASE WHEN count(actual) OVER w3 = 3 THEN avg(actual) OVER w3 END, 6) AS mean_3, round(CASE WHEN count(actual) OVER w6 = 6 THEN avg(actual) OVER w6 END, 6) AS mean_6, round(CASE WHEN count(actual) OVER w6 = 6 THEN stddev_samp(actual) OVER w6 END, 6) AS std_6
FROM dense WINDOW w AS (PARTITION BY dept ORDER BY month), w3 AS (PARTITION BY dept ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w6 AS (PARTITION BY dept ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")
def w7_lags(spark, d):
    return dm.with_lags(dense(spark, d), ["dept"]).withColumns({c: F.round(c, 6) for c in ("mean_3", "mean_6", "std_6")})


SPLIT = DENSE + """,
cut AS (SELECT *, count(*) OVER (PARTITION BY dept) AS n, row_number() OVER (PARTITION BY dept ORDER BY month DESC) AS k FROM dense),
split AS (SELECT dept, month, actual, CASE WHEN n >= 36 THEN CASE WHEN k <= least(12, greatest(6, n // 6)) THEN 'Test' WHEN k <= least(12, greatest(6, n // 6)) + least(6, greatest(3, n // 12)) THEN 'Valid' ELSE 'Train' END END AS split FROM cut)"""


@query(f"WITH {SPLIT} SELECT * FROM split")
def w9_positional_split(spark, d):
    return dm.positional_split(dense(spark, d), ["dept"])


@query(f"WITH {DENSE} SELECT dept, month, actual FROM (SELECT *, row_number() OVER (PARTITION BY dept ORDER BY month DESC) AS k FROM dense) WHERE k <= 12")
def t12_last_months(spark, d):
    return dm.last_months(dense(spark, d), ["dept"])


NAIVE = SPLIT + """,
hist AS (SELECT * FROM split WHERE split <> 'Test'), fut AS (SELECT * FROM split WHERE split = 'Test'),
tail AS (SELECT dept, avg(actual) AS m FROM (SELECT *, row_number() OVER (PARTITION BY dept ORDER BY month DESC) AS k FROM hist) WHERE k <= 12 GROUP BY dept),
naive AS (SELECT f.dept, f.month, f.actual, coalesce(h.actual::DOUBLE, t.m) AS naive FROM fut f LEFT JOIN hist h ON h.dept = f.dept AND h.month = (f.month - INTERVAL 12 MONTH)::DATE LEFT JOIN tail t ON t.dept = f.dept)"""


def naive(spark, d):
    split = dm.positional_split(dense(spark, d), ["dept"])
    return dm.seasonal_naive(split.filter("split <> 'Test'"), split.filter("split = 'Test'"), ["dept"]).select("dept", "month", "actual", "naive")


@query(f"WITH {NAIVE} SELECT dept, month, actual, round(naive, 6) AS naive FROM naive")
def j19_seasonal_naive(spark, d):
    return naive(spark, d).withColumn("naive", F.round("naive", 6))


@query(f"WITH {SPLIT} SELECT dept, round(avg(actual), 6) AS forecast FROM (SELECT *, row_number() OVER (PARTITION BY dept ORDER BY month DESC) AS k FROM split WHERE split <> 'Test') WHERE k <= 6 GROUP BY dept")
def w13_moving_average(spark, d):
    split = dm.positional_split(dense(spark, d), ["dept"])
    return dm.moving_average(split.filter("split <> 'Test'"), ["dept"], 6).withColumn("forecast", F.round("forecast", 6))


@query(f"""WITH {NAIVE} SELECT dept, round(sqrt(avg((actual - naive) ** 2)), 6) AS rmse, round(avg(abs(actual - naive)), 6) AS mae,
  round(avg(CASE WHEN abs(actual) + abs(naive) > 0 THEN 2 * abs(naive - actual) / (abs(actual) + abs(naive)) END) * 100, 6) AS smape FROM naive GROUP BY dept""")
def m8_baselines(spark, d):
    out = naive(spark, d)
    both = dm.regression_metrics(out, "actual", "naive", ["dept"]).join(dm.smape(out, "actual", "naive", ["dept"]), "dept")
    return both.select("dept", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "smape")])


@query(f"""WITH {NAIVE}, h AS (SELECT dept, actual, row_number() OVER (PARTITION BY dept ORDER BY month DESC) AS k FROM split WHERE split <> 'Test'),
w AS (SELECT dept, w, avg(actual) AS f FROM h, (VALUES (3), (6), (12)) t(w) WHERE k <= w GROUP BY ALL),
every AS (SELECT dept, 'SeasonalNaive' AS model, actual, naive AS f FROM naive UNION ALL SELECT s.dept, 'MovingAverage' || w::VARCHAR, s.actual, f FROM split s JOIN w USING (dept) WHERE s.split = 'Test')
SELECT dept, model, round(sqrt(avg((actual - f) ** 2)), 6) AS rmse, round(avg(abs(actual - f)), 6) AS mae, round(avg(CASE WHEN abs(actual) + abs(f) > 0 THEN 2 * abs(f - actual) / (abs(actual) + abs(f)) END) * 100, 6) AS smape FROM every GROUP BY ALL""")
def m8_all_baselines(spark, d):
    split = dm.positional_split(dense(spark, d), ["dept"])
    out = dm.baselines(split.filter("split <> 'Test'"), split.filter("split = 'Test'"), ["dept"])
    both = dm.regression_metrics(out, "actual", "forecast", ["dept", "model"]).join(dm.smape(out, "actual", "forecast", ["dept", "model"]), ["dept", "model"])
    return both.select("dept", "model", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "smape")])


FIT = "fit AS (SELECT l_returnflag AS flag, l_extendedprice / 1000 AS y, l_quantity * 2 AS p FROM lineitem)"


def fit(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 2).alias("p"))


@query(f"WITH {FIT} SELECT flag, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(y)), 6) AS r2, count(*) AS n FROM fit GROUP BY flag")
def a16_regression_metrics(spark, d):
    return dm.regression_metrics(fit(spark, d), "y", "p", ["flag"]).withColumns({c: F.round(c, 6) for c in ("rmse", "mae", "r2")})


@query(f"""WITH {FIT}, c AS (SELECT flag, sum((y <= 40 AND p <= 40)::INT)::BIGINT AS tp, sum((y > 40 AND p <= 40)::INT)::BIGINT AS fp, sum((y <= 40 AND p > 40)::INT)::BIGINT AS fn FROM fit GROUP BY flag)
SELECT flag, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c""")
def a17_urgent_metrics(spark, d):
    return dm.urgent_metrics(fit(spark, d), "y", "p", 40.0, ["flag"]).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("""WITH f AS (SELECT l_returnflag AS flag, l_extendedprice / 1000 - 20 AS y, l_quantity * 2 - 30 AS p FROM lineitem)
SELECT flag, round(avg(CASE WHEN abs(y) + abs(greatest(p, 0)) > 0 THEN 2 * abs(greatest(p, 0) - y) / (abs(y) + abs(greatest(p, 0))) END) * 100, 6) AS smape FROM f GROUP BY flag""")
def a18_smape(spark, d):
    df = fit(spark, d).withColumns({"y": F.col("y") - 20, "p": F.col("p") - 30})
    return dm.smape(df, "y", "p", ["flag"]).withColumn("smape", F.round("smape", 6))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS y, l_quantity * 2 - 30 AS p, abs(l_extendedprice / 1000 - (l_quantity * 2 - 30)) AS abs_error, greatest(l_quantity * 2 - 30, 0) AS clipped FROM lineitem")
def p21_evaluation_frame(spark, d):
    df = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 2 - 30).alias("p"))
    return dm.evaluation_frame(df, "y", "p")


@query("SELECT o_orderstatus, min(o_orderdate::DATE) AS first, max(o_orderdate::DATE) AS last, count(*) AS n FROM orders GROUP BY 1")
def a30_period_summary(spark, d):
    return dm.period_summary(read(spark, d, "orders").select("o_orderstatus", F.to_date("o_orderdate").alias("day")), "day", ["o_orderstatus"])


@query(f"WITH {DENSE} SELECT dept, round(coalesce(stddev_samp(actual), 0), 6) AS sigma_d FROM dense GROUP BY dept")
def a31_demand_sigma(spark, d):
    return dm.demand_sigma(dense(spark, d), ["dept"]).withColumn("sigma_d", F.round("sigma_d", 6))


@query(f"""WITH {FIT}, b AS (SELECT p_brand AS model, round(sqrt(avg((l_extendedprice / 1000 - l_quantity * 2) ** 2)), 6) AS rmse FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT model, rmse, row_number() OVER (ORDER BY rmse, model) AS place FROM b QUALIFY place <= 12""")
def w10_candidate_ranking(spark, d):
    return dm.ranked(candidates(spark, d), "rmse", "model", 12).withColumn("place", F.col("place").cast("long"))


def candidates(spark, d):
    part = read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("model"))
    df = read(spark, d, "lineitem").select("l_partkey", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 2).alias("p")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return dm.regression_metrics(df, "y", "p", ["model"]).select("model", F.round("rmse", 6).alias("rmse"))


CANDIDATES = "b AS (SELECT p_brand AS model, round(sqrt(avg((l_extendedprice / 1000 - l_quantity * 2) ** 2)), 6) AS rmse FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"


@query(f"WITH {CANDIDATES} SELECT model, rmse, rmse < 30.0 AS promote FROM b ORDER BY rmse, model LIMIT 1")
def t11_best_model(spark, d):
    return dm.ranked(candidates(spark, d), "rmse", "model", 1).select("model", "rmse", (F.col("rmse") < 30.0).alias("promote"))


@query(f"WITH {CANDIDATES}, held AS (SELECT rmse AS current FROM b ORDER BY model LIMIT 1) SELECT model, rmse, current, rmse < current AS promote FROM b, held ORDER BY rmse, model LIMIT 1")
def t11_promotion(spark, d):
    """The model in use is the first by name; its stored metric is what the best one has to beat."""
    every = candidates(spark, d)
    return dm.promote(every, every.join(every.agg(F.min("model").alias("model")), "model", "left_semi").select("rmse"), "rmse", "model").select("model", "rmse", "current", "promote")


@query(f"WITH {CANDIDATES} SELECT model, rmse, round(rmse - min(rmse) OVER (), 6) AS delta FROM b")
def a20_delta_to_best(spark, d):
    return pr.delta_to_best(candidates(spark, d), "rmse").withColumn("delta", F.round("delta", 6))


@query(f"WITH {SPLIT} SELECT dept, month, actual FROM split WHERE split = 'Train' UNION ALL SELECT dept, month, actual FROM split WHERE split = 'Valid'")
def u3_refit_rows(spark, d):
    split = dm.positional_split(dense(spark, d), ["dept"])
    return split.filter("split = 'Train'").unionByName(split.filter("split = 'Valid'")).select("dept", "month", "actual")


@query(f"WITH {ASSETS} SELECT asset_id, class_name FROM asset WHERE dept_code = (SELECT min(n_name) FROM nation) AND class_name = 'BUILDING'")
def p7_scope(spark, d):
    first = read(spark, d, "nation").agg(F.min("n_name")).first()[0]
    return pr.scope(assets(spark, d), first, "BUILDING").select("asset_id", "class_name")


TERMS = ["1학기", "summer", "2", "winter", "all"]
DATES = """t AS (SELECT o_orderkey, year(o_orderdate) AS y, (o_orderkey % 5)::INT AS k FROM orders),
td AS (SELECT o_orderkey, k, CASE k WHEN 0 THEN make_date(y, 3, 2) WHEN 1 THEN make_date(y, 6, 21) WHEN 2 THEN make_date(y, 9, 1) WHEN 3 THEN make_date(y, 12, 21) ELSE make_date(y, 1, 1) END AS start_date,
  CASE k WHEN 0 THEN make_date(y, 6, 20) WHEN 1 THEN make_date(y, 8, 31) WHEN 2 THEN make_date(y, 12, 20) WHEN 3 THEN make_date(y + 1, 2, 28) ELSE make_date(y, 12, 31) END AS end_date FROM t)"""


def dates(spark, d):
    term = F.element_at(F.array(*[F.lit(x) for x in TERMS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    start, end = pr.term_dates(F.year("o_orderdate"), term)
    return read(spark, d, "orders").select("o_orderkey", "o_orderdate", term.alias("term"), start.alias("start_date"), end.alias("end_date"))


@query(f"WITH {DATES} SELECT o_orderkey, start_date, end_date FROM td")
def f7_term_dates(spark, d):
    return dates(spark, d).select("o_orderkey", "start_date", "end_date")


@query(f"WITH {DATES} SELECT o_orderkey, list_aggregate(list_transform(generate_series(date_trunc('month', start_date), date_trunc('month', end_date), INTERVAL 1 MONTH), lambda x: month(x)::VARCHAR), 'string_agg', ',') AS months FROM td")
def f8_term_months(spark, d):
    return dates(spark, d).select("o_orderkey", F.array_join(pr.months_of(F.col("start_date"), F.col("end_date")).cast("array<string>"), ",").alias("months"))


@query(f"WITH {DATES} SELECT td.o_orderkey FROM td JOIN orders USING (o_orderkey) WHERE o_orderdate::DATE BETWEEN start_date AND end_date")
def p8_within_term(spark, d):
    df = dates(spark, d).withColumn("failure_date", F.to_date("o_orderdate"))
    return pr.within(df, "failure_date", F.col("start_date"), F.col("end_date")).select("o_orderkey")


LIFE = f"""life AS (SELECT *, greatest(life_years * 12 - age * 12, 0.5) AS rul FROM base),
due AS (SELECT *, DATE '{AS_OF}' + floor(greatest(rul, 0.5) * 30.4375::DOUBLE)::INT AS failure_date FROM life)"""


def life(spark, d):
    rul = pr.remaining_life(F.col("life_years") * 12.0, F.col("age"))
    return base(spark, d).withColumn("rul", rul).withColumn("failure_date", pr.failure_date(F.col("rul"), F.lit(AS_OF).cast("date")))


@query(f"WITH {BASE}, {LIFE} SELECT asset_id, round(rul, 6) AS rul FROM life")
def f17_remaining_life(spark, d):
    return life(spark, d).select("asset_id", F.round("rul", 6).alias("rul"))


@query(f"WITH {BASE}, {LIFE} SELECT asset_id, failure_date, DATE '{AS_OF}' + floor(rul * 30.44::DOUBLE)::INT AS notebook_date FROM due")
def f9_failure_date(spark, d):
    return life(spark, d).select("asset_id", "failure_date", pr.failure_date(F.col("rul"), F.lit(AS_OF).cast("date"), "notebook").alias("notebook_date"))


@query(f"WITH {BASE}, {LIFE} SELECT asset_id, strftime(date_trunc('month', failure_date) - to_months((asset_id % 4)::INT), '%Y-%m') AS order_in, DATE '{AS_OF}' + (greatest(3 - asset_id % 4, 0) * 30)::INT AS order_by FROM due")
def f10_f11_order_dates(spark, d):
    lead = (F.col("asset_id") % 4).cast("int")
    return life(spark, d).select("asset_id", pr.order_month(F.col("failure_date"), lead).alias("order_in"), pr.order_deadline(F.lit(AS_OF).cast("date"), F.lit(3), lead).alias("order_by"))


@query(f"""WITH {BASE}, {LIFE}, g AS (SELECT asset_id, CASE WHEN asset_id % 9 <> 0 THEN failure_date END AS f, ceil(1.65::DOUBLE * (life_years % 4 + 2))::INT AS buffer_days, asset_id % 4 AS grade FROM due)
SELECT asset_id, buffer_days::BIGINT AS buffer_days, (buffer_days + CASE grade WHEN 1 THEN 20 WHEN 2 THEN 38 ELSE 7 END)::BIGINT AS prep_days, f - (buffer_days + CASE grade WHEN 1 THEN 20 WHEN 2 THEN 38 ELSE 7 END)::INT AS order_date, CASE WHEN f IS NULL THEN 'bad failure date' END AS error FROM g""")
def f12_safety_plan(spark, d):
    failure = F.when(F.col("asset_id") % 9 == 0, "soon").otherwise(F.date_format("failure_date", "yyyy-MM-dd"))
    out = pr.safety_plan(failure, F.lit(1.65), F.col("life_years") % 4 + 2, F.col("asset_id") % 4)
    return life(spark, d).select("asset_id", *[(c.cast("long") if n.endswith("_days") else c).alias(n) for n, c in out.items()])


@query(f"""WITH {ASSETS} SELECT asset_id, CASE WHEN acq_amount * 200 <= 20000000 THEN 0 WHEN acq_amount * 200 < 50000000 THEN 1 ELSE 2 END::BIGINT AS grade, CASE WHEN acq_amount * 200 <= 20000000 THEN 20.0 WHEN acq_amount * 200 < 50000000 THEN 60.0 ELSE 100.0 END::DOUBLE AS grade_score,
  CASE WHEN acq_amount * 200 <= 20000000 THEN 0.48 WHEN acq_amount * 200 < 50000000 THEN 0.81 ELSE 1.12 END::DOUBLE AS sqrt_lead, CASE WHEN acq_amount * 200 <= 20000000 THEN 7 WHEN acq_amount * 200 < 50000000 THEN 20 ELSE 38 END::BIGINT AS days,
  0.5::DOUBLE * 100 * 0.5::DOUBLE + CASE WHEN acq_amount * 200 <= 20000000 THEN 20.0 WHEN acq_amount * 200 < 50000000 THEN 60.0 ELSE 100.0 END::DOUBLE * 0.5::DOUBLE AS importance FROM asset""")
def f15_lead_time(spark, d):
    out = pr.lead_time(F.col("acq_amount") * 200, F.lit(0.5))
    return assets(spark, d).select("asset_id", *[(c.cast("long") if n in ("grade", "days") else c).alias(n) for n, c in out.items()])


Z95 = NormalDist().inv_cdf(0.95)


@query(f"WITH {ASSETS} SELECT asset_id, ceil({Z95!r}::DOUBLE * (life_years % 3 + 0.5::DOUBLE) * sqrt(asset_id % 5 + 1))::BIGINT AS stock, ceil(life_years / 3.0::DOUBLE * (asset_id % 5 + 1) + 4)::BIGINT AS rop, ceil((asset_id % 50) * 1.2::DOUBLE)::BIGINT AS service_qty FROM asset")
def f19_f20_stock_levels(spark, d):
    lead = F.col("asset_id") % 5 + 1
    return assets(spark, d).select("asset_id", pr.safety_stock(F.col("life_years") % 3 + 0.5, lead, 0.95).cast("long").alias("stock"), pr.reorder_point(F.col("life_years") / 3.0, lead, F.lit(4)).cast("long").alias("rop"), pr.service_quantity(F.col("asset_id") % 50, 1.2).cast("long").alias("service_qty"))


@query(f"""WITH {BASE}, {LIFE} SELECT asset_id, CASE WHEN rul <= 6 AND (asset_id % 10) / 10.0::DOUBLE >= 0.7::DOUBLE THEN 'buy now' WHEN rul <= 6 THEN 'replace' WHEN (asset_id % 10) / 10.0::DOUBLE >= 0.7::DOUBLE THEN 'watch' ELSE 'normal' END AS zone FROM life""")
def f26_zones(spark, d):
    return life(spark, d).select("asset_id", pr.zone(F.col("rul"), F.col("asset_id") % 10 / 10.0).alias("zone"))


@query(f"""WITH {BASE}, {LIFE} SELECT asset_id, CASE asset_id % 5 WHEN 1 THEN 6 WHEN 2 THEN 9 WHEN 3 THEN 12 ELSE 3 END::BIGINT AS months, rul <= CASE asset_id % 5 WHEN 1 THEN 6 WHEN 2 THEN 9 WHEN 3 THEN 12 ELSE 3 END AS fails FROM life""")
def f27_term_failures(spark, d):
    term = F.element_at(F.array(*[F.lit(x) for x in (*pr.TERM_MONTHS, "?")]), (F.col("asset_id") % 5 + 1).cast("int"))
    return life(spark, d).select("asset_id", pr.term_months(term).cast("long").alias("months"), (F.col("rul") <= pr.term_months(term)).alias("fails"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 0.0 WHEN 'error' THEN 1.65 ELSE 1.28 END::DOUBLE AS z_risk, CASE WHEN regexp_matches(event_type, 'err|sign') THEN 1.65 WHEN regexp_matches(event_type, 'view') THEN 0.0 ELSE 1.28 END::DOUBLE AS z_intent FROM events""")
def f28_risk_factors(spark, d):
    level = F.when(F.col("event_type") == "click", "Low").when(F.col("event_type") == "error", "HIGH").otherwise(F.col("event_type"))
    return read(spark, d, "events").select("event_id", pr.risk_z(level).alias("z_risk"), pr.intent_z(F.col("event_type"), "err|sign", "view").alias("z_intent"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN '50% 수준' WHEN 'error' THEN '95% 이상 안정' ELSE '90% 수준' END AS service_level FROM events")
def f28_service_levels(spark, d):
    level = F.when(F.col("event_type") == "click", "Low").when(F.col("event_type") == "error", "High").when(F.col("event_type") == "view", "Medium")
    return read(spark, d, "events").select("event_id", pr.service_level(level).alias("service_level"))


META = f"""meta AS (SELECT item_name, max(lead_grade)::BIGINT AS lead_grade, avg(acq_amount) AS unit_price, max(lead_grade) + 1 AS lead_months, ceil({Z95!r}::DOUBLE * 2.0::DOUBLE * sqrt(max(lead_grade) + 1))::BIGINT AS safety_stock FROM (
  SELECT dept_code || class_name AS item_name, acq_amount, (asset_id % 3)::INT AS lead_grade FROM due) GROUP BY 1)"""


def rated(spark, d):
    return life(spark, d).withColumns({"item_name": F.concat("dept_code", "class_name"), "lead_grade": (F.col("asset_id") % 3).cast("int")})


def meta(spark, d):
    return pr.item_meta(rated(spark, d)).withColumn("safety_stock", pr.safety_stock(F.lit(2.0), F.col("lead_months"), 0.95))


@query(f"WITH {BASE}, {LIFE}, {META} SELECT item_name, lead_grade, lead_months::BIGINT AS lead_months, round(unit_price, 7) AS unit_price, safety_stock FROM meta")
def a14_item_meta(spark, d):
    return meta(spark, d).select("item_name", F.col("lead_grade").cast("long").alias("lead_grade"), F.col("lead_months").cast("long").alias("lead_months"), F.round("unit_price", 7).alias("unit_price"), F.col("safety_stock").cast("long").alias("safety_stock"))


@query(f"""WITH {BASE}, {LIFE}, {META}, per AS (SELECT date_trunc('month', failure_date)::DATE AS month, dept_code || class_name AS item_name, count(*) AS failures FROM due GROUP BY ALL)
SELECT strftime(month, '%Y-%m') AS month, sum(failures)::BIGINT AS failures, sum(failures + coalesce(safety_stock, 0))::BIGINT AS need, min(strftime(month - to_months(lead_months::INT), '%Y-%m')) AS order_in FROM per LEFT JOIN meta USING (item_name) GROUP BY 1""")
def a13_j11_monthly_needs(spark, d):
    out = pr.monthly_needs(rated(spark, d), meta(spark, d))
    return out.withColumn("need", F.col("need").cast("long"))


@query(f"WITH {BASE}, {LIFE} SELECT dept_code || class_name AS item_name, count(*) AS failures FROM due WHERE rul <= 3 GROUP BY 1")
def a15_failures_by_item(spark, d):
    return pr.failures_by_item(rated(spark, d), F.col("rul") <= 3)


@query(f"""WITH {BASE}, {LIFE}, {META}, f AS (SELECT dept_code || class_name AS item_name, count(*) AS n FROM due WHERE rul <= 3 GROUP BY 1),
q AS (SELECT item_name, ceil(ceil(n * 1.2::DOUBLE) / 3 * lead_months + safety_stock)::BIGINT AS quantity, round(unit_price * 100, 2) AS unit_price, lead_months FROM f JOIN meta USING (item_name)),
b AS (SELECT *, floor(quantity * unit_price)::BIGINT AS budget FROM q WHERE quantity > 0)
SELECT item_name, quantity, budget, format('{{:,}}', budget) || '원' AS budget_text, DATE '{AS_OF}' + (greatest(3 - lead_months, 0) * 30)::INT AS order_by,
  CASE WHEN lead_months >= 3 THEN 'lead time ' || lead_months::VARCHAR || ' months: order now' WHEN budget > 10000000 THEN 'high budget: pool departments' ELSE 'can be had within 1학기' END AS comment FROM b""")
def f29_t9_procurement_plan(spark, d):
    own = rated(spark, d)
    df = pr.failures_by_item(own, F.col("rul") <= 3).join(meta(spark, d), "item_name")
    df = df.withColumns({"quantity": pr.reorder_point(pr.service_quantity(F.col("failures"), 1.2) / 3, F.col("lead_months"), F.col("safety_stock")).cast("long"), "unit_price": F.round(F.col("unit_price") * 100, 2)})
    return pr.plan(df, AS_OF, 3, "1학기")


@query(f"""WITH {BASE}, {LIFE}, c(pos, class, a, b) AS (VALUES (0, '<=6', -1e9, 6), (1, '6-12', 6, 12), (2, '12-24', 12, 24), (3, '24-60', 24, 60), (4, '>60', 60, 1e9))
SELECT pos::BIGINT AS pos, class, count(rul) AS n, round(count(rul) * 100.0 / sum(count(rul)) OVER (), 6) AS percent FROM c LEFT JOIN life ON rul > a AND rul <= b GROUP BY pos, class""")
def a19_rul_distribution(spark, d):
    return pr.rul_distribution(life(spark, d), "rul").select(F.col("pos").cast("long").alias("pos"), "class", "n", F.round("percent", 6).alias("percent"))


MONTHS = f"""m AS (SELECT dept_code AS dept, month(failure_date)::INT AS m, count(*) AS n FROM due GROUP BY ALL)"""


def by_month(spark, d):
    return life(spark, d).groupBy(F.col("dept_code").alias("dept"), F.month("failure_date").alias("m")).agg(F.count("*").alias("n"))


@query(f"WITH {BASE}, {LIFE}, {MONTHS} SELECT dept, k::BIGINT AS m, coalesce(n, 0) AS n FROM (SELECT DISTINCT dept, unnest(range(1, 13)) AS k FROM m) LEFT JOIN m USING (dept) WHERE m.m = k UNION ALL SELECT dept, k::BIGINT, 0 FROM (SELECT DISTINCT dept, unnest(range(1, 13)) AS k FROM m) g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.dept = g.dept AND m.m = g.k)")
def j12_months_grid(spark, d):
    return pr.months_grid(by_month(spark, d), ["dept"], "n").withColumn("m", F.col("m").cast("long"))


WINTER = [12, 1, 2]
PEAK = "peak AS (SELECT dept, arg_max(m, n * 100 - CASE m WHEN 12 THEN 1 WHEN 1 THEN 2 ELSE 3 END) AS peak FROM m WHERE m IN (12, 1, 2) GROUP BY dept)"


@query(f"WITH {BASE}, {LIFE}, {MONTHS}, {PEAK} SELECT dept, peak::BIGINT AS peak FROM peak")
def t8_peak_month(spark, d):
    return pr.peak_month(by_month(spark, d), ["dept"], WINTER, "n").withColumn("peak", F.col("peak").cast("long"))


@query(f"""WITH {BASE}, {LIFE}, {MONTHS}, {PEAK}, g AS (SELECT DISTINCT dept, unnest(range(1, 13)) AS m FROM m)
SELECT dept, g.m::BIGINT AS m, CASE WHEN g.m IN (12, 1, 2) THEN coalesce(n, 0) ELSE 0 END AS n, g.m = CASE WHEN peak = 2 THEN 1 ELSE 12 END AS is_rop,
  CASE WHEN g.m = CASE WHEN peak = 2 THEN 1 ELSE 12 END THEN CASE g.m WHEN 1 THEN '2002-01-01' WHEN 2 THEN '2002-02-01' END END AS rop_date FROM g LEFT JOIN m USING (dept, m) LEFT JOIN peak USING (dept)""")
def f51_term_response(spark, d):
    return pr.term_response(by_month(spark, d), ["dept"], WINTER, {1: "2002-01-01", 2: "2002-02-01"}, "n").withColumn("m", F.col("m").cast("long"))


@query(f"""WITH {BASE}, {LIFE}, x AS (SELECT asset_id, item_name, CASE WHEN asset_id % 3 <> 0 THEN failure_date END AS failure_date, CASE WHEN asset_id % 2 = 0 THEN 1 END AS lead_grade, CASE WHEN asset_id % 5 <> 0 THEN 4.0 END::DOUBLE AS rmse FROM due)
SELECT asset_id, item_name, failure_date, coalesce(lead_grade, 0)::BIGINT AS lead_grade, coalesce(rmse, 5.0) AS rmse FROM (SELECT *, row_number() OVER (PARTITION BY item_name ORDER BY failure_date NULLS LAST, asset_id) AS n FROM x) WHERE n = 1""")
def f52_item_lookup(spark, d):
    df = life(spark, d).select("asset_id", "item_name", F.when(F.col("asset_id") % 3 != 0, F.col("failure_date")).alias("failure_date"), F.when(F.col("asset_id") % 2 == 0, 1).alias("lead_grade"), F.when(F.col("asset_id") % 5 != 0, 4.0).alias("rmse"))
    return pr.item_lookup(df).withColumn("lead_grade", F.col("lead_grade").cast("long"))

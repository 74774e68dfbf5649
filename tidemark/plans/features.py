"""Queries of the feature operators; feature_table is the whole job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as fe
from ..sources.tables import staged
from .bindings import AS_OF, ASSETS, BASE, MAINTENANCE, OUTCOMES, TRIMMED, assets, base, latest_outcome, maintenance, query, read, trimmed


@query(f"WITH {BASE} SELECT asset_id, disuse_date, disuse_confirm, reason::BIGINT AS reason, disposal_confirm, method::BIGINT AS method FROM joined")
def j4_outcomes(spark, d):
    out = latest_outcome(spark, d, "R").select("asset_id", F.col("event_date").alias("disuse_date"), F.col("confirm_date").alias("disuse_confirm"), "reason")
    gone = latest_outcome(spark, d, "A").select("asset_id", F.col("confirm_date").alias("disposal_confirm"), "method")
    return fe.join_outcomes(assets(spark, d).select("asset_id"), out, gone)


@query(f"WITH {BASE} SELECT asset_id, ref_date FROM base")
def f1_reference_date(spark, d):
    return base(spark, d).select("asset_id", "ref_date")


@query(f"WITH {BASE} SELECT asset_id, age FROM base")
def f2_age(spark, d):
    return base(spark, d).select("asset_id", "age")


@query(f"""WITH {ASSETS}, m AS (SELECT asset_id, month(acq_date) AS m FROM asset)
SELECT asset_id, CASE WHEN m IN (3, 4, 5, 6) THEN 'first' WHEN m IN (7, 8) THEN 'summer' WHEN m IN (9, 10, 11, 12) THEN 'second' ELSE 'winter' END AS term,
  CASE WHEN m IN (3, 4, 5, 6) THEN 1 WHEN m IN (7, 8) THEN 2 WHEN m IN (9, 10, 11, 12) THEN 3 ELSE 0 END::BIGINT AS term_code,
  (m IN (2, 3, 8, 9))::BIGINT AS is_prep_month, (m = 12)::BIGINT AS is_budget_month, (m IN (1, 2, 7, 8))::BIGINT AS is_vacation FROM m""")
def f3_terms(spark, d):
    return assets(spark, d).select("asset_id", *[(c if n == "term" else c.cast("long")).alias(n) for n, c in fe.term_features(F.col("acq_date")).items()])


@query(f"""WITH {BASE} SELECT asset_id, round_even((life_years % 4 - age) * 100, 0) / 100 AS life_left, round_even(age * 1.2::DOUBLE * 100, 0) / 100 AS load,
  CASE WHEN life_years % 4 <> 0 THEN round_even(least(greatest(pow(age / nullif(life_years % 4, 0), 2), 0.0::DOUBLE), 1.0::DOUBLE) * 100, 0) / 100 END AS wear FROM base""")
def f13_wear(spark, d):
    return base(spark, d).select("asset_id", *[c.alias(n) for n, c in fe.wear_features(F.col("life_years") % 4, F.col("age"), F.lit(1.2)).items()])


PRICES = """p AS (SELECT asset_id, acq_amount * 100 AS price, round_even(least(greatest(ln(1 + acq_amount * 100) / ln(1 + 1e8::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) * 100, 0) / 100 AS sensitivity,
  CASE WHEN acq_amount * 100 < 5000000 THEN 0 WHEN acq_amount * 100 < 30000000 THEN 1 ELSE 2 END AS lead_grade FROM asset)"""


@query(f"WITH {ASSETS}, {PRICES} SELECT asset_id, sensitivity, lead_grade::BIGINT AS lead_grade, round_even((sensitivity * 0.7::DOUBLE + lead_grade * 0.5::DOUBLE * 0.3::DOUBLE) * 100, 0) / 100 AS importance FROM p")
def f14_price_features(spark, d):
    return assets(spark, d).select("asset_id", *[(c.cast("long") if n == "lead_grade" else c).alias(n) for n, c in fe.price_features(F.col("acq_amount") * 100).items()])


@query(f"WITH {ASSETS} SELECT asset_id, CASE WHEN regexp_matches(dept_code, '1|7') THEN 1.3 WHEN regexp_matches(dept_code, '2|5') THEN 1.2 ELSE 1.0 END::DOUBLE AS severity FROM asset")
def f23_severity(spark, d):
    return assets(spark, d).select("asset_id", fe.severity(F.col("dept_code"), "1|7", "2|5").alias("severity"))


@query(f"WITH {BASE} SELECT asset_id, label FROM base")
def f24_end_of_life(spark, d):
    return base(spark, d).select("asset_id", "label")


@query(f"WITH {MAINTENANCE} SELECT asset_id, (event_type IN ('R', 'A') OR result = 'F') AS is_repair, count(*) AS n FROM maintenance GROUP BY ALL")
def f25_repairs(spark, d):
    flag = fe.is_repair(F.col("event_type"), F.col("result"), ["R", "A"], ["F"])
    return maintenance(spark, d).groupBy("asset_id", flag.alias("is_repair")).agg(F.count("*").alias("n"))


@query(f"""WITH {ASSETS}, c AS (SELECT *, CASE WHEN asset_id % 10 <> 0 THEN item_name END AS item FROM asset)
SELECT asset_id, coalesce(dense_rank() OVER (ORDER BY item NULLS LAST) - 1, -1) * (item IS NOT NULL)::INT - (item IS NULL)::INT AS item_code,
  CASE class_name WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 2 ELSE 1 END::BIGINT AS budget_code FROM c""")
def f30_codes(spark, d):
    df = assets(spark, d).withColumn("item", F.when(F.col("asset_id") % 10 != 0, F.col("item_name")))
    grade = F.when(F.col("class_name") == "BUILDING", "LOW").when(F.col("class_name") == "MACHINERY", "HIGH")
    return fe.category_codes(df, "item", "item_code").select("asset_id", F.col("item_code").cast("long").alias("item_code"), fe.budget_code(grade).cast("long").alias("budget_code"))


@query(f"""WITH {ASSETS}, p AS (SELECT asset_id, CASE WHEN asset_id % 7 = 0 THEN 0 WHEN asset_id % 7 = 1 THEN NULL ELSE acq_amount END AS price FROM asset)
SELECT asset_id, coalesce(nullif(price, 0), (SELECT median(price) FROM p WHERE price > 0)) AS acq_amount FROM p""")
def a6_median_price(spark, d):
    df = assets(spark, d).select("asset_id", F.when(F.col("asset_id") % 7 == 0, 0.0).when(F.col("asset_id") % 7 != 1, F.col("acq_amount")).alias("acq_amount"))
    return fe.fill_price(df)


@query(f"""WITH {ASSETS}, p AS (SELECT asset_id, CASE WHEN asset_id % 7 <> 0 THEN life_years END AS life FROM asset)
SELECT asset_id, coalesce(life, (SELECT life FROM p WHERE life IS NOT NULL GROUP BY life ORDER BY count(*) DESC, life LIMIT 1))::BIGINT AS life_years FROM p""")
def a7_mode_life(spark, d):
    df = assets(spark, d).select("asset_id", F.when(F.col("asset_id") % 7 != 0, F.col("life_years")).alias("life_years"))
    return fe.fill_mode(df, "life_years").withColumn("life_years", F.col("life_years").cast("long"))


@query(f"WITH {BASE} SELECT quantile_cont(age, 0.25) AS q1, quantile_cont(age, 0.75) AS q3 FROM base WHERE label = 'Y'")
def a8_quartiles(spark, d):
    return fe.quartile_bounds(base(spark, d).filter("label = 'Y'"), "age").select("q1", "q3")


@query(f"WITH {TRIMMED} SELECT asset_id, age, label FROM trimmed")
def p20_drop_outliers(spark, d):
    return trimmed(spark, d).select("asset_id", "age", "label")


@query(f"""WITH {TRIMMED}, o AS (SELECT * FROM base WHERE label = 'Y' AND asset_id NOT IN (SELECT asset_id FROM trimmed))
SELECT count(*) AS n, min(age) AS lo, max(age) AS hi, (SELECT item_name FROM o GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_item FROM o""")
def a9_outlier_statistics(spark, d):
    b = base(spark, d)
    bounds = fe.quartile_bounds(b.filter("label = 'Y'"), "age")
    out = b.filter("label = 'Y'").join(F.broadcast(bounds)).filter("age < low OR age > high")
    return out.agg(F.count("*").alias("n"), F.min("age").alias("lo"), F.max("age").alias("hi"), F.mode("item_name", True).alias("top_item"))


@query(f"""WITH {TRIMMED}, o AS (SELECT * FROM base WHERE label = 'Y' AND asset_id NOT IN (SELECT asset_id FROM trimmed)), t AS (SELECT item_name, count(*) AS c FROM o GROUP BY 1 ORDER BY c DESC, item_name LIMIT 3)
SELECT count(*) AS n, min(age) AS lo, max(age) AS hi, (SELECT age FROM o GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_frequent, coalesce((SELECT string_agg(item_name || ':' || c::VARCHAR, ', ' ORDER BY c DESC, item_name) FROM t), '') AS top_items FROM o""")
def a9_outlier_items(spark, d):
    b = base(spark, d).filter("label = 'Y'")
    return fe.outlier_statistics(b.join(F.broadcast(fe.quartile_bounds(b, "age"))).filter("age < low OR age > high"), "age", "item_name")


@query(f"WITH {BASE} SELECT asset_id, count(*) OVER (PARTITION BY batch_id) AS batch_size, round_even(round(avg(age) OVER (PARTITION BY batch_id), 9) * 100, 0) / 100 AS batch_age FROM base")
def a3_batch_features(spark, d):
    df = base(spark, d)
    per = df.groupBy("batch_id").agg(F.count("*").alias("batch_size"), fe.rounded(F.round(F.avg("age"), 9), 2).alias("batch_age"))
    return df.select("asset_id", "batch_id").join(per, "batch_id").select("asset_id", "batch_size", "batch_age")


@query(f"WITH {ASSETS} SELECT a.asset_id, n AS batch_size FROM asset a JOIN (SELECT batch_id, count(*) AS n FROM asset GROUP BY 1) USING (batch_id)")
def j5_batch_join(spark, d):
    return fe.batch_features(assets(spark, d).select("asset_id", "batch_id", F.lit(1.0).alias("age")), age="age").select("asset_id", "batch_size")


FOUND = f"""found AS (
  SELECT asset_id, count(*) AS n_events, sum((event_type IN ('R', 'A'))::INT)::BIGINT AS n_repairs, sum((event_date >= ref_date - 365)::INT)::BIGINT AS n_1y, sum((event_date >= ref_date - 730)::INT)::BIGINT AS n_2y,
    sum(cost) AS cost_sum, max(severity) AS max_severity, sum((result = 'F')::INT)::BIGINT AS n_replace, max(event_date) AS last_event
  FROM maintenance JOIN base USING (asset_id) WHERE event_date <= ref_date GROUP BY asset_id)"""


def found_maintenance(spark: SparkSession, d: str, b: DataFrame) -> DataFrame:
    return fe.maintenance_features(maintenance(spark, d), b, F.col("event_type").isin("R", "A"), F.col("result") == "F")


@query(f"WITH {BASE}, {MAINTENANCE}, {FOUND} SELECT * REPLACE (round(cost_sum, 2) AS cost_sum, max_severity::BIGINT AS max_severity) FROM found")
def a4_maintenance_features(spark, d):
    out = found_maintenance(spark, d, base(spark, d))
    return out.withColumns({"cost_sum": F.round("cost_sum", 2), "max_severity": F.col("max_severity").cast("long")})


@query(f"WITH {BASE}, {MAINTENANCE} SELECT asset_id, event_date, cost FROM maintenance JOIN base USING (asset_id) WHERE event_date <= ref_date")
def j6_events_before_reference(spark, d):
    b = base(spark, d).select("asset_id", "ref_date")
    return maintenance(spark, d).join(b, "asset_id").filter("event_date <= ref_date").select("asset_id", "event_date", "cost")


MAINTAINED = f"""maintained AS (
  SELECT b.*, coalesce(n_events, 0) AS n_events, coalesce(n_repairs, 0) AS n_repairs, coalesce(n_1y, 0) AS n_1y, coalesce(n_2y, 0) AS n_2y, coalesce(cost_sum, 0) AS cost_sum, coalesce(max_severity, 0)::BIGINT AS max_severity, coalesce(n_replace, 0) AS n_replace,
    round_even(CASE WHEN n_events > 0 THEN greatest((ref_date - last_event) / 30.4375::DOUBLE, 0.0::DOUBLE) ELSE age * 12 END * 10, 0) / 10 AS months_since,
    round_even(coalesce(least(greatest(cost_sum / nullif(acq_amount, 0), 0.0::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE) * 1000, 0) / 1000 AS cost_share FROM base b LEFT JOIN found USING (asset_id))"""


@query(f"WITH {BASE}, {MAINTENANCE}, {FOUND}, {MAINTAINED} SELECT asset_id, n_events, n_repairs, n_1y, n_2y, max_severity, n_replace, months_since, cost_share FROM maintained")
def a5_maintenance_defaults(spark, d):
    b = base(spark, d)
    out = fe.with_maintenance(b, found_maintenance(spark, d, b))
    return out.select("asset_id", "n_events", "n_repairs", "n_1y", "n_2y", F.col("max_severity").cast("long").alias("max_severity"), "n_replace", "months_since", "cost_share")


def split_sql(source: str, item: str) -> str:
    return f"""ranked AS (SELECT *, count(*) OVER (PARTITION BY {item}) AS n, row_number() OVER (PARTITION BY {item} ORDER BY ref_date NULLS LAST, asset_id) AS k FROM {source} WHERE label = 'Y' AND {item} IS NOT NULL),
sized AS (SELECT *, CASE WHEN n >= 10 THEN floor(n * 0.70::DOUBLE) WHEN n >= 5 THEN CASE WHEN greatest(floor(n * 0.70::DOUBLE), 2) + 1 >= n THEN n - 2 ELSE greatest(floor(n * 0.70::DOUBLE), 2) END WHEN n >= 3 THEN n - 2 ELSE n END AS t,
  CASE WHEN n >= 10 THEN greatest(floor(n * 0.20::DOUBLE), 1) WHEN n >= 3 THEN 1 ELSE 0 END AS v FROM ranked),
split AS (SELECT * EXCLUDE (n, k, t, v), CASE WHEN k <= t THEN 'Train' WHEN k <= t + v THEN 'Valid' ELSE 'Test' END AS split FROM sized
  UNION ALL SELECT *, 'Prediction' FROM {source} WHERE label <> 'Y' OR {item} IS NULL)"""


SMALL_ITEMS = "small AS (SELECT * EXCLUDE item_name, CASE WHEN asset_id % 50 <> 0 THEN dept_code || item_name END AS item_name FROM base)"


def small_items(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).withColumn("item_name", F.when(F.col("asset_id") % 50 != 0, F.concat("dept_code", "item_name")))


@query(f"WITH {BASE}, {SMALL_ITEMS}, {split_sql('small', 'item_name')} SELECT asset_id, split FROM split")
def w6_time_split(spark, d):
    return fe.time_split(small_items(spark, d), "item_name", "ref_date", "asset_id").select("asset_id", "split")


@query(f"WITH {BASE}, {split_sql('base', 'item_name')} SELECT asset_id, split FROM split")
def w6_time_split_large(spark, d):
    return fe.time_split_large(base(spark, d), "item_name", "ref_date", "asset_id").select("asset_id", "split")


@query(f"""WITH {BASE}, {split_sql('base', 'item_name')}, g AS (SELECT coalesce(avg(age) FILTER (split = 'Train'), avg(age) FILTER (label = 'Y'), 5.0) AS g FROM split),
c AS (SELECT dept_code, avg(age) AS m, count(age) AS n FROM split WHERE split = 'Train' GROUP BY 1)
SELECT asset_id, round(coalesce((m * n + g * 10) / (n + 10), g), 6) AS dept_code_te FROM split LEFT JOIN c USING (dept_code), g""")
def a10_target_encoding(spark, d):
    df = fe.time_split_large(base(spark, d), "item_name", "ref_date", "asset_id")
    return fe.target_encodings(df, ["dept_code"], "age").select("asset_id", F.round("dept_code_te", 6).alias("dept_code_te"))


@query(f"WITH {BASE}, {split_sql('base', 'item_name')} SELECT split, label, count(*) AS n, round(avg(age), 6) AS mean_age FROM split GROUP BY ALL")
def p10_split_rows(spark, d):
    df = fe.time_split_large(base(spark, d), "item_name", "ref_date", "asset_id")
    return df.groupBy("split", "label").agg(F.count("*").alias("n"), F.round(F.avg("age"), 6).alias("mean_age"))


@query(f"""WITH {BASE}, x AS (SELECT asset_id, label, CASE WHEN asset_id % 6 <> 0 THEN age END AS age, CASE WHEN asset_id % 4 <> 0 THEN acq_amount END AS price FROM base)
SELECT asset_id, coalesce(age, (SELECT median(age) FROM x WHERE label = 'Y'), 0) AS age, coalesce(price, (SELECT median(price) FROM x WHERE label = 'Y'), 0) AS price FROM x""")
def p11_median_imputation(spark, d):
    df = base(spark, d).select("asset_id", "label", F.when(F.col("asset_id") % 6 != 0, F.col("age")).alias("age"), F.when(F.col("asset_id") % 4 != 0, F.col("acq_amount")).alias("price"))
    return fe.impute_medians(df, ["age", "price"], F.col("label") == "Y").drop("label")


@query(f"""WITH {BASE}, x AS (SELECT CASE WHEN asset_id % 6 <> 0 THEN age END AS age, life_years FROM base)
SELECT coalesce(age, (SELECT median(age) FROM x)) AS age, 0.0::DOUBLE AS hours, life_years::DOUBLE AS life_years FROM x""")
def p12_model_input(spark, d):
    df = base(spark, d).select(F.when(F.col("asset_id") % 6 != 0, F.col("age")).alias("age"), "life_years")
    return fe.model_input(df, ["age", "hours", "life_years"])


@query(f"WITH {BASE} SELECT asset_id, age * 12 AS age_months, life_years::DOUBLE * 12 AS life_months FROM base")
def p13_months(spark, d):
    return base(spark, d).select("asset_id", fe.in_months(F.col("age")).alias("age_months"), fe.in_months(F.col("life_years")).alias("life_months"))


LEAKS = ("ref_date", "disuse_date", "disuse_confirm", "disposal_confirm", "method", "reason", "label", "age")


@query(f"WITH {BASE} SELECT asset_id, acq_amount, life_years::BIGINT AS life_years, dept_code, item_name FROM base")
def p9_guarded_features(spark, d):
    """The declared features of every asset, once it is sure that none of them gives the outcome away."""
    df = base(spark, d).withColumn("life_years", F.col("life_years").cast("long"))
    return df.select("asset_id", *fe.guard_leaks(df.columns, ["acq_amount", "life_years", "dept_code", "item_name"], LEAKS))


TE = ("dept_code", "item_name", "class_name", "campus")


@query(f"""WITH {TRIMMED}, {MAINTENANCE}, {FOUND}, full_ AS (
  SELECT b.*, count(*) OVER (PARTITION BY batch_id) AS batch_size, coalesce(n_events, 0) AS n_events, coalesce(n_repairs, 0) AS n_repairs, coalesce(n_1y, 0) AS n_1y,
    round_even(CASE WHEN n_events > 0 THEN greatest((ref_date - last_event) / 30.4375::DOUBLE, 0.0::DOUBLE) ELSE age * 12 END * 10, 0) / 10 AS months_since,
    round_even((life_years - age) * 100, 0) / 100 AS life_left, month(acq_date) AS acq_month FROM trimmed b LEFT JOIN found USING (asset_id)),
{split_sql('full_', 'item_name')}, g AS (SELECT coalesce(avg(age) FILTER (split = 'Train'), avg(age) FILTER (label = 'Y'), 5.0) AS g FROM split),
{', '.join(f"te_{c} AS (SELECT {c}, avg(age) AS m_{c}, count(age) AS n_{c} FROM split WHERE split = 'Train' GROUP BY 1)" for c in TE)}
SELECT asset_id, label, split, age, ref_date, batch_size, n_events, n_repairs, n_1y, months_since, life_left, acq_month::BIGINT AS acq_month,
  {', '.join(f"round(coalesce((m_{c} * n_{c} + g * 10) / (n_{c} + 10), g), 6) AS {c}_te" for c in TE)}
FROM split {' '.join(f"LEFT JOIN te_{c} USING ({c})" for c in TE)}, g""")
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: one row per asset with features, label, split and encodings."""
    df = fe.drop_outliers(staged(base(spark, d), "assets"), "age")
    per = fe.batch_features(df)
    out = fe.with_maintenance(per, found_maintenance(spark, d, df)).withColumns({"life_left": fe.wear_features(F.col("life_years"), F.col("age"), F.lit(1.0))["life_left"], "acq_month": F.month("acq_date").cast("long")})
    out = staged(fe.time_split_large(out, "item_name", "ref_date", "asset_id"), "features")
    out = fe.target_encodings(out, TE, "age")
    return out.select("asset_id", "label", "split", "age", "ref_date", "batch_size", "n_events", "n_repairs", "n_1y", "months_since", "life_left", "acq_month", *[F.round(f"{c}_te", 6).alias(f"{c}_te") for c in TE])

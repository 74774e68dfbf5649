"""Queries of the lifecycle operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import lifecycle as lc
from ..sources.tables import conform, diagnostics
from .bindings import ASSETS, BATCHES, HISTORY, MAINTENANCE, OUTCOMES, TIES, assets, batches, history, latest_outcome, maintenance, outcomes, query, read

BATCH_ORDER = ["g2b_no", "item_name", "acq_amount", "acq_date", "qty", "l_orderkey", "l_linenumber", "l_suppkey", "l_discount", "l_tax", "l_returnflag"]


@query(f"WITH {BATCHES} SELECT g2b_no, acq_date, acq_amount, qty::BIGINT AS qty, l_orderkey FROM batch WHERE approval = 'F'")
def p1_confirmed(spark, d):
    return lc.confirmed(batches(spark, d), value="F").select("g2b_no", "acq_date", "acq_amount", F.col("qty").cast("long").alias("qty"), "l_orderkey")


@query(f"""WITH {BATCHES} SELECT g2b_no, acq_date, acq_amount_unit AS acq_amount, count(*) AS n, min(unit_no)::BIGINT AS lo, max(unit_no)::BIGINT AS hi FROM (
  SELECT g2b_no, acq_date, trunc(acq_amount / qty)::BIGINT AS acq_amount_unit, unnest(range(1, qty + 1)) AS unit_no FROM batch WHERE qty > 0 AND approval = 'F') GROUP BY ALL""")
def p2_explode_batches(spark, d):
    return lc.explode_batches(lc.confirmed(batches(spark, d), value="F")).groupBy("g2b_no", "acq_date", "acq_amount").agg(F.count("*").alias("n"), F.min("unit_no").cast("long").alias("lo"), F.max("unit_no").cast("long").alias("hi"))


@query("SELECT c_custkey, coalesce(TRY_CAST(CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE c_acctbal::VARCHAR END AS DOUBLE), 1.0) AS replace_tend, 1.5::DOUBLE AS manage_tend FROM customer")
def p3_defaults(spark, d):
    df = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(F.col("c_acctbal").cast("string")).alias("replace_tend"))
    return lc.fill_defaults(df, {"replace_tend": 1.0, "manage_tend": 1.5})


@query(f"""WITH {ASSETS} SELECT asset_id, CASE WHEN batch_id % 4 = 0 THEN 'B' || year(acq_date)::VARCHAR || right(asset_id::VARCHAR, 5) ELSE batch_id::VARCHAR END AS by_year,
  CASE WHEN batch_id % 4 = 0 THEN 'B' || asset_id::VARCHAR ELSE batch_id::VARCHAR END AS batch_id FROM asset""")
def p4_batch_ids(spark, d):
    df = assets(spark, d).select("asset_id", F.year("acq_date").alias("y"), F.when(F.col("batch_id") % 8 == 0, " ").when(F.col("batch_id") % 4 != 0, F.col("batch_id").cast("string")).alias("batch_id"))
    df = lc.batch_ids(df.withColumn("by_year", F.col("batch_id")), "by_year", year="y")
    return lc.batch_ids(df, "batch_id").select("asset_id", "by_year", "batch_id")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN '' ELSE p_brand END AS p_brand, p_type FROM part")
def p5_blank_nulls(spark, d):
    return lc.blank_nulls(read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") <= 25, F.col("p_brand")).alias("p_brand"), "p_type"), ["p_brand", "p_type"])


@query("SELECT o_orderkey, o_orderdate::DATE AS acq_date FROM orders WHERE o_orderkey % 5 <> 0")
def p6_readable_dates(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("acq_date"))
    return lc.with_dates(df, "acq_date")


@query(f"""WITH {BATCHES} SELECT l_orderkey, l_linenumber, g2b_no, qty::BIGINT AS qty,
  (floor(floor(acq_amount / pow(1.015::DOUBLE, (2026 - year(acq_date)) / 3.0::DOUBLE) * CASE WHEN qty >= 10 THEN 0.95 ELSE 1.0 END::DOUBLE) / 1000) * 1000 * qty)::BIGINT AS amount FROM batch""")
def p16_historical_price(spark, d):
    return batches(spark, d).select("l_orderkey", "l_linenumber", "g2b_no", F.col("qty").cast("long").alias("qty"), lc.historical_price(F.col("acq_amount"), F.col("qty"), F.year("acq_date"), 2026).alias("amount"))


@query(f"""WITH {ASSETS}, policy AS (SELECT n_name AS dept_code, (n_nationkey % 3)::DOUBLE AS replace_tend FROM nation WHERE n_nationkey % 2 = 0)
SELECT asset_id, dept_code, coalesce(replace_tend, 1.0) AS replace_tend, CASE WHEN contains(dept_code, '1') THEN 'east' ELSE 'west' END AS campus, (life_years >= 6)::INT AS is_bulk
FROM asset LEFT JOIN policy USING (dept_code)""")
def p17_dept_policy(spark, d):
    policy = read(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("dept_code"), (F.col("n_nationkey") % 3).cast("double").alias("replace_tend"))
    df = assets(spark, d).select("asset_id", "dept_code", "life_years")
    return lc.dept_policy(df, policy, "dept_code", {"replace_tend": 1.0}, "1", "east", "west", qty="life_years", bulk=6).select("asset_id", "dept_code", "replace_tend", "campus", "is_bulk")


@query(f"WITH {BATCHES} SELECT CASE WHEN approval = 'O' AND acq_date < DATE '1998-01-01' THEN 'F' ELSE approval END AS approval, count(*) AS n FROM batch GROUP BY 1")
def p18_settle_pending(spark, d):
    return lc.settle_pending(batches(spark, d), "1998-01-01", pending="O", done="F").groupBy("approval").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, NULL::DOUBLE AS rul, NULL::DATE AS failure_date FROM supplier")
def p19_placeholders(spark, d):
    return lc.placeholders(read(spark, d, "supplier").select("s_suppkey"), {"rul": "double", "failure_date": "date"})


@query("SELECT n_nationkey, n_name, NULL::VARCHAR AS remark, NULL::DOUBLE AS cost FROM nation")
def s4_conform(spark, d):
    return conform(read(spark, d, "nation"), {"n_nationkey": "int", "n_name": "string", "remark": "string", "cost": "double"})[0]


@query("""SELECT conv_id, string_agg(role, '|' ORDER BY turn) AS roles, left(arg_min(text, turn), 300) AS answer FROM conversations GROUP BY conv_id""")
def s8_diagnostics(spark, d):
    df = read(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"), F.min_by("text", "turn").alias("answer"))
    return diagnostics(df, ["roles"], "answer")


@query(f"""WITH {HISTORY} SELECT asset_id, changed_at AS valid_from, coalesce(lead(changed_at) OVER w - INTERVAL 1 DAY, TIMESTAMP '2099-12-31') AS valid_to, new_status
FROM history WINDOW w AS (PARTITION BY asset_id ORDER BY changed_at)""")
def w1_validity(spark, d):
    return lc.validity(history(spark, d)).select("asset_id", "valid_from", "valid_to", "new_status")


@query(f"""WITH {HISTORY} SELECT asset_id, changed_at AS start_date, coalesce(lead(changed_at) OVER w - INTERVAL 1 DAY, TIMESTAMP '2099-12-31') AS end_date,
  lead(changed_at) OVER w IS NULL AS is_current, new_status AS status, manager FROM history WINDOW w AS (PARTITION BY asset_id ORDER BY changed_at)""")
def w2_scd_rows(spark, d):
    return lc.validity(history(spark, d)).select("asset_id", F.col("valid_from").alias("start_date"), F.col("valid_to").alias("end_date"), "is_current", F.col("new_status").alias("status"), "manager")


@query(f"WITH {OUTCOMES} SELECT asset_id, event_date, confirm_date, approval, l_linenumber FROM disuse_last")
def w3_latest_per_asset(spark, d):
    return latest_outcome(spark, d, "R").select("asset_id", "event_date", "confirm_date", "approval", "l_linenumber")


@query(f"""WITH {OUTCOMES} SELECT asset_id, event_date, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY event_date DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM transfer) WHERE n = 1""")
def w4_keep_last(spark, d):
    return lc.latest(outcomes(spark, d, "N"), "asset_id", F.desc("event_date"), *TIES).select("asset_id", "event_date", "l_suppkey")


@query(f"""WITH {BATCHES}, n AS (SELECT *, row_number() OVER (PARTITION BY year(acq_date) ORDER BY {', '.join(BATCH_ORDER)}) AS n FROM batch WHERE approval = 'F')
SELECT 'M' || year(acq_date)::VARCHAR || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 5, '0') ELSE n::VARCHAR END AS asset_id, g2b_no, l_orderkey, l_linenumber FROM n""")
def w5_asset_ids(spark, d):
    df = lc.number_large_years(lc.confirmed(batches(spark, d), value="F"), "acq_date", *[F.col(c) for c in BATCH_ORDER])
    return df.select("asset_id", "g2b_no", "l_orderkey", "l_linenumber")


@query(f"""WITH {BATCHES}, c AS (SELECT year(acq_date) AS y, count(*) AS n FROM batch WHERE approval = 'F' GROUP BY 1)
SELECT 'M' || y::VARCHAR || CASE WHEN k < 10000 THEN lpad(k::VARCHAR, 5, '0') ELSE k::VARCHAR END AS asset_id FROM (SELECT y, unnest(range(1, n + 1)) AS k FROM c)""")
def w5_ids_of_large_years(spark, d):
    df = lc.confirmed(batches(spark, d), value="F")
    return lc.number_large_years(df, "acq_date", F.concat_ws("|", *[F.col(c).cast("string") for c in BATCH_ORDER])).select("asset_id")


@query(f"WITH {ASSETS}, {OUTCOMES} SELECT t.asset_id, t.event_date, t.reason::BIGINT AS reason, t.l_linenumber, a.item_name, a.acq_date, a.dept_code FROM disuse t LEFT JOIN asset a USING (asset_id)")
def j1_disuse_with_master(spark, d):
    master = assets(spark, d).select("asset_id", "item_name", "acq_date", "dept_code")
    return lc.add_missing(outcomes(spark, d, "R"), master, "asset_id").select("asset_id", "event_date", "reason", "l_linenumber", "item_name", "acq_date", "dept_code")


@query(f"""WITH {HISTORY} SELECT h.asset_id, h.event_id, h.new_status, c.c_name AS item_name, c.c_mktsegment AS class_name FROM history h LEFT JOIN customer c ON h.asset_id = c.c_custkey""")
def j2_history_with_attributes(spark, d):
    master = read(spark, d, "customer").select(F.col("c_custkey").alias("asset_id"), F.col("c_name").alias("item_name"), F.col("c_mktsegment").alias("class_name"))
    return lc.add_missing(history(spark, d).select("asset_id", "event_id", "new_status"), master, "asset_id")


@query(f"""WITH {ASSETS}, {OUTCOMES}, last AS (SELECT asset_id, 'T' || l_suppkey::VARCHAR AS dept FROM (
    SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY event_date DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM transfer) WHERE n = 1)
SELECT a.asset_id, coalesce(CASE WHEN a.batch_id % 3 <> 0 THEN dept_code END, l.dept, '') AS dept FROM asset a LEFT JOIN last l USING (asset_id)""")
def j3_restore_dept(spark, d):
    df = assets(spark, d).select("asset_id", F.when(F.col("batch_id") % 3 == 0, F.when(F.col("batch_id") % 2 == 0, "  ")).otherwise(F.col("dept_code")).alias("dept"))
    last = lc.latest(outcomes(spark, d, "N"), "asset_id", F.desc("event_date"), *TIES).select("asset_id", F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("dept"))
    return lc.restore_dept(df, last)


@query(f"WITH {ASSETS}, {OUTCOMES} SELECT asset_id, status FROM asset WHERE asset_id IN (SELECT asset_id FROM disposal WHERE approval = 'F')")
def j7_disposed_assets(spark, d):
    from ..operators.knowledge import holders_of
    return holders_of(assets(spark, d).select("asset_id", "status"), lc.confirmed(outcomes(spark, d, "A"), value="F"), "asset_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def j8_skip_done(spark, d):
    from ..operators.knowledge import skip_done
    return skip_done(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels"), "doc_id")


@query(f"""WITH {ASSETS}, {OUTCOMES}, g AS (SELECT asset_id, max(coalesce(confirm_date, event_date)) AS x FROM disposal GROUP BY 1), u AS (SELECT asset_id, max(coalesce(confirm_date, event_date)) AS x FROM disuse GROUP BY 1)
SELECT a.asset_id, coalesce(g.x, u.x, DATE '2001-12-31') AS end_date FROM asset a LEFT JOIN g USING (asset_id) LEFT JOIN u USING (asset_id)""")
def j9_end_dates(spark, d):
    return lc.end_dates(assets(spark, d).select("asset_id"), outcomes(spark, d, "A"), outcomes(spark, d, "R"), "2001-12-31")


@query(f"""WITH {ASSETS}, o AS (SELECT dept_code, item_name, status, class_name, campus, count(*) AS n, min(asset_id) AS remark FROM asset WHERE asset_id % 2 = 0 GROUP BY ALL)
SELECT a.asset_id, o.remark FROM asset a LEFT JOIN o ON a.dept_code = o.dept_code AND a.item_name = o.item_name AND a.status = o.status AND a.class_name = o.class_name AND a.campus = o.campus""")
def j10_restore_remark(spark, d):
    keys = ["dept_code", "item_name", "status", "class_name", "campus"]
    df = assets(spark, d)
    origin = df.filter("asset_id % 2 = 0").groupBy(*keys).agg(F.min("asset_id").alias("remark"))
    return lc.restore_columns(df.select("asset_id", *keys), origin, keys).select("asset_id", "remark")


RULES = [("a", 3.0, 0.5), ("al", 4.0, 0.6), ("green", 6.0, 0.7), ("e", 5.0, 0.4), ("or", 7.0, 0.3)]


@query("""WITH rules(keyword, mu, sigma) AS (VALUES ('a', 3.0::DOUBLE, 0.5::DOUBLE), ('al', 4.0, 0.6), ('green', 6.0, 0.7), ('e', 5.0, 0.4), ('or', 7.0, 0.3)),
best AS (SELECT p_name, arg_max(mu, (length(keyword), keyword)) AS mu, arg_max(sigma, (length(keyword), keyword)) AS sigma FROM (SELECT DISTINCT p_name FROM part) p JOIN rules ON contains(p_name, keyword) GROUP BY p_name)
SELECT p_partkey, coalesce(mu, 5.5) AS mu, coalesce(sigma, 1.0) AS sigma FROM part LEFT JOIN best USING (p_name)""")
def j17_longest_keyword(spark, d):
    rules = spark.createDataFrame(RULES, "keyword string, mu double, sigma double")
    return lc.longest_match(read(spark, d, "part").select("p_partkey", "p_name"), rules, "p_name", {"mu": 5.5, "sigma": 1.0}).select("p_partkey", "mu", "sigma")


DAYS = ["2024-01-05", "2024-01-15", "2024-01-25", "2024-02-01"]


@query(f"""WITH {HISTORY}, v AS (SELECT *, changed_at AS valid_from, coalesce(lead(changed_at) OVER (PARTITION BY asset_id ORDER BY changed_at) - INTERVAL 1 DAY, TIMESTAMP '2099-12-31') AS valid_to FROM history),
days AS (SELECT unnest([{', '.join(f"TIMESTAMP '{x}'" for x in DAYS)}]) AS day)
SELECT day::DATE AS day, new_status, count(*) AS qty FROM v JOIN days ON valid_from <= day AND valid_to >= day GROUP BY ALL""")
def j18_held_on_days(spark, d):
    days = spark.createDataFrame([(x,) for x in DAYS], "day string").select(F.to_timestamp("day").alias("day"))
    return lc.held_on(lc.validity(history(spark, d)), days).groupBy(F.to_date("day").alias("day"), "new_status").agg(F.count("*").alias("qty"))


EVERY_DAY = """days AS (SELECT unnest(generate_series((SELECT min(changed_at)::DATE FROM history), (SELECT max(changed_at)::DATE + 30 FROM history), INTERVAL 1 DAY)) AS day)"""


@query(f"""WITH {HISTORY}, v AS (SELECT *, changed_at AS valid_from, coalesce(lead(changed_at) OVER (PARTITION BY asset_id ORDER BY changed_at) - INTERVAL 1 DAY, TIMESTAMP '2099-12-31') AS valid_to FROM history),
{EVERY_DAY}
SELECT day::DATE AS day, new_status, count(*) AS qty FROM v JOIN days ON valid_from <= day AND valid_to >= day GROUP BY ALL""")
def j18_held_every_day(spark, d):
    """Every day of the calendar and all assets, by sums of changes."""
    own = history(spark, d)
    limits = own.agg(F.to_date(F.min("changed_at")).alias("a"), F.date_add(F.to_date(F.max("changed_at")), 30).alias("b"))
    days = limits.select(F.explode(F.sequence("a", "b")).alias("day"))
    return lc.held_counts(lc.validity(own), days, ["new_status"]).select("day", "new_status", "qty")


@query(f"""WITH {ASSETS}, {OUTCOMES}, c AS (SELECT a.*, p.event_date AS clear_date FROM asset a LEFT JOIN disposal_last p USING (asset_id))
SELECT dept_code, count(*) AS qty FROM c WHERE acq_date <= DATE '1998-06-30' AND (clear_date >= DATE '1998-06-30' OR clear_date IS NULL AND status <> 'F') GROUP BY 1""")
def j18_stock_on_day(spark, d):
    gone = latest_outcome(spark, d, "A").select("asset_id", F.col("event_date").alias("clear_date"))
    return lc.in_stock(assets(spark, d).join(gone, "asset_id", "left"), F.lit("1998-06-30").cast("date"), gone="F").groupBy("dept_code").agg(F.count("*").alias("qty"))


@query(f"""WITH {ASSETS}, {OUTCOMES} SELECT campus, dept_code, item_name, class_name, status, method::BIGINT AS method, count(*) AS qty FROM asset LEFT JOIN disposal_last USING (asset_id) WHERE method IS NOT NULL GROUP BY ALL""")
def a1_quantity_view(spark, d):
    df = assets(spark, d).join(latest_outcome(spark, d, "A").select("asset_id", "method"), "asset_id", "left")
    return lc.quantity_view(df, ["campus", "dept_code", "item_name", "class_name", "status", "method"])


@query(f"""WITH {HISTORY}, v AS (SELECT asset_id, new_status, manager, changed_at::DATE AS valid_from, coalesce(lead(changed_at) OVER (PARTITION BY asset_id ORDER BY changed_at) - INTERVAL 1 DAY, TIMESTAMP '2099-12-31')::DATE AS valid_to FROM history)
SELECT coalesce(c_mktsegment, '') AS class_name, new_status, coalesce(manager, '') AS manager, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to, count(*) AS qty
FROM v LEFT JOIN customer ON asset_id = c_custkey GROUP BY ALL""")
def a2_scd_quantity_view(spark, d):
    master = read(spark, d, "customer").select(F.col("c_custkey").alias("asset_id"), F.col("c_mktsegment").alias("class_name"))
    df = lc.add_missing(lc.validity(history(spark, d)), master, "asset_id").withColumns({c: F.to_date(c) for c in ("valid_from", "valid_to")})
    return lc.quantity_view(df, ["class_name", "new_status", "manager", "valid_from", "valid_to"], keep_nulls=True)


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10")
def a11_value_counts(spark, d):
    return lc.value_counts(read(spark, d, "part"), "p_brand", 10)


@query(f"""WITH {ASSETS}, {OUTCOMES}, {HISTORY}, j AS (SELECT u.event_date, a.acq_date FROM disuse u LEFT JOIN asset a USING (asset_id)),
k AS (SELECT status FROM asset WHERE asset_id IN (SELECT asset_id FROM disposal WHERE approval = 'F')),
c AS (SELECT abs((SELECT count(DISTINCT asset_id) FROM history) - (SELECT count(*) FROM (SELECT lead(changed_at) OVER (PARTITION BY asset_id ORDER BY changed_at) AS x FROM history) WHERE x IS NULL)) AS d)
SELECT 'disuse before acquisition' AS check_name, CASE WHEN sum((event_date < acq_date)::INT) = 0 THEN 'ok' ELSE 'bad' END AS status, coalesce(sum((event_date < acq_date)::INT), 0)::BIGINT AS n_bad, sum((event_date IS NULL OR acq_date IS NULL)::INT)::BIGINT AS n_skipped FROM j
UNION ALL SELECT 'disposed but not F', CASE WHEN sum((status <> 'F')::INT) = 0 THEN 'ok' ELSE 'bad' END, sum((status <> 'F')::INT)::BIGINT, sum((status IS NULL)::INT)::BIGINT FROM k
UNION ALL SELECT 'pending disposals', CASE WHEN sum((approval <> 'F')::INT) = 0 THEN 'ok' ELSE 'bad' END, sum((approval <> 'F')::INT)::BIGINT, sum((approval IS NULL)::INT)::BIGINT FROM disposal
UNION ALL SELECT 'current quantity', CASE WHEN d = 0 THEN 'ok' ELSE 'bad' END, d::BIGINT, 0::BIGINT FROM c""")
def a29_checks(spark, d):
    from ..operators.knowledge import holders_of
    own = assets(spark, d)
    early = lc.add_missing(outcomes(spark, d, "R"), own.select("asset_id", "acq_date"), "asset_id")
    gone = holders_of(own.select("asset_id", "status"), lc.confirmed(outcomes(spark, d, "A"), value="F"), "asset_id")
    counts = lc.validity(history(spark, d)).agg(F.abs(F.countDistinct("asset_id") - F.count_if("is_current")).alias("n_bad"))
    return (lc.check_row(early, "disuse before acquisition", F.col("event_date") < F.col("acq_date"), F.col("event_date").isNull() | F.col("acq_date").isNull())
            .unionByName(lc.check_row(gone, "disposed but not F", F.col("status") != "F", F.col("status").isNull()))
            .unionByName(lc.check_row(outcomes(spark, d, "A"), "pending disposals", F.col("approval") != "F", F.col("approval").isNull()))
            .unionByName(counts.select(F.lit("current quantity").alias("check_name"), F.when(F.col("n_bad") == 0, "ok").otherwise("bad").alias("status"), "n_bad", F.lit(0).cast("long").alias("n_skipped"))))


@query("SELECT DISTINCT p_type, p_brand FROM part")
def u2_distinct_lists(spark, d):
    from ..operators.knowledge import distinct_lists
    return distinct_lists(read(spark, d, "part"), ["p_type", "p_brand"])


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN strftime(date_trunc('day', ts), '%Y-%m-%d 00:00:00') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS changed_at FROM events")
def f5_normal_timestamp(spark, d):
    own = F.when(F.col("event_id") % 4 == 0, "soon").when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return read(spark, d, "events").select("event_id", lc.normal_timestamp(own).alias("changed_at"))


@query(f"""WITH {ASSETS}, w(m, a, b) AS (VALUES (2, 1, 25), (8, 1, 25), (12, 1, 20)),
c AS (SELECT asset_id, greatest(make_date(year(acq_date) + y, m, a), acq_date) AS s, make_date(year(acq_date) + y, m, b) AS e, acq_date FROM asset, w, (VALUES (0), (1)) t(y)),
f AS (SELECT asset_id, min(s) AS s FROM c WHERE e >= acq_date AND s <= DATE '2001-12-31' AND s - acq_date <= 180 GROUP BY 1)
SELECT asset_id, CASE WHEN acq_date >= DATE '2001-12-31' THEN DATE '2001-12-31' ELSE coalesce(s, acq_date) END AS cycle_date FROM asset LEFT JOIN f USING (asset_id)""")
def f6_calendar_window(spark, d):
    return assets(spark, d).select("asset_id", lc.next_window(F.col("acq_date"), F.lit("2001-12-31").cast("date"), vocab.DISUSE_WINDOWS).alias("cycle_date"))


@query(f"""WITH {ASSETS} SELECT asset_id, trunc(greatest(life_years / CASE WHEN dept_code = 'NATION_01' THEN 1.3 WHEN class_name = 'BUILDING' THEN 1.2 ELSE 1.0 END::DOUBLE
  / least(greatest((batch_id % 7) / 5.0::DOUBLE, 0.9::DOUBLE), 1.25::DOUBLE)
  * CASE WHEN acq_amount * 100 >= CASE WHEN item_name LIKE '1%' THEN 1000000 ELSE 30000000 END THEN 1.15 WHEN acq_amount * 100 >= CASE WHEN item_name LIKE '1%' THEN 300000 ELSE 5000000 END THEN 1.05 ELSE 1.0 END::DOUBLE
  * least(greatest((batch_id % 3) / 2.0::DOUBLE, 0.9::DOUBLE), 1.1::DOUBLE)
  / least(greatest(1.0::DOUBLE + (least(greatest((batch_id % 5) / 4.0::DOUBLE, 0.9::DOUBLE), 1.15::DOUBLE) - 1.0::DOUBLE) * 0.5::DOUBLE, 0.95::DOUBLE), 1.08::DOUBLE), 1.0::DOUBLE) * 365)::BIGINT AS life_days FROM asset""")
def f16_adjusted_life(spark, d):
    hard = F.when(F.col("dept_code") == "NATION_01", 1.3).when(F.col("class_name") == "BUILDING", 1.2).otherwise(1.0)
    days = lc.adjusted_life_days(F.col("life_years"), hard, F.col("batch_id") % 7 / 5.0, F.col("acq_amount") * 100, F.col("item_name").like("1%"), F.col("batch_id") % 3 / 2.0, F.col("batch_id") % 5 / 4.0)
    return assets(spark, d).select("asset_id", days.cast("long").alias("life_days"))


@query(f"""WITH {ASSETS} SELECT asset_id, round_even(least(greatest(CASE WHEN regexp_matches(item_name, 'URGENT') THEN 1.18 WHEN regexp_matches(item_name, 'HIGH') AND regexp_matches(dept_code, '1|2') THEN 1.12 WHEN regexp_matches(item_name, 'HIGH') THEN 1.0 WHEN regexp_matches(item_name, 'LOW') THEN 0.95 ELSE 0.92 END::DOUBLE
  * CASE WHEN regexp_matches(dept_code, '1|2') THEN 1.15 WHEN regexp_matches(dept_code, '3') THEN 1.05 ELSE 1.0 END::DOUBLE * CASE class_name WHEN 'BUILDING' THEN 0.96 WHEN 'MACHINERY' THEN 1.04 ELSE 1.0 END::DOUBLE
  * CASE WHEN asset_id % 2 = 0 THEN 1.10 ELSE 1.0 END::DOUBLE * CASE WHEN asset_id % 3 = 0 THEN 1.08 ELSE 1.0 END::DOUBLE * least(greatest((60 + asset_id % 150) / 140.0::DOUBLE, 0.75::DOUBLE), 1.25::DOUBLE), 0.80::DOUBLE), 1.35::DOUBLE) * 1000, 0) / 1000 AS usage_intensity FROM asset""")
def f31_usage_intensity(spark, d):
    words = {"infra": "URGENT", "it": "HIGH", "furniture": "LOW", "lab": "1|2", "support": "3"}
    grade = F.when(F.col("class_name") == "BUILDING", "LOW").when(F.col("class_name") == "MACHINERY", "HIGH").otherwise("MEDIUM")
    return assets(spark, d).select("asset_id", lc.usage_intensity(F.col("item_name"), F.col("dept_code"), grade, 60 + F.col("asset_id") % 150, F.col("asset_id") % 2 == 0, F.col("asset_id") % 3 == 0, words).alias("usage_intensity"))

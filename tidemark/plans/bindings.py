"""The library's tables over the star schema that the queries run on, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import lifecycle as lc

AS_OF = "2001-12-31"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def assets(spark: SparkSession, d: str) -> DataFrame:
    """One asset per order. Customers and nations are dimension tables; their size decides how they are joined."""
    place = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("dept_code"), F.col("r_name").alias("campus"))
    who = read(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_mktsegment").alias("class_name"), "dept_code", "campus")
    return (read(spark, d, "orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("o_orderkey").alias("asset_id"), F.to_date("o_orderdate").alias("acq_date"), F.col("o_totalprice").alias("acq_amount"), F.col("o_orderpriority").alias("item_name"),
                    "class_name", "dept_code", "campus", F.col("o_custkey").alias("batch_id"), F.col("o_orderstatus").alias("status"), (F.lit(3) + F.col("o_custkey") % 8).cast("int").alias("life_years")))


ASSETS = """asset AS (
  SELECT o_orderkey AS asset_id, o_orderdate::DATE AS acq_date, o_totalprice AS acq_amount, o_orderpriority AS item_name, c_mktsegment AS class_name,
    n_name AS dept_code, r_name AS campus, o_custkey AS batch_id, o_orderstatus AS status, (3 + o_custkey % 8)::INT AS life_years
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def outcomes(spark: SparkSession, d: str, flag: str) -> DataFrame:
    """Disuse (flag R), disposal (A) or transfer (N) rows."""
    return read(spark, d, "lineitem").filter(F.col("l_returnflag") == flag).select(
        F.col("l_orderkey").alias("asset_id"), F.to_date("l_shipdate").alias("event_date"), F.when(F.col("l_linestatus") == "F", F.to_date("l_shipdate")).alias("confirm_date"),
        F.col("l_linestatus").alias("approval"), (F.col("l_suppkey") % 5).alias("reason"), (F.col("l_partkey") % 4).alias("method"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


TIES = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def latest_outcome(spark: SparkSession, d: str, flag: str) -> DataFrame:
    return lc.latest(outcomes(spark, d, flag), "asset_id", F.desc_nulls_last("confirm_date"), F.desc("event_date"), *TIES)


def outcomes_sql(name: str, flag: str) -> str:
    return f"""{name} AS (
  SELECT l_orderkey AS asset_id, l_shipdate::DATE AS event_date, CASE WHEN l_linestatus = 'F' THEN l_shipdate::DATE END AS confirm_date, l_linestatus AS approval,
    l_suppkey % 5 AS reason, l_partkey % 4 AS method, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_returnflag = '{flag}'),
{name}_last AS (
  SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY confirm_date DESC NULLS LAST, event_date DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM {name}) WHERE n = 1)"""


OUTCOMES = outcomes_sql("disuse", "R") + ",\n" + outcomes_sql("disposal", "A") + ",\n" + outcomes_sql("transfer", "N")


def maintenance(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.to_date("l_shipdate").alias("event_date"), F.col("l_extendedprice").alias("cost"),
                                             (F.col("l_linenumber") % 4).alias("severity"), F.col("l_returnflag").alias("event_type"), F.col("l_linestatus").alias("result"))


MAINTENANCE = """maintenance AS (
  SELECT l_orderkey AS asset_id, l_shipdate::DATE AS event_date, l_extendedprice AS cost, l_linenumber % 4 AS severity, l_returnflag AS event_type, l_linestatus AS result FROM lineitem)"""


def batches(spark: SparkSession, d: str) -> DataFrame:
    """One purchase batch per lineitem."""
    part = read(spark, d, "part").select("p_partkey", "p_brand", "p_name")
    return (read(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.concat("p_brand", F.col("p_partkey").cast("string")).alias("g2b_no"), F.col("p_name").alias("item_name"), F.to_date("l_shipdate").alias("acq_date"), F.col("l_extendedprice").alias("acq_amount"),
                    F.col("l_quantity").cast("int").alias("qty"), F.col("l_linestatus").alias("approval"), "l_orderkey", "l_linenumber", "l_suppkey", "l_discount", "l_tax", "l_returnflag"))


BATCHES = """batch AS (
  SELECT p_brand || p_partkey::VARCHAR AS g2b_no, p_name AS item_name, l_shipdate::DATE AS acq_date, l_extendedprice AS acq_amount, l_quantity::INT AS qty, l_linestatus AS approval,
    l_orderkey, l_linenumber, l_suppkey, l_discount, l_tax, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def history(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("user_id").alias("asset_id"), F.col("ts").alias("changed_at"), F.col("event_type").alias("new_status"), F.get_json_object("props", "$.k").alias("manager"), "event_id", "value")


HISTORY = """history AS (
  SELECT user_id AS asset_id, ts AS changed_at, event_type AS new_status, json_extract_string(props, '$.k') AS manager, event_id, value FROM events)"""


def base(spark: SparkSession, d: str) -> DataFrame:
    """Assets with outcomes, reference date, age and label."""
    out = latest_outcome(spark, d, "R").select("asset_id", F.col("event_date").alias("disuse_date"), F.col("confirm_date").alias("disuse_confirm"), F.col("approval").alias("disuse_approval"), "reason")
    gone = latest_outcome(spark, d, "A").select("asset_id", F.col("confirm_date").alias("disposal_confirm"), F.col("approval").alias("disposal_approval"), "method")
    df = fe.join_outcomes(assets(spark, d), out, gone)
    ref = fe.reference_date(F.col("disposal_confirm"), F.col("disuse_confirm"), F.col("disuse_date"), F.col("disuse_approval") == "F", F.lit(AS_OF).cast("date"))
    df = df.withColumn("ref_date", ref).withColumn("age", fe.age_years(F.col("ref_date"), F.col("acq_date")))
    sure = lambda x: (F.col(f"{x}_approval") == "F") | F.col(f"{x}_confirm").isNotNull()
    return df.withColumn("label", fe.end_of_life(sure("disposal"), sure("disuse"), F.col("method").isin(0, 1), F.col("method") == 2, F.col("reason").isin(0, 1, 2)))


BASE = ASSETS + ",\n" + OUTCOMES + f""",
joined AS (
  SELECT a.*, u.event_date AS disuse_date, u.confirm_date AS disuse_confirm, u.approval AS disuse_approval, u.reason,
    p.confirm_date AS disposal_confirm, p.approval AS disposal_approval, p.method,
    coalesce(p.confirm_date, u.confirm_date, CASE WHEN u.approval = 'F' THEN u.event_date END, DATE '{AS_OF}') AS ref_date
  FROM asset a LEFT JOIN disuse_last u USING (asset_id) LEFT JOIN disposal_last p USING (asset_id)),
base AS (
  SELECT *, round_even(greatest(ref_date - acq_date, 0) / 365.0::DOUBLE * 100, 0) / 100 AS age,
    CASE WHEN coalesce(reason IN (0, 1, 2), false) AND (
        (coalesce(disposal_approval = 'F', false) OR disposal_confirm IS NOT NULL) AND coalesce(method IN (0, 1), false)
        OR (coalesce(disuse_approval = 'F', false) OR disuse_confirm IS NOT NULL) AND coalesce(method = 2, false)) THEN 'Y' ELSE 'N' END AS label
  FROM joined)"""


def trimmed(spark: SparkSession, d: str) -> DataFrame:
    """Base without outliers."""
    return fe.drop_outliers(base(spark, d), "age")


TRIMMED = BASE + """,
bounds AS (SELECT quantile_cont(age, 0.25) AS q1, quantile_cont(age, 0.75) AS q3 FROM base WHERE label = 'Y'),
trimmed AS (SELECT base.* FROM base, bounds WHERE label = 'N' OR age BETWEEN q1 - 2 * (q3 - q1) AND q3 + 2 * (q3 - q1))"""


def series(spark: SparkSession, d: str) -> DataFrame:
    """Shipped items a month by nation of the customer."""
    own = assets(spark, d).select("asset_id", F.col("dept_code").alias("dept"))
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.to_date("l_shipdate").alias("day")).join(own, "asset_id")


SERIES = ASSETS + """,
moves AS (SELECT l_orderkey AS asset_id, l_shipdate::DATE AS day, dept_code AS dept FROM lineitem JOIN asset ON l_orderkey = asset_id),
months AS (SELECT dept, date_trunc('month', day)::DATE AS month, count(*) AS actual FROM moves GROUP BY ALL)"""

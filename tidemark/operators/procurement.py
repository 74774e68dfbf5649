"""From predicted life to failure dates, zones, stocks, reorder points and order plans."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab

#: Terms and the months that they plan for; lead days by grade; service factors by risk.
TERM_MONTHS = {"1학기": 3, "여름계절학기": 6, "2학기": 9, "겨울계절학기": 12}
LEAD_DAYS = {0: 7, 1: 20, 2: 38}
RISK_Z = {"LOW": 0.0, "MEDIUM": 1.28, "HIGH": 1.65}


def scope(df: DataFrame, dept: str, category: str | None = None, every: str = "전체", dept_column: str = "dept_code", category_column: str = "class_name") -> DataFrame:
    """One department, and one category unless that is empty or "all"."""
    out = df.filter(F.col(dept_column) == dept)
    return out.filter(F.col(category_column) == category) if category and category != every else out


def term_dates(year: Column, term: Column) -> tuple[Column, Column]:
    """first and last day of a term; the whole year for any other name."""
    def pick(spring: tuple, summer: tuple, autumn: tuple, winter: tuple, rest: tuple) -> Column:
        day = lambda d: F.make_date(year + d[0], F.lit(d[1]), F.lit(d[2]))
        return (F.when(term.isin("1", "1학기"), day(spring)).when(term.isin("여름", "여름방학", "summer"), day(summer))
                .when(term.isin("2", "2학기"), day(autumn)).when(term.isin("겨울", "겨울방학", "winter"), day(winter)).otherwise(day(rest)))
    return pick((0, 3, 2), (0, 6, 21), (0, 9, 1), (0, 12, 21), (0, 1, 1)), pick((0, 6, 20), (0, 8, 31), (0, 12, 20), (1, 2, 28), (0, 12, 31))


def months_of(start: Column, end: Column) -> Column:
    """F8: months of a period in order, across the end of a year."""
    return F.transform(F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("INTERVAL 1 MONTH")), F.month)


def within(df: DataFrame, day: str, start: Column, end: Column) -> DataFrame:
    """Failures between two days."""
    return df.filter(F.col(day).between(start, end))


def remaining_life(total_months: Column, age_years: Column, key: Column | None = None) -> Column:
    """months left, at least 0.5; with a key: overdue ones get 1 to 4 months by a hash of it, rounded to 0.1."""
    raw = total_months - age_years * 12
    if key is None:
        return F.greatest(raw, F.lit(0.5))
    return F.rint(F.when(raw <= 0.5, 1 + 3 * F.pmod(F.xxhash64(key), F.lit(10_000)) / 10_000.0).otherwise(raw) * 10) / 10


def failure_date(rul: Column, as_of: Column, mode: str = "server") -> Column:
    """the day on which remaining life ends; modes differ in days a month and in the least life."""
    if mode == "server":
        return F.date_add(as_of, F.floor(F.greatest(rul, F.lit(0.5)) * 30.4375).cast("int"))
    return F.date_add(as_of, F.floor(rul * 30.44).cast("int"))


def order_month(failure: Column, lead_months: Column) -> Column:
    """month in which to order."""
    return F.date_format(F.add_months(F.trunc(failure, "MM"), -lead_months), "yyyy-MM")


def order_deadline(as_of: Column, term_months: Column, lead_months: Column) -> Column:
    """last day to order."""
    return F.date_add(as_of, (F.greatest(term_months - lead_months, F.lit(0)) * 30).cast("int"))


def lead_days(grade: Column) -> Column:
    """days of delivery by grade, 7 for others."""
    return F.when(grade == 1, LEAD_DAYS[1]).when(grade == 2, LEAD_DAYS[2]).otherwise(LEAD_DAYS[0])


def safety_plan(failure: Column, z: Column, rmse: Column, grade: Column) -> dict[str, Column]:
    """buffer days, preparation days and order date; a date that can't be read gives an error text."""
    day, buffer = F.try_to_date(failure), F.ceil(z * rmse).cast("int")
    prepare = (lead_days(grade) + buffer).cast("int")
    return {"buffer_days": buffer, "prep_days": prepare, "order_date": F.date_sub(day, prepare), "error": F.when(day.isNull(), "bad failure date")}


def lead_time(price: Column, sensitivity: Column) -> dict[str, Column]:
    """grade, score, root of lead time and days by price tier; importance in percent."""
    tier = lambda a, b, c: F.when(price <= 20_000_000, a).when(price < 50_000_000, b).otherwise(c)
    return {"grade": tier(0, 1, 2), "grade_score": tier(20.0, 60.0, 100.0), "sqrt_lead": tier(0.48, 0.81, 1.12), "days": tier(7, 20, 38),
            "importance": sensitivity * 100 * 0.5 + tier(20.0, 60.0, 100.0) * 0.5}


def safety_stock(sigma: Column, lead: Column, level: float) -> Column:
    """stock for a service level."""
    return F.ceil(F.lit(NormalDist().inv_cdf(level)) * sigma * F.sqrt(lead)).cast("int")


def reorder_point(mean: Column, lead: Column, stock: Column) -> Column:
    """reorder point."""
    return F.ceil(mean * lead + stock).cast("int")


def service_quantity(quantity: Column, factor: float) -> Column:
    """quantity times service factor."""
    return F.ceil(quantity * factor).cast("int")


def zone(rul: Column, importance: Column) -> Column:
    """quadrant of urgency (at most 6 months) and importance (at least 0.7)."""
    return (F.when((rul <= 6) & (importance >= 0.7), "buy now").when((rul <= 6) & (importance < 0.7), "replace")
            .when((rul > 6) & (importance >= 0.7), "watch").otherwise("normal"))


def term_months(term: Column) -> Column:
    """months of a term, 3 for others."""
    out = F.lit(3)
    for name, n in TERM_MONTHS.items():
        out = F.when(term == name, n).otherwise(out)
    return out


def risk_z(level: Column) -> Column:
    """service factor of a risk level, 1.28 for others."""
    return F.when(level.isin("Low", "LOW"), RISK_Z["LOW"]).when(level.isin("High", "HIGH"), RISK_Z["HIGH"]).otherwise(RISK_Z["MEDIUM"])


def service_level(level: Column) -> Column:
    """the text of a risk level's service level; that of Medium for an unknown or null level."""
    out = F.lit(vocab.SERVICE_LEVELS["Medium"])
    for name, text in vocab.SERVICE_LEVELS.items():
        out = F.when(level == name, text).otherwise(out)
    return out


def intent_z(text: Column, urgent: str, relaxed: str) -> Column:
    """service factor by intent words, 1.28 without any."""
    return F.when(text.rlike(urgent), RISK_Z["HIGH"]).when(text.rlike(relaxed), RISK_Z["LOW"]).otherwise(RISK_Z["MEDIUM"])


def plan(df: DataFrame, as_of: str, months: int, term: str) -> DataFrame:
    """Orders of positive quantity with budget, deadline and comment, dearest first (by number, ties by item)."""
    budget = F.floor(F.col("quantity") * F.col("unit_price")).cast("long")
    comment = (F.when(F.col("lead_months") >= 3, F.concat(F.lit("lead time "), F.col("lead_months").cast("string"), F.lit(" months: order now")))
               .when(F.col("budget") > 10_000_000, "high budget: pool departments").otherwise(f"can be had within {term}"))
    out = df.filter(F.col("quantity") > 0).withColumn("budget", budget)
    return out.select("item_name", "quantity", "budget", F.concat(F.format_number("budget", 0), F.lit("원")).alias("budget_text"),
                      order_deadline(F.lit(as_of).cast("date"), F.lit(months), F.col("lead_months")).alias("order_by"), comment.alias("comment")).orderBy(F.desc("budget"), "item_name")


def item_meta(df: DataFrame, item: str = "item_name") -> DataFrame:
    """Per item, largest lead grade, lead months and mean price."""
    return df.groupBy(item).agg(F.max("lead_grade").alias("lead_grade"), F.avg("acq_amount").alias("unit_price")).withColumn("lead_months", F.col("lead_grade") + 1)


def monthly_needs(failures: DataFrame, meta: DataFrame) -> DataFrame:
    """Failures and needs (with safety stock) a month, and the earliest month to order in."""
    month = F.trunc("failure_date", "MM")
    per = failures.groupBy(month.alias("month"), "item_name").agg(F.count("*").alias("failures")).join(meta, "item_name", "left")
    per = per.withColumns({"need": F.col("failures") + F.coalesce("safety_stock", F.lit(0)), "order_in": order_month(F.col("month"), F.col("lead_months"))})
    return per.groupBy(F.date_format("month", "yyyy-MM").alias("month")).agg(F.sum("failures").alias("failures"), F.sum("need").alias("need"), F.min("order_in").alias("order_in"))


def failures_by_item(df: DataFrame, flag: Column, item: str = "item_name") -> DataFrame:
    """Failures of each item."""
    return df.filter(flag).groupBy(item).agg(F.count("*").alias("failures"))


#: Bounds of the remaining-life classes in months, right closed.
RUL_CLASSES = ("<=6", "6-12", "12-24", "24-60", ">60")


def rul_distribution(df: DataFrame, rul: str) -> DataFrame:
    """Assets and percent of each class, empty ones too."""
    c = F.col(rul)
    label = F.when(c <= 6, RUL_CLASSES[0]).when(c <= 12, RUL_CLASSES[1]).when(c <= 24, RUL_CLASSES[2]).when(c <= 60, RUL_CLASSES[3]).when(c > 60, RUL_CLASSES[4])
    counts = df.groupBy(label.alias("class")).agg(F.count("*").alias("n"))
    classes = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(RUL_CLASSES)], "pos int, class string")
    out = classes.join(counts, "class", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def months_grid(monthly: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Months 1 to 12 of each key, missing ones with 0."""
    grid = monthly.select(*keys).distinct().withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return grid.join(monthly, [*keys, "m"], "left").withColumn(value, F.coalesce(value, F.lit(0).cast("long")))


def peak_month(monthly: DataFrame, keys: Sequence[str], months: Sequence[int], value: str) -> DataFrame:
    """Month of the term with the largest value, the first of equals."""
    place = F.array_position(F.array(*[F.lit(m) for m in months]), F.col("m"))
    return monthly.filter(F.col("m").isin(*months)).groupBy(*keys).agg(F.max_by("m", F.struct(F.col(value), (-place).alias("p"))).alias("peak"))


def term_response(monthly: DataFrame, keys: Sequence[str], months: Sequence[int], first_days: dict[int, str], value: str) -> DataFrame:
    """twelve months of each key with quantity (0 outside the term), the reorder month and its date.

    The reorder month is the one before the peak in the order of the term, or the first.
    """
    order = F.array(*[F.lit(m) for m in months])
    peak = peak_month(monthly, keys, months, value)
    rop = F.element_at(order, F.greatest(F.array_position(order, F.coalesce("peak", F.lit(months[0]))) - 1, F.lit(1)).cast("int"))
    day = F.create_map(*[x for m, d in first_days.items() for x in (F.lit(m), F.lit(d))])
    out = months_grid(monthly, keys, value).join(peak, list(keys), "left").withColumn("is_rop", F.col("m") == rop)
    return out.withColumns({value: F.when(F.col("m").isin(*months), F.col(value)).otherwise(0), "rop_date": F.when(F.col("is_rop"), F.try_element_at(day, F.col("m")))}).drop("peak")


def item_lookup(df: DataFrame, item: str = "item_name") -> DataFrame:
    """one row per item, one with a date if there is any, with defaults for grade and model error."""
    order = Window.partitionBy(item).orderBy(F.asc_nulls_last("failure_date"), "asset_id")
    out = df.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
    return out.withColumns({"lead_grade": F.coalesce("lead_grade", F.lit(0)), "rmse": F.coalesce("rmse", F.lit(5.0))})


def delta_to_best(df: DataFrame, metric: str) -> DataFrame:
    """How far each model is from the best."""
    return df.withColumn("delta", F.col(metric) - F.min(metric).over(Window.partitionBy()))

"""Monthly demand series: calendar, lags, splits, naive forecasts, metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_date(disuse: Column, acquired: Column, life_years: Column, null_life_is_zero: bool = False) -> Column:
    """disuse date, else acquisition plus life in days."""
    life = F.coalesce(life_years, F.lit(0.0)) if null_life_is_zero else life_years
    return F.coalesce(disuse, F.date_add(acquired, F.rint(life * 365.25).cast("int")))


def monthly_counts(df: DataFrame, date: str, keys: Sequence[str] = ()) -> DataFrame:
    """Events of each month, by keys."""
    return df.groupBy(*keys, F.trunc(date, "MM").alias("month")).agg(F.count("*").alias("actual"))


def dense_calendar(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """U4: every month between a series' first and last, missing ones with 0."""
    span = monthly.groupBy(*keys).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    months = span.filter("a is not null").select(*keys, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return months.join(monthly, [*keys, "month"], "left").withColumn("actual", F.coalesce("actual", F.lit(0).cast("long")))


def with_trend(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Position in the series, and sine and cosine of the month of the year."""
    angle = F.month("month") * (2 * 3.141592653589793) / 12
    return series.withColumns({"trend": F.row_number().over(Window.partitionBy(*keys).orderBy("month")) - 1, "month_sin": F.sin(angle), "month_cos": F.cos(angle)})


def with_lags(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Values 1, 2, 3, 6, 12 months back; means and sample deviation of the rows before, null until the frame is full."""
    order = Window.partitionBy(*keys).orderBy("month")
    out = {f"lag_{k}": F.lag("actual", k).over(order) for k in (1, 2, 3, 6, 12)}
    for name, f, k in (("mean_3", F.avg, 3), ("mean_6", F.avg, 6), ("std_6", F.stddev_samp, 6)):
        frame = order.rowsBetween(-k, -1)
        out[name] = F.when(F.count("actual").over(frame) == k, f("actual").over(frame))
    return series.withColumns(out)


def positional_split(series: DataFrame, keys: Sequence[str] = (), least: int = 36) -> DataFrame:
    """Last months Test, those before Valid, the rest Train; series under `least` months raise no split (null)."""
    by = Window.partitionBy(*keys)
    n, k = F.count("*").over(by), F.row_number().over(by.orderBy(F.desc("month")))
    test = F.least(F.lit(12), F.greatest(F.lit(6), F.floor(n / 6)))
    valid = F.least(F.lit(6), F.greatest(F.lit(3), F.floor(n / 12)))
    out = series.withColumns({"__n": n, "__k": k, "__t": test, "__v": valid})
    return out.withColumn("split", F.when(F.col("__n") >= least, F.when(F.col("__k") <= F.col("__t"), "Test").when(F.col("__k") <= F.col("__t") + F.col("__v"), "Valid").otherwise("Train"))).drop("__n", "__k", "__t", "__v")


def last_months(series: DataFrame, keys: Sequence[str] = (), n: int = 12) -> DataFrame:
    """The last n months of each series."""
    return series.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("month")))).filter(F.col("__k") <= n).drop("__k")


def seasonal_naive(history: DataFrame, future: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The value of the same month a year before, else the mean of the last 12 months."""
    keys = list(keys)
    before = history.select(*keys, F.add_months("month", 12).alias("month"), F.col("actual").alias("__same"))
    mean = last_months(history, keys).groupBy(*keys).agg(F.avg("actual").alias("__mean"))
    out = future.join(before, [*keys, "month"], "left")
    out = out.join(mean, keys, "left") if keys else out.join(F.broadcast(mean))
    return out.withColumn("naive", F.coalesce(F.col("__same").cast("double"), "__mean")).drop("__same", "__mean")


def moving_average(history: DataFrame, keys: Sequence[str] = (), w: int = 6) -> DataFrame:
    """Mean of the last w months of each series."""
    return last_months(history, keys, w).groupBy(*keys).agg(F.avg("actual").alias("forecast"))


def baselines(history: DataFrame, future: DataFrame, keys: Sequence[str], windows: Sequence[int] = (3, 6, 12)) -> DataFrame:
    """M8: forecasts of each future month of a series by the baselines (keys, month, actual, model, forecast), not under 0: seasonal naive, moving averages."""
    keys, parts = list(keys), []
    parts.append(seasonal_naive(history, future, keys).select(*keys, "month", "actual", F.lit("SeasonalNaive").alias("model"), F.col("naive").alias("forecast")))
    for w in windows:
        parts.append(future.join(moving_average(history, keys, w), keys, "left").select(*keys, "month", "actual", F.lit(f"MovingAverage{w}").alias("model"), "forecast"))
    return reduce(DataFrame.unionByName, parts).withColumn("forecast", F.greatest("forecast", F.lit(0.0)))


def regression_metrics(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE, R2; R2 is null for a constant target."""
    e = F.col(y) - F.col(p)
    total = F.var_pop(y) * F.count(y)
    r2 = F.when(total > 0, 1 - F.sum(e * e) / total)
    return df.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), r2.alias("r2"), F.count("*").alias("n"))


def urgent_metrics(df: DataFrame, y: str, p: str, limit: float = 6.0, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of "at most `limit`"; 0 where a denominator is 0."""
    real, said = F.col(y) <= limit, F.col(p) <= limit
    per = df.groupBy(*keys).agg(F.count_if(real & said).alias("tp"), F.count_if(~real & said).alias("fp"), F.count_if(real & ~said).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = per.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def smape(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Symmetric percentage error over rows with a non-zero denominator; predictions under 0 count as 0."""
    held = F.greatest(F.col(p), F.lit(0.0))
    d = F.abs(F.col(y)) + F.abs(held)
    return df.groupBy(*keys).agg((F.avg(F.when(d > 0, 2 * F.abs(held - F.col(y)) / d)) * 100).alias("smape"))


def evaluation_frame(df: DataFrame, y: str, p: str) -> DataFrame:
    """Absolute error and clipped prediction beside actual and predicted."""
    return df.withColumns({"abs_error": F.abs(F.col(y) - F.col(p)), "clipped": F.greatest(F.col(p), F.lit(0.0))})


def period_summary(df: DataFrame, date: str, keys: Sequence[str] = ()) -> DataFrame:
    """First and last date and number of rows."""
    return df.groupBy(*keys).agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count("*").alias("n"))


def demand_sigma(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sample deviation of counts, 0 for a single month."""
    return series.groupBy(*keys).agg(F.coalesce(F.stddev_samp("actual"), F.lit(0.0)).alias("sigma_d"))


def ranked(df: DataFrame, metric: str, tie: str, n: int | None = None) -> DataFrame:
    """Candidates by a metric, the best n. One row per candidate takes part."""
    out = df.withColumn("place", F.row_number().over(Window.orderBy(metric, tie)))
    return out.filter(F.col("place") <= n) if n else out


def promote(candidates: DataFrame, current: DataFrame, metric: str, tie: str) -> DataFrame:
    """The best candidate, the metric of the model in use (null if there is none) and whether the candidate takes its place.

    current: (metric) of the stored record of the model in use, at most one row.
    """
    best = ranked(candidates, metric, tie, 1).drop("place")
    held = current.agg(F.min(metric).alias("current"))
    return best.join(F.broadcast(held)).withColumn("promote", F.col("current").isNull() | (F.col(metric) < F.col("current")))

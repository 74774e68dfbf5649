"""One row per asset: joins, dates, labels, outliers, derived features, maintenance, split, encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..sources.tables import staged
from .ordering import column_quantiles, quantiles, row_numbers


def rounded(c: Column, digits: int) -> Column:
    """Half-even rounding of the scaled value."""
    return F.rint(c * 10**digits) / 10**digits


def clip01(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def join_outcomes(assets: DataFrame, disuse: DataFrame, disposal: DataFrame, key: str = "asset_id") -> DataFrame:
    """Each asset with its latest disuse and disposal; both must have one row a key."""
    return assets.join(disuse, key, "left").join(disposal, key, "left")


def reference_date(disposal_confirm: Column, disuse_confirm: Column, disuse: Column, approved: Column, as_of: Column) -> Column:
    """disposal's confirmation, else disuse's, else an approved disuse's date, else as_of."""
    return F.coalesce(disposal_confirm, disuse_confirm, F.when(approved, disuse), as_of)


def age_years(ref: Column, acquired: Column) -> Column:
    """years between two dates, not under 0."""
    days = F.datediff(ref, acquired)
    return rounded(F.when(days.isNotNull(), F.greatest(days, F.lit(0))) / 365.0, 2)


def term_features(date: Column) -> dict[str, Column]:
    """term, its code, and flags of preparation, budget and vacation months."""
    m = F.month(date)
    term = F.when(m.isin(3, 4, 5, 6), "first").when(m.isin(7, 8), "summer").when(m.isin(9, 10, 11, 12), "second").otherwise("winter")
    code = F.when(m.isin(3, 4, 5, 6), 1).when(m.isin(7, 8), 2).when(m.isin(9, 10, 11, 12), 3).otherwise(0)
    flag = lambda *months: F.coalesce(m.isin(*months), F.lit(False)).cast("int")
    return {"term": term, "term_code": code, "is_prep_month": flag(2, 3, 8, 9), "is_budget_month": flag(12), "is_vacation": flag(1, 2, 7, 8)}


def wear_features(life: Column, age: Column, severity: Column) -> dict[str, Column]:
    """remaining life, cumulative load, and wear; a life of 0 gives null wear."""
    return {"life_left": rounded(life - age, 2), "load": rounded(age * severity, 2), "wear": rounded(clip01(F.pow(age / F.nullif(life, F.lit(0)), F.lit(2.0))), 2)}


def price_features(price: Column) -> dict[str, Column]:
    """price sensitivity, lead grade, importance."""
    sense = rounded(clip01(F.log1p(price) / F.log1p(F.lit(1e8))), 2)
    grade = F.when(price < 5_000_000, 0).when(price < 30_000_000, 1).otherwise(2)
    return {"sensitivity": sense, "lead_grade": grade, "importance": rounded(sense * 0.7 + grade * 0.5 * 0.3, 2)}


def severity(dept: Column, high: str = vocab.SEVERITY_HIGH, middle: str = vocab.SEVERITY_MIDDLE) -> Column:
    """1.3, 1.2 or 1.0 by ordered word patterns; null is 1.0."""
    return F.when(dept.rlike(high), 1.3).when(dept.rlike(middle), 1.2).otherwise(1.0)


def end_of_life(disposal_confirmed: Column, disuse_confirmed: Column, scrapped: Column, sold: Column, physical: Column) -> Column:
    """Y for a physical end of life: confirmed scrapping or confirmed sale, for a physical reason."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    return F.when(sure(physical) & (sure(disposal_confirmed) & sure(scrapped) | sure(disuse_confirmed) & sure(sold)), "Y").otherwise("N")


def physical_reason(reason: Column) -> Column:
    """whether a reason is a physical one; null is none."""
    return F.coalesce(reason.isin(*vocab.PHYSICAL_REASONS), F.lit(False))


def is_repair(kind: Column, result: Column, kinds: Sequence[str], results: Sequence[str]) -> Column:
    """a repair by type or by result; nulls are none."""
    return F.coalesce(kind.isin(*kinds), F.lit(False)) | F.coalesce(result.isin(*results), F.lit(False))


def category_codes(df: DataFrame, column: str, to: str) -> DataFrame:
    """rank of the label among all labels, from 0; null is -1. Labels are ranked apart from the rows."""
    codes = row_numbers(df.select(column).distinct().filter(F.col(column).isNotNull()), to, [column]).withColumn(to, F.col(to) - 1)
    return df.join(codes, column, "left").withColumn(to, F.coalesce(F.col(to), F.lit(-1)))


def budget_code(grade: Column) -> Column:
    """0, 1, 2 for LOW, MEDIUM, HIGH; 1 otherwise."""
    return F.when(grade == "LOW", 0).when(grade == "HIGH", 2).otherwise(1)


def fill_price(df: DataFrame, price: str = "acq_amount", default: float = 1_000_000.0) -> DataFrame:
    """Null and zero prices become the median of the positive ones."""
    middle = quantiles(df.filter(F.col(price) > 0), price, [0.5]).select(F.coalesce(F.col("q")[0], F.lit(default)).alias("__median"))
    return df.join(F.broadcast(middle)).withColumn(price, F.coalesce(F.nullif(F.col(price), F.lit(0.0)), F.col("__median"))).drop("__median")


def fill_mode(df: DataFrame, column: str, default: int = 5) -> DataFrame:
    """Nulls become the most frequent value, the lowest of equals."""
    most = df.agg(F.coalesce(F.mode(column, True), F.lit(default)).alias("__mode"))
    return df.join(F.broadcast(most)).withColumn(column, F.coalesce(column, "__mode")).drop("__mode")


def quartile_bounds(df: DataFrame, column: str, reach: float = 2.0) -> DataFrame:
    """One row: q1, q3 (linear interpolation) and bounds `reach` interquartile ranges beyond them."""
    q = quantiles(df, column, [0.25, 0.75]).select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    return q.withColumns({"low": F.col("q1") - reach * (F.col("q3") - F.col("q1")), "high": F.col("q3") + reach * (F.col("q3") - F.col("q1"))})


def drop_outliers(df: DataFrame, column: str, label: str = "label") -> DataFrame:
    """P20: labelled rows outside the bounds of labelled rows go; all others stay."""
    bounds = quartile_bounds(df.filter(F.col(label) == "Y"), column)
    inside = (F.col(column) >= F.col("low")) & (F.col(column) <= F.col("high"))
    return df.join(F.broadcast(bounds)).filter((F.col(label) == "N") | inside).drop("q1", "q3", "low", "high")


def batch_features(df: DataFrame, batch: str = "batch_id", age: str = "age", within: DataFrame | None = None) -> DataFrame:
    """Size and mean age of the purchase batch; assets without batch are their own. Batches are counted on `within`, if it is given, else on df."""
    per = (df if within is None else within).filter(F.col(batch).isNotNull()).groupBy(batch).agg(F.count("*").alias("batch_size"), F.avg(age).alias("batch_age"))
    return df.join(per, batch, "left").withColumns({"batch_size": F.coalesce("batch_size", F.lit(1)), "batch_age": rounded(F.coalesce("batch_age", age), 2)})


def maintenance_features(events: DataFrame, base: DataFrame, repair: Column, replace: Column, key: str = "asset_id") -> DataFrame:
    """Per asset, events up to its reference date. base: (key, ref_date) of each asset."""
    own = events.join(base.select(key, "ref_date"), key).filter(F.col("event_date") <= F.col("ref_date"))
    since = lambda days: F.count_if(F.col("event_date") >= F.date_sub("ref_date", days))
    return own.groupBy(key).agg(F.count("*").alias("n_events"), F.count_if(repair).alias("n_repairs"), since(365).alias("n_1y"), since(730).alias("n_2y"),
                                F.sum("cost").alias("cost_sum"), F.max("severity").alias("max_severity"), F.count_if(F.coalesce(replace, F.lit(False))).alias("n_replace"), F.max("event_date").alias("last_event"))


def with_maintenance(base: DataFrame, found: DataFrame, key: str = "asset_id") -> DataFrame:
    """A5: assets without events get zeros; months since the last event fall back to the age; cost as a share of the price."""
    out = base.join(found, key, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_events", "n_repairs", "n_1y", "n_2y", "cost_sum", "max_severity", "n_replace")}
    months = F.greatest(F.datediff("ref_date", "last_event") / 30.4375, F.lit(0.0))
    out = out.withColumns(zero).withColumn("months_since", rounded(F.when(F.col("n_events") > 0, months).otherwise(F.col("age") * 12), 1))
    return out.withColumn("cost_share", rounded(F.coalesce(clip01(F.col("cost_sum") / F.nullif(F.col("acq_amount"), F.lit(0.0))), F.lit(0.0)), 3)).drop("last_event")


def split_sizes(n: Column) -> tuple[Column, Column]:
    """Rows of Train and Valid among n rows of an item."""
    part = F.floor(n * F.lit(0.70)).cast("int")
    valid = F.greatest(F.floor(n * F.lit(0.20)).cast("int"), F.lit(1))
    few = F.greatest(part, F.lit(2))
    train = F.when(n >= 10, part).when(n >= 5, F.when(few + 1 >= n, n - 2).otherwise(few)).when(n >= 3, n - 2).otherwise(n)
    held = F.when(n >= 10, F.when(part + valid >= n, F.greatest(F.lit(1), n - part - 1)).otherwise(valid)).when(n >= 3, 1).otherwise(0)
    return train.cast("int"), held.cast("int")


def time_split(df: DataFrame, item: str, date: str, key: str, label: str = "label") -> DataFrame:
    """Labelled rows of an item by date: Train, Valid, Test; all other rows, and items without name, Prediction."""
    able = (F.col(label) == "Y") & F.col(item).isNotNull()
    by = Window.partitionBy(item)
    own = df.filter(able).withColumns({"__n": F.count("*").over(by), "__k": F.row_number().over(by.orderBy(F.asc_nulls_last(date), key))})
    train, valid = split_sizes(F.col("__n"))
    own = own.withColumn("split", F.when(F.col("__k") <= train, "Train").when(F.col("__k") <= train + valid, "Valid").otherwise("Test")).drop("__n", "__k")
    return own.unionByName(df.filter(~F.coalesce(able, F.lit(False))).withColumn("split", F.lit("Prediction")))


def time_split_large(df: DataFrame, item: str, date: str, key: str, label: str = "label") -> DataFrame:
    """W6 for items too large for one task: cuts from counts by day; only rows of a cut's day are ranked."""
    able = (F.col(label) == "Y") & F.col(item).isNotNull()
    own = df.filter(able)
    days = own.groupBy(item, date).agg(F.count("*").alias("__d"))
    run = Window.partitionBy(item).orderBy(F.asc_nulls_last(date)).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumns({"__before": F.coalesce(F.sum("__d").over(run), F.lit(0)), "__n": F.sum("__d").over(Window.partitionBy(item))})
    train, valid = split_sizes(F.col("__n"))
    days = days.withColumns({"__t": train, "__v": train + valid}).withColumnsRenamed({item: "__item", date: "__date"})
    placed = own.join(days, F.col(item).eqNullSafe(F.col("__item")) & F.col(date).eqNullSafe(F.col("__date")))
    name = lambda k: F.when(k <= F.col("__t"), "Train").when(k <= F.col("__v"), "Valid").otherwise("Test")
    first, last = F.col("__before") + 1, F.col("__before") + F.col("__d")
    cut = name(first) != name(last)
    ranked = placed.filter(cut).withColumn("split", name(F.row_number().over(Window.partitionBy(item, date).orderBy(key)) + F.col("__before")))
    out = placed.filter(~cut).withColumn("split", name(last)).unionByName(ranked).drop("__item", "__date", "__d", "__before", "__n", "__t", "__v")
    return out.unionByName(df.filter(~F.coalesce(able, F.lit(False))).withColumn("split", F.lit("Prediction")))


def target_encodings(df: DataFrame, categories: Sequence[str], target: str, k: float = 10.0, default: float = 5.0) -> DataFrame:
    """A10: per category value the mean target on Train, drawn to the global mean by k rows; unseen ones get the global mean.

    The global mean is that of Train, else of all labelled rows, else the default. One pass
    over df sums for all categories at once; what is joined back has a row a category value.
    """
    train = F.when(F.col("split") == "Train", F.col(target))
    values = F.explode(F.array(F.struct(F.lit("").alias("c"), F.lit(None).cast("string").alias("v")), *[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categories]))
    sums = (df.select(train.alias("t"), F.when(F.col("label") == "Y", F.col(target)).alias("y"), values.alias("x"))
            .groupBy("x.c", "x.v").agg(F.avg("t").alias("m"), F.count("t").alias("n"), F.avg("y").alias("y")))
    sums = staged(sums, "category-sums")  # else each of the joins below would make the pass again
    overall = sums.filter("c = ''").select(F.coalesce("m", "y", F.lit(default)).alias("__g"))
    out = df.join(F.broadcast(overall))
    for c in categories:
        per = sums.filter((F.col("c") == c) & (F.col("n") > 0)).select(F.col("v").alias("__v"), F.col("m").alias("__m"), F.col("n").alias("__n"))
        smooth = (F.col("__m") * F.col("__n") + F.col("__g") * k) / (F.col("__n") + k)
        out = out.join(per, F.col(c).cast("string") == F.col("__v"), "left").withColumn(f"{c}_te", F.coalesce(smooth, "__g")).drop("__v", "__m", "__n")
    return out.drop("__g")


def guard_leaks(columns: Sequence[str], features: Sequence[str], leaks: Sequence[str]) -> list[str]:
    """The features, if none of them leaks and none is missing; else ValueError."""
    if bad := sorted(set(features) & set(leaks)):
        raise ValueError(f"features that leak the outcome: {bad}")
    if missing := [f for f in features if f not in columns]:
        raise ValueError(f"missing features: {missing}")
    return list(features)


def impute_medians(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """Nulls become the exact median of the rows it is fitted on, else 0; one range sort for all columns."""
    found = column_quantiles(df.filter(fit_on) if fit_on is not None else df, columns, [0.5])
    one = found.agg(*[F.coalesce(F.max(F.when(F.col("c") == i, F.col("q")[0])), F.lit(0.0)).alias(f"__{c}") for i, c in enumerate(columns)])
    return df.join(F.broadcast(one)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")) for c in columns}).drop(*[f"__{c}" for c in columns])


def model_input(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The model's columns in its order; absent ones are 0."""
    return impute_medians(df.withColumns({c: F.lit(0.0) for c in order if c not in df.columns}), order).select(*order)


def outlier_statistics(outliers: DataFrame, value: str, item: str, top: int = 3) -> DataFrame:
    """Rows, least, greatest and most frequent value of outliers, and the `top` most frequent items with their counts, ties by name."""
    first = lambda c, n: F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col(c).alias("v")))), 1, n)
    values = outliers.filter(F.col(value).isNotNull()).groupBy(value).count().orderBy(F.desc("count"), value).limit(1).agg(F.first(value).alias("most_frequent"))
    items = outliers.filter(F.col(item).isNotNull()).groupBy(item).count().orderBy(F.desc("count"), item).limit(top).agg(first(item, top).alias("t"))
    shown = F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["v"], (-x["n"]).cast("string"))), ", ")
    return outliers.agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).join(F.broadcast(values)).join(F.broadcast(items)).select("n", "lo", "hi", "most_frequent", shown.alias("top_items"))


def in_months(years: Column) -> Column:
    """Years as months."""
    return years.cast("double") * 12

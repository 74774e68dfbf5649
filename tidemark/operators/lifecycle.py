"""From purchases, changes and lists to assets, validity intervals, views and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from .keywords import keyword_hits
from .ordering import row_numbers, running_totals

OPEN_END = "2099-12-31"


def confirmed(df: DataFrame, approval: str = "approval", value: str = "confirmed") -> DataFrame:
    """Confirmed rows only."""
    return df.filter(F.col(approval) == value)


def explode_batches(df: DataFrame, qty: str = "qty", amount: str = "acq_amount") -> DataFrame:
    """One row for each asset of a batch; its price is the truncated share, qty becomes 1. No rows for qty under 1."""
    unit = F.coalesce(F.expr(f"cast({amount} / nullif({qty}, 0) AS long)"), F.lit(0).cast("long"))
    return (df.filter(F.col(qty) > 0).withColumn(amount, unit).withColumn("unit_no", F.explode(F.sequence(F.lit(1), F.col(qty).cast("int"))))
            .withColumn(qty, F.lit(1)))


def fill_defaults(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Absent columns get their default; present ones become numbers, bad and null values the default."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(float(v))) if c in df.columns else F.lit(float(v)) for c, v in defaults.items()})


def batch_ids(df: DataFrame, batch: str = "batch_id", asset: str = "asset_id", year: str | None = None) -> DataFrame:
    """Blank batch ids become B + year + last five characters of the asset id, or B + asset id."""
    made = F.concat(F.lit("B"), F.col(year).cast("string"), F.right(F.col(asset).cast("string"), F.lit(5))) if year else F.concat(F.lit("B"), F.col(asset).cast("string"))
    return df.withColumn(batch, F.when(F.trim(F.coalesce(F.col(batch).cast("string"), F.lit(""))) == "", made).otherwise(F.col(batch).cast("string")))


def blank_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P5: null text becomes empty text."""
    return df.fillna("", subset=list(columns))


def with_dates(df: DataFrame, column: str) -> DataFrame:
    """Rows whose date can be read, as dates."""
    return df.withColumn(column, F.try_to_date(F.col(column).cast("string"))).filter(F.col(column).isNotNull())


def historical_price(price: Column, qty: Column, year: Column, year_now: int) -> Column:
    """Amount of a purchase in an earlier year: 1.5 % a three-year step, 5 % off from ten pieces, whole thousands a piece."""
    unit = price / F.pow(F.lit(1.015), (F.lit(year_now) - year) / 3.0) * F.when(qty >= 10, 0.95).otherwise(1.0)
    return (F.floor(F.floor(unit) / 1000) * 1000 * qty).cast("long")


def dept_policy(df: DataFrame, policy: DataFrame, dept: str, defaults: dict[str, float], mark: str, inside: str, outside: str, qty: str = "qty", bulk: int = 10) -> DataFrame:
    """Campus by a word in the department, flag of bulk purchases, and policy numbers with defaults."""
    out = df.join(policy, dept, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
    return out.withColumn("campus", F.when(F.col(dept).contains(mark), inside).otherwise(outside)).withColumn("is_bulk", (F.col(qty) >= bulk).cast("int"))


def settle_pending(df: DataFrame, before: str, date: str = "acq_date", approval: str = "approval", pending: str = "pending", done: str = "confirmed") -> DataFrame:
    """What is still pending from before a day counts as confirmed."""
    return df.withColumn(approval, F.when((F.col(approval) == pending) & (F.col(date) < F.lit(before).cast("date")), done).otherwise(F.col(approval)))


def placeholders(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Result columns that a later job fills."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()})


def latest(df: DataFrame, key: str | Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an order, which must end in a tie-breaker."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def number_assets(df: DataFrame, date: str, *order: Column, prefix: str = "M") -> DataFrame:
    """Ids prefix + year + number within the year, of at least five digits."""
    year = F.year(date)
    n = F.row_number().over(Window.partitionBy(year).orderBy(*order)).cast("string")
    return df.withColumn("asset_id", F.concat(F.lit(prefix), year.cast("string"), F.when(F.length(n) < 5, F.lpad(n, 5, "0")).otherwise(n)))


def number_large_years(df: DataFrame, date: str, *order: Column, prefix: str = "M", ranges: int | None = None) -> DataFrame:
    """W5 for years that are too large for one task: the same ids, numbered by ranges of the order."""
    names = [f"__o{i}" for i in range(len(order))]
    placed = df.withColumns({"__y": F.year(date), **dict(zip(names, order))})
    n = F.col("__k").cast("string")
    out = row_numbers(placed, "__k", names, ["__y"], ranges)
    return out.withColumn("asset_id", F.concat(F.lit(prefix), F.col("__y").cast("string"), F.when(F.length(n) < 5, F.lpad(n, 5, "0")).otherwise(n))).select(*df.columns, "asset_id")


def validity(history: DataFrame, key: str = "asset_id", at: str = "changed_at") -> DataFrame:
    """valid_from, valid_to (a day before the next change, else 2099-12-31) and is_current. at must be unique in a key."""
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at))
    return history.withColumns({"valid_from": F.col(at), "valid_to": F.coalesce(following - F.expr("INTERVAL 1 DAY"), F.lit(OPEN_END).cast(history.schema[at].dataType)), "is_current": following.isNull()})


#: Days that share a bin of the interval join, on average.
DAYS_A_BIN = 16


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def held_on(intervals: DataFrame, days: DataFrame) -> DataFrame:
    """Intervals that hold on each of some days, of any number; empty intervals never do.

    Intervals have valid_from and valid_to, both inclusive, days a column day; null ends and
    days hold nothing. Time between the first and last day is cut into bins; an interval goes to
    the bins that it touches and meets the days of its bin by an equal key, so what is compared
    is about what is found.
    """
    span = days.agg(F.min(_micros("day")).alias("low"), F.max(_micros("day")).alias("high"), F.count("day").alias("n")).first()
    low, high = span["low"] or 0, span["high"] or 0
    width = max(1, -(-(high - low + 1) // max(1, span["n"] // DAYS_A_BIN)))
    place = lambda t: F.floor((F.greatest(F.least(t, F.lit(high)), F.lit(low)) - low) / width)
    able = intervals.filter((_micros("valid_from") <= high) & (_micros("valid_to") >= low) & (F.col("valid_from") <= F.col("valid_to")))
    binned = able.withColumn("__bin", F.explode(F.sequence(place(_micros("valid_from")), place(_micros("valid_to")))))
    dated = days.filter("day is not null").withColumn("__bin", place(_micros("day")))
    return binned.join(dated, "__bin").filter((F.col("valid_from") <= F.col("day")) & (F.col("valid_to") >= F.col("day"))).drop("__bin")


def held_counts(intervals: DataFrame, days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, day, qty): how many intervals hold on each day, without any pair of interval and day.

    Intervals and days are as in held_on; days with none are left out, days that repeat count
    once. An interval adds one on the first day that is not before its start and takes one away
    on the first day after its end; sums of these per group and day, added up in the order of the
    days, are the counts. Null groups are groups.
    """
    by = list(by)
    once = row_numbers(days.filter("day is not null").select(_micros("day").alias("__t"), "day").dropDuplicates(["__t"]), "__i", ["__t"]).withColumn("__i", F.col("__i") - 1)
    able = intervals.filter(F.col("valid_from") <= F.col("valid_to"))
    # at one time a start comes before the day, an end after it
    ends = F.explode(F.array(F.struct(_micros("valid_from").alias("__t"), F.lit(0).alias("__kind"), F.lit(1).alias("__d")), F.struct(_micros("valid_to").alias("__t"), F.lit(2).alias("__kind"), F.lit(-1).alias("__d"))))
    changes = able.select(*by, ends.alias("x")).select(*by, "x.*").groupBy(*by, "__t", "__kind").agg(F.sum("__d").alias("__d"))
    times = changes.select("__t", "__kind").distinct().withColumn("__n", F.lit(0)).unionByName(once.select("__t", F.lit(1).alias("__kind"), F.lit(1).alias("__n")))
    placed = running_totals(times, "__at", "__n", ["__t", "__kind"]).filter("__kind <> 1").select("__t", "__kind", "__at")
    sums = changes.join(placed, ["__t", "__kind"]).groupBy(*by, "__at").agg(F.sum("__d").alias("__d"))
    along = Window.partitionBy(*by).orderBy("__at")  # as many rows as there are days
    runs = sums.select(*by, "__at", F.sum("__d").over(along).alias("qty"), F.lead("__at").over(along).alias("__next"))
    last = once.agg(F.max("__i").alias("m")).first()["m"]
    if last is None:
        return runs.select(*by, F.lit(None).cast(days.schema["day"].dataType).alias("day"), "qty").limit(0)
    each = runs.filter(f"qty > 0 and __at <= {last}").select(*by, "qty", F.explode(F.sequence(F.col("__at"), F.coalesce(F.col("__next") - 1, F.lit(last)).cast("long"))).alias("__i")).filter(f"__i <= {last}")
    return each.join(once.select("__i", "day"), "__i").select(*by, "day", "qty")


def in_stock(assets: DataFrame, day: Column, gone: str = "D") -> DataFrame:
    """Assets got by a day and neither cleared before it nor disposed of."""
    return assets.filter((F.col("acq_date") <= day) & ((F.col("clear_date") >= day) | (F.col("clear_date").isNull() & (F.col("status") != gone))))


def add_missing(df: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """Columns of the master that df lacks, by key; master must have one row a key."""
    return df.join(master.select(key, *[c for c in master.columns if c not in df.columns]), key, "left")


def restore_dept(df: DataFrame, last_transfer: DataFrame, key: str = "asset_id") -> DataFrame:
    """Blank departments from the asset's last transfer, else empty."""
    own = F.when(F.trim("dept") != "", F.col("dept"))
    return df.join(last_transfer.select(key, F.col("dept").alias("__dept")), key, "left").withColumn("dept", F.coalesce(own, F.col("__dept"), F.lit(""))).drop("__dept")


def end_dates(assets: DataFrame, disposal: DataFrame, disuse: DataFrame, as_of: str, key: str = "asset_id") -> DataFrame:
    """Last disposal (confirmed date, else date), else last disuse, else as_of."""
    gone = disposal.groupBy(key).agg(F.max(F.coalesce("confirm_date", "event_date")).alias("__gone"))
    out = disuse.groupBy(key).agg(F.max(F.coalesce("confirm_date", "event_date")).alias("__out"))
    return assets.join(gone, key, "left").join(out, key, "left").withColumn("end_date", F.coalesce("__gone", "__out", F.lit(as_of).cast("date"))).drop("__gone", "__out")


def restore_columns(df: DataFrame, origin: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns from distinct origin rows by several keys."""
    return df.join(origin.dropDuplicates(list(keys)), list(keys), "left")


def longest_match(df: DataFrame, rules: DataFrame, text: str, defaults: dict[str, float]) -> DataFrame:
    """Parameters of the longest keyword inside a text, the last of equals; defaults without one.

    rules: (keyword, ...), of any number; empty keywords are none. Each distinct text is scanned
    once for all keywords.
    """
    names = [c for c in rules.columns if c != "keyword"]
    best = F.max(F.struct(F.length("keyword").alias("__n"), "keyword", *names)).alias("__best")
    texts = df.select(F.col(text).alias("id"), F.col(text).alias("text")).distinct()
    found = keyword_hits(texts, rules).join(rules, "keyword").groupBy(F.col("id").alias(text)).agg(best)
    return df.join(found, text, "left").withColumns({c: F.coalesce(F.col("__best")[c], F.lit(defaults[c])) for c in names}).drop("__best")


def quantity_view(df: DataFrame, keys: Sequence[str], keep_nulls: bool = False) -> DataFrame:
    """A1, A2: rows of each group; rows with a null key are left out, or count as empty text."""
    if keep_nulls:
        return df.select([F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]).groupBy(*keys).agg(F.count("*").alias("qty"))
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("qty"))


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Counts of values, most first, at most n of them (a report)."""
    out = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column))
    return out.limit(n) if n else out


def check_row(df: DataFrame, name: str, bad: Column, skipped: Column) -> DataFrame:
    """(check, status, n_bad, n_skipped) of one check."""
    return df.agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("n_bad"), F.count_if(skipped).alias("n_skipped")).select(
        F.lit(name).alias("check_name"), F.when(F.col("n_bad") == 0, "ok").otherwise("bad").alias("status"), "n_bad", "n_skipped")


def normal_timestamp(text: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss` of a date or time text, else empty."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def next_window(day: Column, as_of: Column, windows: Sequence[tuple[int, int, int]] = vocab.DISPOSAL_WINDOWS, ahead: int = 180) -> Column:
    """first day of the nearest calendar window (month, first, last), of disposals by default, that a day can wait for.

    Inside a window that is the day itself. Windows that start after as_of or more than `ahead`
    days on don't count; without one the day stays; from as_of on it is as_of.
    """
    able = []
    for add in (0, 1):
        for month, first, last in windows:
            start, end = F.make_date(F.year(day) + add, F.lit(month), F.lit(first)), F.make_date(F.year(day) + add, F.lit(month), F.lit(last))
            begin = F.greatest(start, day)
            able.append(F.when((end >= day) & (begin <= as_of) & (F.datediff(begin, day) <= ahead), begin))
    return F.when(day >= as_of, as_of).otherwise(F.coalesce(F.least(*able), day))


def clipped(c: Column, low: float, high: float) -> Column:
    """A value held between two bounds; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def adjusted_life_days(mean: Column, severity: Column, usage: Column, price: Column, cheap_class: Column, manage: Column, replace: Column) -> Column:
    """F16: mean life in years by severity, usage, price tier, care and replacement policy; at least a year, in whole days.

    Price tiers start lower for a class of cheap goods (furniture).
    """
    high, middle = F.when(cheap_class, 1_000_000).otherwise(30_000_000), F.when(cheap_class, 300_000).otherwise(5_000_000)
    tier = F.when(price >= high, 1.15).when(price >= middle, 1.05).otherwise(1.0)
    policy = clipped(1.0 + (clipped(replace, 0.90, 1.15) - 1.0) * 0.5, 0.95, 1.08)
    years = mean / severity / clipped(usage, 0.90, 1.25) * tier * clipped(manage, 0.90, 1.10) / policy
    return (F.greatest(years, F.lit(1.0)) * 365).cast("int")


def usage_intensity(item: Column, dept: Column, budget: Column, hours: Column, shared: Column, in_class: Column, words: dict[str, str] = vocab.USAGE_WORDS) -> Column:
    """usage by kind of item and department, budget, sharing and hours; between 0.8 and 1.35.

    words: patterns for infra, it and furniture (items), lab and support (departments).
    """
    it, lab = item.rlike(words["it"]), dept.rlike(words["lab"])
    kind = F.when(item.rlike(words["infra"]), 1.18).when(it & lab, 1.12).when(it, 1.00).when(item.rlike(words["furniture"]), 0.95).otherwise(0.92)
    place = F.when(lab, 1.15).when(dept.rlike(words["support"]), 1.05).otherwise(1.0)
    money = F.when(budget == "LOW", 0.96).when(budget == "HIGH", 1.04).otherwise(1.0)
    index = kind * place * money * F.when(shared, 1.10).otherwise(1.0) * F.when(in_class, 1.08).otherwise(1.0) * clipped(hours / 140.0, 0.75, 1.25)
    return F.rint(clipped(index, 0.80, 1.35) * 1000) / 1000

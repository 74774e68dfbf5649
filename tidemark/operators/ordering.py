"""Row numbers, running sums and quantiles at any size: range sorts and sums per range instead of one sorted task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged

#: Rows up to which a table is broadcast to a join that has no equal keys.
SMALL = 10_000


def row_numbers(df: DataFrame, to: str, order: Sequence[str], within: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """df with the number of each row, from 1, in an order within groups.

    Rows are sorted by ranges of (within, order) that Spark draws to be of like size, numbered
    inside a range and shifted by the counts of the ranges before it. Nulls come first; order
    must end in a tie-breaker.
    """
    keys = [*within, *order]
    placed = staged(df.repartitionByRange(*([ranges] if ranges else []), *keys).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = placed.groupBy(*within, "__part").agg(F.count("*").alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    shift = shift.select(F.col("__part").alias("__p"), "__before", *[F.col(c).alias(f"__w{i}") for i, c in enumerate(within)])
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"__w{i}"))
    own = placed.withColumn("__n", F.row_number().over(Window.partitionBy("__part", *within).orderBy(*order)))
    return own.join(shift, same).select(*df.columns, (F.col("__n") + F.col("__before")).alias(to))


def running_totals(df: DataFrame, to: str, value: str, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """df with the sum of a column up to and with each row, in an order over the whole table.

    Ranges as in row_numbers: each is added up alone and shifted by the sums before it. Nulls
    come first; order must name a row.
    """
    placed = staged(df.repartitionByRange(*([ranges] if ranges else []), *order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shift = placed.groupBy("__part").agg(F.sum(value).alias("__s")).select(F.col("__part").alias("__p"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = placed.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(shift, F.col("__part") == F.col("__p")).select(*df.columns, (F.col("__own") + F.col("__before")).alias(to))


def quantiles(df: DataFrame, column: str, fractions: Sequence[float]) -> DataFrame:
    """One row with q, the quantiles of a column by linear interpolation, nulls left out; q is null without values.

    Values are counted, range-sorted and counted by range; only the values at the wanted places
    are looked up, so no task holds all of them.
    """
    per = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    placed = staged(per.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "value-ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = placed.groupBy("part").agg(F.sum("c").alias("__c")).withColumn("before", F.coalesce(F.sum("__c").over(before), F.lit(0))).select("part", "before")
    total = placed.agg(F.sum("c").alias("n"))
    wanted = total.select(F.posexplode(F.array(*[F.lit(float(p)) * (F.col("n") - 1) for p in fractions])).alias("i", "at")).filter("at is not null")
    wanted = wanted.select("i", (F.col("at") - F.floor("at")).alias("share"), F.floor("at").cast("long").alias("low"), F.ceil("at").cast("long").alias("high"))
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = placed.withColumn("own", F.sum("c").over(inside)).join(shift, "part").select("v", (F.col("own") + F.col("before") - F.col("c")).alias("from"), (F.col("own") + F.col("before")).alias("until"))
    # a row for each wanted quantile meets each span: as many as there are fractions
    at = lambda place: (F.col(place) >= F.col("from")) & (F.col(place) < F.col("until"))
    found = spans.join(F.broadcast(wanted), at("low") | at("high")).groupBy("i", "share").agg(F.max(F.when(at("low"), F.col("v"))).alias("a"), F.max(F.when(at("high"), F.col("v"))).alias("b"))
    ordered = F.array_sort(F.collect_list(F.struct("i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("q"))))
    return found.agg(ordered.alias("o")).select(F.when(F.size("o") > 0, F.transform("o", lambda x: x["q"])).alias("q"))


def column_quantiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """(c, q): for each column's number, its exact quantiles by linear interpolation, null and NaN left out; columns without values have no row.

    All columns become rows (column, value), which are counted and sorted by ranges once,
    whatever the number of columns.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]))
    counts = df.select(each.alias("x")).select("x.*").filter("v is not null and not isnan(v)").groupBy("c", "v").agg(F.count("*").alias("n"))
    placed = staged(running_totals(counts, "until", "n", ["c", "v"]), "placed-values")
    # a row for each column
    ends = placed.groupBy("c").agg(F.max("until").alias("end")).withColumn("before", F.coalesce(F.lag("end").over(Window.orderBy("c")), F.lit(0)))
    at = F.col("share") * (F.col("end") - F.col("before") - 1)
    wanted = ends.select("c", "end", "before", F.posexplode(F.array(*[F.lit(float(x)) for x in fractions])).alias("i", "share"))
    wanted = wanted.select("c", "i", (F.col("before") + F.floor(at)).alias("low"), (F.col("before") + F.ceil(at)).alias("high"), (at - F.floor(at)).alias("part"))
    inside = lambda place: (F.col(place) >= F.col("until") - F.col("n")) & (F.col(place) < F.col("until"))
    found = placed.join(F.broadcast(wanted), "c").filter(inside("low") | inside("high"))
    ends = found.groupBy("c", "i", "part").agg(F.max(F.when(inside("low"), F.col("v"))).alias("a"), F.max(F.when(inside("high"), F.col("v"))).alias("b"))
    ordered = F.array_sort(F.collect_list(F.struct("i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("q"))))
    return ends.groupBy("c").agg(F.transform(ordered, lambda x: x["q"]).alias("q"))


def medians(df: DataFrame, columns: Sequence[str], default: float = 0.0) -> dict[str, float]:
    """The exact median of each column, the default without values: as many numbers as columns."""
    found = {r["c"]: r["q"][0] for r in column_quantiles(df, columns, [0.5]).collect()}
    return {c: found.get(i, default) for i, c in enumerate(columns)}


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df to be broadcast if it has at most `most` rows; a larger one is left to Spark's own choice of a join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df

"""Tables and folders that all operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of an Arrow batch (a longer row comes alone), rows of a slice of it as Python strings.
BATCH_BYTES, SLICE_ROWS = 8 << 20, 250

#: White space as the contracts mean it: space, and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a fresh local one only where that is unset and driver and executors are one process (tests)."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        held = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(held)
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged frame that nothing reads any more."""
    if path := getattr(df, "_staged_at", None):
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def map_texts(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType | str, rows: int = SLICE_ROWS) -> DataFrame:
    """mapInPandas in slices of few rows, so that a worker never holds more than these as Python strings.

    Integers stay integers beside nulls. Texts are long rows of any length, so batches are bounded
    by bytes: where the session's limit is larger, it is set to BATCH_BYTES, which bounds what an
    executor and its workers hold at once. That setting changes no result.
    """
    setting, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    held = re.fullmatch(r"(\d+)b?", conf.get(setting))
    if not held or not 0 < int(held[1]) <= BATCH_BYTES:
        conf.set(setting, str(BATCH_BYTES))
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    fields = to_arrow_schema(schema)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                yield batch.slice(i, rows).to_pandas(integer_object_nulls=True)
            del batch
            pa.default_memory_pool().release_unused()

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(sliced(batches)):
            yield pa.RecordBatch.from_pandas(frame, schema=fields, preserve_index=False)

    return df.mapInArrow(arrow, schema)


def word_count(text: Column) -> Column:
    """Number of white-space separated words, null counting as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Distinct hashes of a group by which its threshold is chosen too high, so that one look almost always suffices.
SPARE = 4


def least_hashes(rows: DataFrame, text: str, each: int, group: str | None = None) -> DataFrame:
    """A bounded sample: of each group, the rows whose text has one of the `each` smallest 64-bit hashes, one row for each hash.

    rows: (text, group); with group None all rows are one group, and null groups take no part.
    Copies of one text count once, however many there are. A group with fewer different texts
    gives them all. The smallest hashes are looked for under a threshold from the number of
    different texts, which is raised until enough are found, so no table is too large to give a
    sample and no group of rows is gathered before it is cut down. The result is staged: at most
    `each` texts for each group. Groups must be few, as their thresholds go through the driver.
    """
    kind = F.lit(0) if group is None else F.col(group)
    own = rows.select(F.col(text).alias("text"), kind.alias("kind"), F.xxhash64(text).alias("h")).filter("kind is not null and text is not null")
    sizes = {r["kind"]: r["n"] for r in own.groupBy("kind").agg(F.approx_count_distinct("h", 0.05).alias("n")).collect()}
    spark, share = rows.sparkSession, {k: min(1.0, SPARE * each / max(1, n)) for k, n in sizes.items()}
    schema = own.select("kind", F.lit(0).cast("long").alias("top")).schema
    while True:
        tops = spark.createDataFrame([(k, min((1 << 63) - 1, -(1 << 63) + int(s * 2.0**64))) for k, s in share.items()], schema)
        found = own.join(F.broadcast(tops), "kind").filter(F.col("h") <= F.col("top")).groupBy("kind", "h").agg(F.min("text").alias("text"))
        place = F.row_number().over(Window.partitionBy("kind").orderBy("h"))
        held = staged(found.withColumn("place", place).filter(F.col("place") <= each).select("text", "kind", "h"), "sample")
        got = {r["kind"]: r["n"] for r in held.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        short = [k for k, s in share.items() if s < 1 and got.get(k, 0) < each]
        if not short:
            return held
        unstage(held)
        share.update({k: min(1.0, share[k] * 16) for k in short})


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str], within: str | None = None, ranges: int | None = None) -> DataFrame:
    """df with, for each new name in sums, the running sum of a column up to and with the row; staged.

    Rows are sorted by ranges of (within, order), which Spark draws so that they are of like
    size whatever the keys; each range is summed up alone and shifted by the ranges before it.
    order should name a row within its group: rows that tie are summed in any order. Sums start
    anew at each value of `within`, of which null is one. ranges: their number, by default that
    of shuffle partitions.
    """
    spread = df.repartitionByRange(*([ranges] if ranges else []), *([within] if within else []), *order)
    placed = staged(spread.withColumn("__part", F.spark_partition_id()), "ranges")
    own = ["__part", within] if within else ["__part"]
    group = F.col(within) if within else F.lit(0)
    before = Window.partitionBy(*([within] if within else [])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*own).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    shifts = totals.select(F.col("__part").alias("__p"), group.alias("__w"), *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = placed.withColumns({f"__own_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    out = added.join(shifts, (F.col("__part") == F.col("__p")) & group.eqNullSafe(F.col("__w")))
    summed = staged(out.select(*df.columns, *[(F.col(f"__own_{n}") + F.col(f"__{n}")).alias(n) for n in sums]), "running-sums")
    unstage(placed)
    return summed

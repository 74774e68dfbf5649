"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, so that a new batch meets it by a
sort-merge anti-join without moving the index. A batch is reduced to one row per digest
before it meets the index, so copies of one text never gather in a task. Every digest carries
the id of the batch that brought it: a batch that is run again finds its own digests and gives
the same rows as the first time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACES, staged, table

#: File in an index's folder that tells its number of buckets to sessions whose catalog doesn't know the table.
MARK = "_buckets-"
NEW = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """Null as empty, each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def text_digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _folder(spark: SparkSession, index: str):
    """Hadoop path and file system of the folder in which the catalog keeps a table of this name."""
    *db, name = index.replace("`", "").split(".")
    base = spark.catalog.getDatabase(db[0] if db else spark.catalog.currentDatabase()).locationUri
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name.lower()}")
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def ensure_index(spark: SparkSession, index: str, buckets: int, key_type: str) -> int:
    """Make the index table, or find the one that is there; returns its number of buckets.

    A table that another session made over the same warehouse is found by its folder, as
    catalogs that live in memory forget it.
    """
    if spark.catalog.tableExists(index):
        told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {index}").collect()}
        if told["keep_id"] != key_type:
            raise ValueError(f"{index} holds keys of type {told['keep_id']}, not {key_type}")
        return int(told["Num Buckets"])
    schema = f"digest string, keep_id {key_type}, n_rows long, batch string, added timestamp"
    at, system = _folder(spark, index)
    marks = [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []
    if held := [int(m.removeprefix(MARK)) for m in marks if m.startswith(MARK)]:
        spark.sql(f"CREATE TABLE {index} ({schema}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {held[0]} BUCKETS LOCATION '{at}'")
        return ensure_index(spark, index, held[0], key_type)
    (spark.createDataFrame([], schema).write.format("parquet").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(index))
    system.create(spark._jvm.org.apache.hadoop.fs.Path(at, f"{MARK}{buckets}"), True).close()
    return buckets


def batch_groups(digests: DataFrame) -> DataFrame:
    """One row per digest of (key, digest) rows: smallest key, rows that carry this key, rows in all.

    Both steps combine before they shuffle. A null key comes last.
    """
    by_key = digests.groupBy("digest", "key").agg(F.count("*").alias("c"))
    first = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "c"))
    return (by_key.groupBy("digest").agg(first.alias("f"), F.sum("c").alias("n_rows"))
            .select("digest", F.col("f.key").alias("keep_id"), F.col("f.c").alias("n_first"), "n_rows"))


def content_id(groups: DataFrame) -> str:
    """A batch id from what the batch holds: the same rows in any order have the same one."""
    sign = groups.agg(F.count("*").alias("n"), F.sum(F.xxhash64("digest", "keep_id", "n_first", "n_rows").cast("decimal(38,0)")).alias("h")).first()
    return f"{sign['n']}-{sign['h'] or 0}"


def append_new(groups: DataFrame, index: str, batch: str, buckets: int) -> DataFrame:
    """Add the digests of a batch that the index lacks; returns (digest, keep_id, n_rows, batch) of all its digests.

    Of digests that two jobs added at once the earlier counts. A digest keeps the keep_id and
    n_rows of the batch that brought it.
    """
    spark = groups.sparkSession
    buckets = ensure_index(spark, index, buckets, groups.schema["keep_id"].dataType.simpleString())
    new = groups.join(spark.table(index).select("digest").hint("merge"), "digest", "left_anti")
    (new.select("digest", "keep_id", "n_rows", F.lit(batch).alias("batch"), F.current_timestamp().alias("added"))
     .write.format("parquet").mode("append").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(index))
    # only what the batch asks for is looked at further; the index stays where it lies
    held = spark.table(index).join(groups.select("digest", "n_first").hint("merge"), "digest")
    return held.groupBy("digest", "n_first").agg(F.min(F.struct("added", "batch", "keep_id", "n_rows")).alias("i")).select("digest", "n_first", "i.keep_id", "i.n_rows", "i.batch")


def digest_groups(digests: DataFrame, index: str | None, buckets: int | None, batch: str | None) -> DataFrame:
    """(text_sha256, keep_id, group_size, own, n_first) of every digest of the staged (key, digest) rows."""
    spark = digests.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = staged(batch_groups(digests), "digest-groups")
    batch = batch or content_id(groups)
    name = index or f"digest_index_{uuid.uuid4().hex}"
    found = append_new(groups, name, batch, buckets).select(F.col("digest").alias("text_sha256"), "keep_id", F.col("n_rows").alias("group_size"), (F.col("batch") == batch).alias("own"), "n_first")
    found = staged(found, "digests-of-batch")
    if index is None:
        spark.sql(f"DROP TABLE {name}")
    return found


def exact_dedup(docs: DataFrame, index: str | None = None, buckets: int | None = None, key: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
    """Every row of docs with keep_id, group_size, kept and text_sha256.

    docs: any frame with a key, of any orderable type, and a text column; other columns pass
    through, ones named like the four new columns are replaced. index: name of the persistent
    table, which keeps its number of buckets and its type of key, in the folder that the catalog
    has for it; sessions that share the warehouse but no metastore find it there. Without one a
    table is made for this call and dropped. Of equal texts the row with the smallest key stays, null
    keys last; null text counts as empty, long texts count whole; of rows that repeat key and
    text one stays. An empty table gives an empty result. batch: a name of this batch, by
    default one made from its keys and texts; a batch that runs again under its name, as after
    a failure, gives the same result. Texts that another batch brought before are not kept, and
    keep_id and group_size are those of that batch.
    """
    docs = docs.drop(*NEW)
    names = [f"`{c}`" for c in docs.columns]
    digests = staged(docs.select(F.col(key).alias("key"), text_digest(F.col(text)).alias("digest")), "digests")
    found = digest_groups(digests, index, buckets, batch).withColumnsRenamed({"own": "__own", "n_first": "__n_first"})
    rows = docs.withColumn("text_sha256", text_digest(F.col(text)))
    tied = found.filter("__own and __n_first > 1")
    out = rows.join(found, "text_sha256").withColumn("kept", F.col("__own") & F.col(key).eqNullSafe(F.col("keep_id")))
    if tied.isEmpty():
        return out.select(*names, *NEW)
    # rows that repeat key and text are told apart by a number, written down so that it stays
    many = staged(out.filter("kept and __n_first > 1").withColumn("__row", F.monotonically_increasing_id()), "repeated-rows")
    first = many.groupBy("text_sha256").agg(F.min("__row").alias("__first"))
    chosen = many.join(first.select(F.col("__first").alias("__row"), F.lit(True).alias("__kept")), "__row", "left").withColumn("kept", F.col("__kept").isNotNull())
    return out.filter("not (kept and __n_first > 1)").select(*names, *NEW).unionByName(chosen.select(*names, *NEW))


def drop_copies(docs: DataFrame, index: str | None = None, key: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
    """The rows that exact_dedup keeps, with the columns of docs.

    Nulls, empty and long texts, ties, repeated rows and batches that run again are as there;
    columns named like exact_dedup's new ones come back as they were.
    """
    clash = {c: f"__held_{c}" for c in NEW if c in docs.columns}
    kept = exact_dedup(docs.withColumnsRenamed(clash), index, key=key, text=text, batch=batch).filter("kept")
    return kept.drop(*NEW).withColumnsRenamed({v: k for k, v in clash.items()}).select(*[f"`{c}`" for c in docs.columns])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id of the copy that stays and the size of its group."""
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *NEW)


OP3_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

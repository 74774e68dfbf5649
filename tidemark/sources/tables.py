"""Reading and writing tables: typed reads with fallbacks, conforming, staged replacement."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether a path is there, or the first of several."""
    at, system = _filesystem(spark, path if isinstance(path, str) else path[0])
    return system.exists(at)


def allow_all_characters(spark: SparkSession) -> None:
    """Let Spark read and write all of Java's character sets in this session."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, required: bool = False, encoding: str | None = None, legacy: str = "cp949", **options) -> DataFrame:
    """A CSV with header and declared types; missing or empty gives an empty table.

    A missing required table raises. Codes stay text because nothing is inferred. Each file is
    read as UTF-8, with or without a mark at its start, if all its bytes are that, else in the
    legacy character set; files of one folder may differ. With an encoding all files are read in
    it, without that look.
    """
    if not exists(spark, path):
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    if encoding is None:
        legacy_files, own = _by_character_set(spark, path)
        if legacy_files:
            found = read_csv(spark, legacy_files, schema, encoding=legacy, **options)
            return found.unionByName(read_csv(spark, own, schema, encoding="utf-8", **options)) if own else found
        path = own or path
    elif encoding.lower() not in ("utf-8", "utf-16", "utf-32", "iso-8859-1", "us-ascii"):
        allow_all_characters(spark)
    return spark.read.schema(schema).csv(path, header=True, encoding=encoding or "utf-8", **options)


def _by_character_set(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Paths of the files that are no UTF-8, and of the others.

    Lines are looked at by Spark where they lie, so no file is read whole; a line is UTF-8 if
    decoding leaves it as it was. Names of files come to the driver, as they do for any read.
    """
    allow_all_characters(spark)
    # one character a byte, so that every line comes as it is
    raw = F.encode(F.col("value"), "iso-8859-1")
    lines = spark.read.csv(path, schema="value string", encoding="iso-8859-1", sep="\x01", quote="", multiLine=False)
    bad = F.max(~F.coalesce(F.is_valid_utf8(raw.cast("string")), F.lit(True))).alias("bad")
    files = lines.select(F.col("_metadata.file_path").alias("file"), "value").groupBy("file").agg(bad).collect()
    names = lambda flag: sorted(unquote(r["file"]) for r in files if r["bad"] == flag)
    return names(True), names(False)


def read_first(spark: SparkSession, paths: list[str], schema: T.StructType | str, renames: dict[str, str] | None = None) -> DataFrame:
    """S3: the first of several file names that exists, with its old columns renamed."""
    for path in paths:
        if exists(spark, path):
            return spark.read.csv(path, header=True).withColumnsRenamed(renames or {})
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """Exactly these columns in this order, missing ones null; also the names that were missing."""
    missing = [c for c in columns if c not in df.columns]
    return df.select([F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]), missing


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Parquet, or CSV with header."""
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if form == "csv" else writer.format(form).save(path)


def read_json_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """(source, pos, item) of every element of the JSON arrays in a folder; files that hold no array are skipped.

    Items are variants, because one key may hold a list in one file and an object in another.
    """
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.expr("try_parse_json(value)").alias("v"))
    arrays = files.filter(F.expr("schema_of_variant(v) LIKE 'ARRAY%'"))
    return arrays.select("source", F.posexplode(F.expr("cast(v AS array<variant>)")).alias("pos", "item"))


def append_jsonl(df: DataFrame, path: str, order: Sequence[str] = ()) -> int:
    """Add results as JSON lines under the next batch number, which is returned.

    Each line carries its batch and its number in it, by `order`, else as the rows come, so that
    of one key the last line wins, inside one append too.
    """
    spark = df.sparkSession
    last = spark.read.schema("batch_no long").json(path).agg(F.max("batch_no")).first()[0] if exists(spark, path) else None
    batch = 1 if last is None else last + 1
    if order:
        from ..operators.ordering import row_numbers

        lines = row_numbers(df, "line_no", order)
    else:
        lines = df.withColumn("line_no", F.monotonically_increasing_id())
    lines.withColumn("batch_no", F.lit(batch).cast("long")).write.mode("append").json(path)
    return batch


def reload_jsonl(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last line of each key, by batch and by its number there; one aggregate, no sort."""
    rows = spark.read.schema(f"{schema}, batch_no long, line_no long").json(path)
    own = [c for c in rows.columns if c not in ("batch_no", "line_no")]
    last = F.max_by(F.struct(*own), F.struct("batch_no", "line_no")).alias("x")
    return rows.groupBy(F.col(key).alias("__key")).agg(last).select("x.*")


def compact_jsonl(spark: SparkSession, path: str, schema: str, key: str) -> int:
    """Drop superseded lines; what stays is published as one batch, beside which no older line is read. Returns the lines kept."""
    held = staged(reload_jsonl(spark, path, schema, key), "compacted")
    at, system = _filesystem(spark, path)
    old = [f.getPath() for f in system.listStatus(at)]
    append_jsonl(held, path)
    for file in old:  # only now: a crash before leaves both, and the last batch wins
        system.delete(file, True)
    return held.count()


def diagnostics(df: DataFrame, lists: list[str], preview: str, length: int = 300) -> DataFrame:
    """Lists joined by `|`, and the first characters of a long text, as flat columns for CSV."""
    return df.withColumns({c: F.array_join(c, "|") for c in lists}).withColumn(preview, F.substring(preview, 1, length))


def replace_table(df: DataFrame, path: str) -> int:
    """A plain folder: write beside it, look at the result, then swap; the old table comes back if the swap fails.

    Where renames aren't atomic, as on object stores, use publish_table.

    Returns the number of rows. An empty result raises and leaves the table alone.
    """
    spark = df.sparkSession
    fresh, backup = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    rows = spark.read.parquet(fresh).count()
    at, system = _filesystem(spark, path)
    new, old = _filesystem(spark, fresh)[0], _filesystem(spark, backup)[0]
    if not rows:
        system.delete(new, True)
        raise ValueError("the new table is empty; the old one stays")
    had = system.exists(at)
    if had and not system.rename(at, old):
        raise OSError(f"can't move {path}")
    if not system.rename(new, at):
        if had:
            system.rename(old, at)
        raise OSError(f"can't move {fresh}")
    if had:
        system.delete(old, True)
    return rows


MANIFEST = "_current"


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Published versions, (number, folder) in order. A pointer is a file `_current-<number>-<folder>` of no content."""
    at, system = _filesystem(spark, path)
    if not system.exists(at):
        return []
    names = [f.getPath().getName() for f in system.listStatus(at)]
    found = [re.fullmatch(MANIFEST + r"-(\d+)-(.+)", n) for n in names]
    return sorted((int(m[1]), m[2]) for m in found if m)


def publish_table(df: DataFrame, path: str) -> int:
    """A new version of a table, published by a pointer that is written last; returns its rows.

    The version goes to a folder of its own, is read back and counted, and only then a pointer
    file names it; nothing is renamed, so this holds on object stores too. A failure before the
    pointer leaves the table as it was. Of two writers at once both publish, and the higher
    number, then the greater name, is the table: readers see one or the other, whole. The
    version before stays for readers under way; older ones go. An empty result raises.
    """
    spark = df.sparkSession
    before = _versions(spark, path)
    folder = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    rows = spark.read.parquet(f"{path}/{folder}").count()
    if not rows:
        at, system = _filesystem(spark, f"{path}/{folder}")
        system.delete(at, True)
        raise ValueError("the new table is empty; the old one stays")
    _publish(spark, path, (before[-1][0] if before else 0) + 1, folder)
    for number, old in _versions(spark, path)[:-2]:
        for name in (f"{MANIFEST}-{number}-{old}", old):
            at, system = _filesystem(spark, f"{path}/{name}")
            system.delete(at, True)
    return rows


def _publish(spark: SparkSession, path: str, number: int, folder: str) -> None:
    at, system = _filesystem(spark, f"{path}/{MANIFEST}-{number}-{folder}")
    system.create(at, False).close()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The version of a table that was published last."""
    found = _versions(spark, path)
    if not found:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/{found[-1][1]}")


def save_vectors(df: DataFrame, path: str) -> None:
    """Embedded documents as a table, replaced as a whole."""
    publish_table(df, path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The embedded documents; FileNotFoundError without any."""
    return read_table(spark, path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir.

    A local folder is made only where that setting is missing and driver and executors are one
    process, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as the session has cores, for work that is dear for each row.

    A table that already comes in so many partitions stays where it is, so only what is smaller
    than the cluster moves.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back, for what several later steps read."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Queries of the readers and writers: what is written to the shared folder comes back as it was."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as tb
from .bindings import query, read


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s1_s5_csv(spark, d):
    """Written as CSV with header, read with declared types."""
    path = tb.fresh_path(spark, "csv")
    tb.write_table(read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), path, "csv")
    return tb.read_csv(spark, path, "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string", required=True)


@query("SELECT s_suppkey, '의자 ' || s_name AS name FROM supplier")
def s2_legacy_characters(spark, d):
    """A file in a legacy character set."""
    path = tb.fresh_path(spark, "cp949")
    tb.allow_all_characters(spark)
    read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("의자 "), "s_name").alias("name")).write.csv(path, header=True, encoding="cp949")
    return tb.read_csv(spark, path, "s_suppkey long, name string", encoding="cp949")


@query("SELECT s_suppkey::VARCHAR AS asset_id, s_name AS item_name FROM supplier")
def s3_renamed_columns(spark, d):
    """The second of two file names, with its old columns renamed."""
    path = tb.fresh_path(spark, "old-names")
    tb.write_table(read(spark, d, "supplier").select(F.col("s_suppkey").alias("old_id"), F.col("s_name").alias("old_name")), path, "csv")
    return tb.read_first(spark, [f"{path}-none", path], "asset_id string, item_name string", {"old_id": "asset_id", "old_name": "item_name"})


@query("SELECT n_regionkey::BIGINT AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos, n_name AS name FROM nation")
def s6_json_arrays(spark, d):
    """One file with a JSON array for each region, read back element by element; a file without an array is skipped."""
    path = tb.fresh_path(spark, "json-arrays")
    arrays = read(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey")))).alias("value"))
    arrays.withColumn("part", F.col("n_regionkey")).select("value", "part").write.partitionBy("part").text(path)
    spark.range(1).select(F.lit('{"not": "a list"}').alias("value"), F.lit(-1).alias("part")).write.partitionBy("part").mode("append").text(path)
    get = lambda name, kind: F.try_variant_get("item", f"$.{name}", kind)
    return tb.read_json_arrays(spark, path).select(get("n_regionkey", "long").alias("region"), F.col("pos").cast("long").alias("pos"), get("n_name", "string").alias("name"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS score FROM customer")
def s7_last_line_wins(spark, d):
    """Results appended twice, the later ones for a third of the keys."""
    path, own = tb.fresh_path(spark, "results"), read(spark, d, "customer").select("c_custkey")
    tb.append_jsonl(own.withColumn("score", F.lit(1)), path)
    tb.append_jsonl(own.filter("c_custkey % 3 = 0").withColumn("score", F.lit(2)), path)
    return tb.reload_jsonl(spark, path, "c_custkey long, score long", "c_custkey")


@query("SELECT s_suppkey, '의자 ' || s_name AS name FROM supplier")
def s2_mixed_folder(spark, d):
    """One folder with UTF-8 and legacy files; the character set is found for each file."""
    path, own = tb.fresh_path(spark, "mixed"), read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("의자 "), "s_name").alias("name"))
    tb.allow_all_characters(spark)
    own.filter("s_suppkey % 2 = 0").write.csv(path, header=True, encoding="cp949")
    own.filter("s_suppkey % 2 = 1").write.mode("append").csv(path, header=True)
    return tb.read_csv(spark, path, "s_suppkey long, name string")


@query("SELECT o_custkey AS key, max(o_orderkey) AS last_order FROM orders GROUP BY 1")
def s7_order_within_append(spark, d):
    """Every order appended as a line of its customer in two batches, in order: the last line wins, then what is superseded goes."""
    path, own = tb.fresh_path(spark, "lines"), read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("last_order"))
    middle = own.agg(F.avg("last_order")).first()[0]
    tb.append_jsonl(own.filter(F.col("last_order") <= middle), path, ["last_order"])
    tb.append_jsonl(own.filter(F.col("last_order") > middle), path, ["last_order"])
    tb.compact_jsonl(spark, path, "key long, last_order long", "key")
    return tb.reload_jsonl(spark, path, "key long, last_order long", "key")


@query("SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part WHERE p_size > 10")
def s9_published(spark, d):
    """A table published three times; readers see the last version whole."""
    path, own = tb.fresh_path(spark, "published"), read(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").cast("long").alias("p_size"))
    for version in (own, own.filter("p_size > 20"), own.filter("p_size > 10")):
        tb.publish_table(version, path)
    return tb.read_table(spark, path)


@query("SELECT vec_id, label, len(embedding)::BIGINT AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def s10_saved_vectors(spark, d):
    """Embedded documents saved and loaded."""
    path = tb.fresh_path(spark, "vectors")
    tb.save_vectors(read(spark, d, "embeddings"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return tb.load_vectors(spark, path).select("vec_id", "label", F.size("embedding").cast("long").alias("n"), F.round(total, 4).alias("total"))

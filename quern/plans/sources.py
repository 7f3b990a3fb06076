"""Queries that write a table through a sink and read it back through a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.base import query, r
from quern.scratch import scratch_path
from quern.sources import readers, writers


def scratch(spark, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return scratch_path(spark, name)


@query("SNK1", "SRC1", sql="SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def tsv_round_trip(t):
    path = scratch(t.spark, "nation")
    writers.write_tsv(t.nation, path)
    return readers.read_tsv(t.spark, path, "n_name")


@query("SRC10", "SNK1", sql="SELECT n_name, CASE n_nationkey % 3 WHEN 0 THEN 'mac' WHEN 1 THEN 'win' ELSE 'linux' END AS platform, CASE WHEN n_nationkey % 3 = 1 THEN 'x' END AS extra FROM nation")
def shards_round_trip(t):
    folder = scratch(t.spark, "shards")
    for k, name in enumerate(("mac", "win", "linux")):
        part = t.nation.where(f"n_nationkey % 3 = {k}").select("n_name")
        writers.write_tsv(part.withColumn("extra", F.lit("x")) if k == 1 else part, f"{folder}/speedups.{name}.tsv")
    return readers.read_shards(t.spark, folder).select("n_name", "platform", "extra")


@query("SRC11", sql="SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE 1 END AS thread, CASE WHEN n_regionkey = 1 THEN 'verify' ELSE 'optimize' END AS phase FROM nation")
def results_round_trip(t):
    path = scratch(t.spark, "results")
    thread = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")).otherwise("n/a")
    writers.write_tsv(t.nation.select("n_name", thread.alias("thread"), F.when(F.col("n_regionkey") == 1, "verify").alias("phase")), path)
    return readers.read_results(t.spark, path)


@query("SRC12", "SNK4", sql="SELECT p_partkey, p_size FROM part")
def json_round_trip(t):
    path = scratch(t.spark, "parts")
    writers.write_json_lines(t.part.select("p_partkey", "p_size"), path)
    return readers.read_json_lines(t.spark, path, "p_partkey long, p_size int")


@query("SRC13", sql="SELECT 'size ' || r_name AS key, 2e0 * r_regionkey + 1 AS value FROM region")
def log_metrics(t):
    path = scratch(t.spark, "log")
    lines = t.region.select(F.explode(F.array(F.concat(F.lit("size "), "r_name", F.lit(": "), (F.col("r_regionkey") * 2.0 + 1).cast("string"), F.lit(" s")), F.lit("no metric here"))).alias("value"))
    lines.write.text(path)
    return readers.read_log_metrics(t.spark, path).select("key", "value")


@query("SRC14", sql="SELECT 4 AS files, true AS sized")
def file_inventory(t):
    path = scratch(t.spark, "files")
    t.part.select("p_name").repartition(4).write.text(path)
    return readers.file_inventory(t.spark, path, "part-*").agg(F.count("*").alias("files"), F.bool_and(F.col("bytes") > 0).alias("sized"))


@query("SRC4", "SNK2", "SNK3", sql="SELECT n_name, 1 AS thread FROM nation UNION ALL SELECT r_name, 7 FROM region")
def append_round_trip(t):
    path = scratch(t.spark, "append")
    writers.append_rows(t.nation, path, ["n_name", "thread"], {"thread": 1})
    writers.append_rows(t.region.select(F.lit(7).alias("thread"), F.col("r_name").alias("n_name")), path, ["n_name", "thread"])
    return readers.read_columns(t.spark, path)


@query("SRC7", sql="SELECT p_brand, 'size' AS \"column\", CAST(sum(p_size) AS DOUBLE) AS value FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'price', round(sum(p_retailprice), 4) FROM part GROUP BY 1")
def long_matrix(t):
    wide = t.part.groupBy("p_brand").agg(F.sum("p_size").alias("size"), F.sum("p_retailprice").alias("price"), F.lit(0).alias("none"))
    return readers.long_matrix(wide, "p_brand").withColumn("value", r("value", 4))


@query("SRC8", sql="SELECT vec_id AS frame, CAST(i AS INT) AS atom, CAST(embedding[3 * i + 1] AS DOUBLE) AS x, CAST(embedding[3 * i + 2] AS DOUBLE) AS y, CAST(embedding[3 * i + 3] AS DOUBLE) AS z FROM embeddings, range(21) k(i)")
def long_frames(t):
    got = readers.long_frames(t.embeddings.select(F.col("vec_id").alias("frame"), F.slice("embedding", 1, 63).alias("xyz")))
    return got.select("frame", "atom", *[F.col(c).cast("double").alias(c) for c in "xyz"])


@query("SRC9")
def synthetic_traces(t):
    return readers.synthetic_traces(t.spark, 7, 3, 50)

"""Tables written in the folder that driver and executors share: they cut the lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of ids or digests (some 50 bytes each) that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 400_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Only a local session, whose driver is its
    executor, may go without: it gets a temporary one. On a cluster a missing setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.quern.scratch", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.quern.scratch", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/quern-{uuid.uuid4().hex[:12]}-{name}"


def materialize(df: DataFrame, name: str, codec: str = "zstd", **metrics: Column) -> DataFrame:
    """Write df as a table in the shared folder, compressed by a codec of Parquet, and read it back.

    The rows, and what other aggregates are asked for, are counted as they are written: see seen().
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    watch = Observation()
    df.observe(watch, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in metrics.items()]).write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern = {"path": path} | watch.get
    return out


def seen(df: DataFrame) -> dict:
    """The path, rows and metrics of a table of materialize(); empty for any other."""
    return getattr(df, "_quern", {})


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later plan reads."""
    for df in tables:
        if path := seen(df).get("path"):
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has been counted to hold no more than so many rows; else left to a shuffled join.

    Tables of materialize() were counted as they were written; any other is counted by a job of its own, up to the bound.
    """
    held = seen(df)["rows"] if seen(df) else df.limit(rows + 1).count()
    return F.broadcast(df) if held <= rows else df

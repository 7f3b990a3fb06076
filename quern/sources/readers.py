"""Readers: tab-separated tables with preambles, shards, logs of key: value lines, JSON lines, files, wide matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.scalars import platform_or_mac
from quern.registry import operator


@operator("SRC1", group="sources")
def read_tsv(spark: SparkSession, paths: str | list[str], must_contain: str | None = None) -> DataFrame:
    """A tab-separated table, plain or gzip, all columns strings, short rows filled by nulls, no quoting.

    must_contain: the header is the first line that holds it; what stands before is a preamble. A comment preamble costs
    nothing more: only the first lines are looked at on the driver, the rows are read in parallel.
    """
    paths = [paths] if isinstance(paths, str) else paths
    lines = spark.read.text(paths)
    if must_contain is None:
        header = lines.first()
    else:
        header = lines.where(F.col("value").contains(must_contain)).first()
    if header is None:
        if must_contain is None:
            raise ValueError("an empty file has no columns")
        raise ValueError(f"no line contains {must_contain!r}")
    names = header.value.split("\t")
    marked = lines.select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    heads = marked.where(F.col("value") == header.value).groupBy("__file").agg(F.min("__at").alias("__head"))
    rows = marked.join(F.broadcast(heads), "__file").where("__at > __head")
    parts = F.split("value", "\t", -1)
    return rows.select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])


@operator("SRC10", group="sources")
def read_shards(spark: SparkSession, folder: str, stem: str = "speedups", platforms: tuple[str, ...] = ("mac", "win", "other", "linux")) -> DataFrame:
    """The union of a table's shards by platform, or else its one old file; strings, with `platform` from the file's name."""
    frames = []
    for name in platforms:
        try:
            frames.append(read_tsv.fn(spark, f"{folder}/{stem}.{name}.tsv").withColumn("platform", F.lit(name)))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if not frames:
        old = read_tsv.fn(spark, f"{folder}/{stem}.tsv")
        frames = [old.withColumn("platform", platform_or_mac(F.col("platform")) if "platform" in old.columns else F.lit("mac"))]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


@operator("SRC11", group="sources")
def read_results(spark: SparkSession, path: str) -> DataFrame:
    """An iteration log addressed by its header: a missing or bad thread is 1, a missing or blank phase is optimize."""
    got = read_tsv.fn(spark, path)
    for name in ("thread", "phase"):
        if name not in got.columns:
            got = got.withColumn(name, F.lit(None).cast("string"))
    return got.withColumn("thread", F.coalesce(F.col("thread").try_cast("int"), F.lit(1))).withColumn("phase", F.coalesce(F.nullif(F.trim("phase"), F.lit("")), F.lit("optimize")))


@operator("SRC12", group="sources")
def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known schema; lines that do not parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


@operator("SRC13", group="sources")
def read_log_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of the `key: number` lines of logs; the last line of a key counts."""
    line = r"^\s*([A-Za-z_][\w .%/-]*?)\s*[:=]\s*([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*[a-zA-Z%]*\s*$"
    got = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.regexp_extract("value", line, 1).alias("key"), F.regexp_extract("value", line, 2).try_cast("double").alias("value"))
    return got.where("key <> '' and value is not null").groupBy("file", "key").agg(F.max_by("value", "at").alias("value"))


@operator("SRC14", group="sources")
def file_inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, modified) of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


@operator("SRC2", "SRC3", "SRC4", "SRC5", "SRC6", group="sources")
def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """Parquet. Matrix files of other programs (h5ad, RDS, NetCDF, npz) are converted to parquet before, by those programs."""
    return spark.read.parquet(path)


@operator("SRC7", group="sources")
def long_matrix(wide: DataFrame, row: str) -> DataFrame:
    """A wide table, one row of a matrix to a row, as (row, column, value) without zeros."""
    columns = [c for c in wide.columns if c != row]
    return wide.unpivot([row], [F.col(c).cast("double").alias(c) for c in columns], "column", "value").where("value <> 0")


@operator("SRC8", group="sources")
def long_frames(frames: DataFrame) -> DataFrame:
    """(frame, atom, x, y, z) of frames (frame, xyz): a flat array of three numbers to an atom."""
    one = F.transform(F.sequence(F.lit(0), (F.size("xyz") / 3).cast("int") - 1), lambda i: F.struct(i.alias("atom"), *[F.get(F.col("xyz"), 3 * i + j).alias(c) for j, c in enumerate("xyz")]))
    return frames.where("size(xyz) >= 3").select("frame", F.explode(one).alias("p")).select("frame", "p.*")


@operator("SRC9", group="sources")
def synthetic_traces(spark: SparkSession, seed: int, n_traces: int, n_samples: int, rate: float = 100.0) -> DataFrame:
    """(trace_id, samples): two sines and noise from a hash of seed, trace and place; the same in every run and partitioning."""
    noise = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.col("trace_id"), i), F.lit(2_000_001)) - 1_000_000) / 1e7
    sample = lambda i: F.sin(2 * 3.141592653589793 * 5 * i / rate) + 0.5 * F.sin(2 * 3.141592653589793 * 40 * i / rate) + noise(i)
    return spark.range(n_traces).select(F.col("id").alias("trace_id")).withColumn("samples", F.transform(F.sequence(F.lit(0), F.lit(n_samples - 1)), sample))


def file_order(df: DataFrame) -> DataFrame:
    """df with `file_pos`, which grows along each file in the order of reading."""
    return df.withColumn("file_pos", F.monotonically_increasing_id())


def first_by_file(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key in file order."""
    return file_order(df).withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy("file_pos"))).where("__n = 1").drop("__n", "file_pos")

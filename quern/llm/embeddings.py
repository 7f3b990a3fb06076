"""Near-duplicate vectors of a label by sign hashing, exact cosine and connected components.

Vectors of one label and length whose bytes are equal form a class; the smallest id stands for it. A class has one
bucket in each of several tables: the signs of its products with `bits` random hyperplanes. Both numbers follow from the
count of vectors (see plan): a pair at the threshold shares no bucket with a chance of MISS at most. Members of a
bucket are compared exactly, in double precision, in blocks of BLOCK x BLOCK that different tasks take; a task sends on
counts of links and a spanning forest, never the pairs. A pair that shares several buckets counts in the first table only.

Vectors that are null, empty, zero, or hold null or non-finite components, and those without a label, link with nothing.
Rows that repeat an id count as vectors; ids of the result repeat with them. A null id links with nothing and has a null
component. Other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import array_groups, materialize, small_batches
from quern.llm.components import components

THRESHOLD, MISS, BLOCK = 0.98, 1e-6, 1024


def plan(vectors: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits, tables): about 64 unrelated vectors to a bucket at most, and a chance of MISS to lose a pair at the threshold."""
    bits = max(16, math.ceil(math.log2(max(vectors, 1) / 64)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - same))


@cache
def _planes(dims: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([dims, bits, tables]).standard_normal((dims, bits * tables))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hashed(bits: int, tables: int, kind: type):
    power = np.left_shift(np.uint64(1), np.arange(bits, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, keys, vectors, signs = [], [], [], [], []
            by_size: dict[int, list[tuple[int | None, int, np.ndarray]]] = {}
            for i, label, v in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x = None
                if i is not None and label is not None and v and None not in v:
                    x = np.array(v, np.float64)
                    x = x if np.isfinite(x).all() and x.any() else None
                if x is None:
                    ids.append(i)
                    labels.append(label)
                    keys.append(None)
                    vectors.append(None)
                    signs.append(None)
                else:
                    by_size.setdefault(len(x), []).append((i, label, x))
            for size, rows in by_size.items():
                x = np.stack([r[2] for r in rows])
                positive = (_unit(x) @ _planes(size, bits, tables) >= 0).reshape(len(rows), tables, bits)
                values = (positive * power).sum(2, dtype=np.uint64)
                for (i, label, v), sign in zip(rows, values, strict=True):
                    ids.append(i)
                    labels.append(label)
                    vectors.append(v.astype(kind).tobytes())
                    keys.append(xxhash.xxh3_128_digest(f"{label}:".encode() + vectors[-1]))
                    signs.append(sign.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary()), pa.array(signs, pa.binary())], names=["id", "label", "key", "vector", "signs"])

    return run


def _forest(linked: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each, in a symmetric matrix of links."""
    at = np.arange(len(linked))
    while True:
        low = np.minimum(at, np.where(linked, at[None, :], len(at)).min(1, initial=len(at)))
        low = low[low]
        if (low == at).all():
            return at
        at = low


def _met(signs: np.ndarray, i: np.ndarray, j: np.ndarray, turn: int) -> np.ndarray:
    """Of pairs, whether they share a bucket of a table before this one."""
    met = np.zeros(len(i), bool)
    for start in range(0, len(i), 65536):
        at = slice(start, start + 65536)
        met[at] = (signs[i[at], :turn] == signs[j[at], :turn]).any(1)
    return met


def _compare(threshold: float, tables: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        for group in array_groups(batches, ["bucket", "pair"], ["pair", "blocks", "turn", "own", "id", "copies", "vector", "signs"]):
            own, ids, copies, turn = group["own"], group["id"], group["copies"], int(group["turn"][0])
            if len(ids) < 2:
                continue
            x = _unit(np.frombuffer(b"".join(group["vector"]), kind).reshape(len(ids), -1).astype(np.float64))
            linked = x @ x.T >= threshold
            low, high = divmod(int(group["pair"][0]), int(group["blocks"][0]))
            if low != high:
                linked &= own[:, None] != own[None, :]
            i, j = np.nonzero(np.triu(linked, 1))
            if not len(i):
                continue
            signs = np.frombuffer(b"".join(group["signs"]), np.uint64).reshape(len(ids), tables)
            first = ~_met(signs, i, j, turn)
            n = np.bincount(i[first], copies[j[first]], len(ids)) + np.bincount(j[first], copies[i[first]], len(ids))
            np.fill_diagonal(linked, False)
            to = _forest(linked)
            some = (n > 0) | (to != np.arange(len(to)))
            out.append((ids[some], n[some].astype(np.int64), ids[to[some]]))
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id", "n", "to"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id", "n", "to"])

    return run


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of vectors: id_col, n_links (other rows linked directly), component_id (smallest id), kept."""
    small_batches(vectors.sparkSession)
    bits, tables = plan(vectors.count(), threshold)
    # Vectors travel as they are stored, and are compared in double precision.
    kind = np.float32 if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull) else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    hashed = materialize(rows.mapInArrow(_hashed(bits, tables, kind), "id long, label string, key binary, vector binary, signs binary"), "lsh-hashed")
    classes = materialize(hashed.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "lsh-classes")
    reps = hashed.withColumnRenamed("id", "rep").join(classes, ["key", "rep"]).dropDuplicates(["key"]).select(F.col("rep").alias("id"), "label", "copies", "vector", "signs")
    reps = materialize(reps, "lsh-reps")

    turns = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.xxhash64(t, "label", F.length("vector"), F.substring("signs", 8 * t + 1, F.lit(8)))))
    members = reps.select("id", "label", "signs", "vector").select("id", turns.alias("turn", "bucket"))
    # Written before it is joined: Spark splits a hot key's partition in a join of two plain exchanges only.
    sizes = materialize(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "lsh-sizes")
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    met = members.join(sizes, "bucket").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = met.withColumn("other", other).withColumn("pair", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    full = met.join(reps.select("id", "copies", "vector", "signs"), "id").select("bucket", "pair", "blocks", "turn", "own", "id", "copies", "vector", "signs")
    found = full.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair", "id").mapInArrow(_compare(threshold, tables, kind), "id long, n long, to long")
    found = materialize(found, "lsh-found")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    labels = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")), "lsh-cc").withColumnRenamed("node", "id")
    placed = classes.withColumnRenamed("rep", "id").join(counts, "id", "left").join(labels, "id", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = hashed.select("id", "key").join(placed, "key", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op4_embedding_lsh(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Every pair of a label; for small tables.
OP4_SQL = """
WITH v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_sum([x * x FOR x IN e])) AS size FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM r JOIN pairs p ON r.b = p.a) SELECT a, min(b) AS b FROM r GROUP BY a),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(links.n, 0) AS n_links, least(v.vec_id, coalesce(reach.b, v.vec_id)) AS component_id, v.vec_id <= coalesce(reach.b, v.vec_id) AS kept
FROM v LEFT JOIN links ON v.vec_id = links.a LEFT JOIN reach ON v.vec_id = reach.a
"""

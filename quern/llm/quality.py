"""Quality by nearest-neighbour voting in a latent-semantic space.

The fit takes a bounded sample of labelled rows (FIT_ROWS, by a keyed hash of the id), weighs hashed features of their
texts by tf-idf and finds DIMS latent directions by a randomized SVD with fixed seeds. Projection and labelled vectors,
about 2 MB whatever the corpus holds, are broadcast. Every document is projected in blocks, compared with every labelled
vector by exact cosine, and scored by the labels of its K nearest, weighted by a power of the similarity.

Features of a text are its words, their shapes (case, digits, marks at the end) and repetitions of the last word; label,
language, source and id are no features. A null or empty text, or one without any known feature, scores the labelled
share of 1. Ties among neighbours go to the smaller position. Without labelled rows every score is 0.5. Rows may repeat;
a label counts once per labelled row; null labels are not fitted. Clashing column names held_out, score, predicted are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import batched, raw_texts, small_batches

#: Labelled rows fitted at most; hashed words, shapes; latent directions; neighbours; the score from which a text is good.
FIT_ROWS, WORDS, SHAPES, DIMS, K, CUT = 4000, 3072, 512, 64, 15, 0.3
#: The power of the cosine by which a neighbour's label counts.
SHARPNESS = 8
FEATURES = WORDS + SHAPES
BLOCK = 256


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class Features(dict):
    """Of a word, its hashed feature and its shape's, as one number; kept while they fit a bounded table."""

    SHAPE = ((re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"))

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        shape = word
        for what, by in self.SHAPE:
            shape = what.sub(by, shape)
        self[word] = value = xxhash.xxh64_intdigest(word) % WORDS | (WORDS + xxhash.xxh64_intdigest(shape[-3:]) % (SHAPES - 1)) << 16
        return value

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Sublinear counts by text and feature."""
        cells = []
        for i, text in enumerate(texts):
            words = text.split()
            both = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            again = int(np.count_nonzero(both[1:] == both[:-1]))
            cells += [i * FEATURES + (both & 0xFFFF), i * FEATURES + (both >> 16), np.full(again, (i + 1) * FEATURES - 1)]
        found = np.bincount(np.concatenate(cells), minlength=len(texts) * FEATURES) if cells else np.zeros(0)
        return np.log1p(found.reshape(len(texts), FEATURES).astype(np.float32))


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


class Model:
    """Fitted to counts, which it overwrites (the driver's memory holds them once), by labels 0 and 1."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        n = len(labels)
        self.idf = np.log((1 + n) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
        x = counts
        x *= self.idf
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
        dims = min(DIMS, n, FEATURES)
        probe = np.random.default_rng(7).standard_normal((FEATURES, min(dims + 16, FEATURES))).astype(np.float32)
        span = x @ probe
        for _ in range(4):
            span = x @ (x.T @ np.linalg.qr(span)[0])
        base = np.linalg.qr(span)[0]
        self.directions = np.ascontiguousarray(np.linalg.svd(base.T @ x, full_matrices=False)[2][:dims].T)
        self.known = _unit(x @ self.directions)

    def score(self, counts: np.ndarray) -> np.ndarray:
        n = len(self.labels)
        if not n:
            return np.full(len(counts), self.prior)
        at = _unit(_unit(counts * self.idf) @ self.directions)
        cosine = at @ self.known.T
        k = min(K, n)
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** SHARPNESS
        total = weight.sum(1)
        return np.where(total > 0, (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12), self.prior)


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = Features()
    for batch in batched(batches, "text", rows=BLOCK):
        rows = []
        for row in table.counts(raw_texts(batch, "text")):
            at = np.flatnonzero(row)
            rows.append(at.astype(np.uint16).tobytes() + row[at].astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("quality")], names=["counts", "quality"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Model:
    """The model of at most `rows` labelled rows that are not held out. Their features, not their texts, reach the driver."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64(F.lit("fit"), "__id"), "__id").limit(rows)
    sample = docs.select(F.col(id_col).alias("__of"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("__of") == F.col("__id")).select("__id", "text", "quality").orderBy("__id", F.xxhash64("text"))
    got = sample.limit(rows).select("text", "quality").mapInArrow(_featurize, "counts binary, quality int").toArrow()
    counts = np.zeros((got.num_rows, FEATURES), np.float32)
    for row, packed in zip(counts, got.column("counts").to_pylist(), strict=True):
        half = len(packed) // 2
        row[np.frombuffer(packed[:half], np.uint16)] = np.frombuffer(packed[half:], np.float16)
    return Model(counts, got.column("quality").to_numpy().astype(np.float32))


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with score and predicted; all other columns stay."""
    small_batches(docs.sparkSession)
    kept = docs.select(*[c for c in docs.columns if c not in ("score", "predicted") or c == text_col])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Features()
        for batch in batched(batches, text_col, rows=BLOCK):
            got = shared.value.score(table.counts(raw_texts(batch, text_col))).astype(np.float64).clip(0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got), pa.array((got >= CUT).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return kept.mapInArrow(run, schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

"""Shared plumbing of the corpus operators: batches of bounded bytes, word splitting and hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quern.scratch import bounded, materialize, release, seen, shared_folder  # noqa: F401
from quern.workers import ship

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Have Spark pass Python workers BATCH_BYTES at a time where nothing else has been set, whatever the rows hold: a worker
    shares its executor's memory with others. Workers get this package if they lack it."""
    ship(spark)
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class WordHash(dict):
    """64-bit hashes of words, kept while they fit a bounded table."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            pair.append(np.multiply.accumulate(steps))
        _POWERS[base] = have = (pair[0], pair[1])
    return have


def gram_hashes(hashes: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive word hashes, by prefix sums of a polynomial modulo 2**64."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _powers(n + 1, base)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * down[: n - k + 1])


def batched(batches: Iterator[pa.RecordBatch], column: str, most: int = 3 << 20, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about so many bytes of the named column at most, so a worker's memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, done + most, "right"))
            stop = min(max(stop, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def _raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist() if not pa.types.is_binary(column.type) else column.to_pylist()


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's UTF-8 bytes; null is empty."""
    return [x if x is not None else b"" for x in _raw(batch.column(column))]


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys in a sorted partition, across batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def array_groups(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The same as arrays by column name; cheaper where groups are small."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in {*keys, *columns}}
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= now[k][1:] != now[k][:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if held is not None and all(held[k][0] == now[k][0] for k in keys):
            now = {c: np.concatenate([held[c], v]) for c, v in now.items()}
            starts = [0, *(s + len(held[keys[0]]) for s in starts[1:])]
        elif held is not None:
            yield held
        for a, b in zip(starts[:-2], starts[1:-1], strict=True):
            yield {c: v[a:b] for c, v in now.items()}
        held = {c: v[starts[-2] :] for c, v in now.items()}
    if held is not None:
        yield held


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

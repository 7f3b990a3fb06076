"""MinHash near-duplicates: universal hash minima, banding, signature and exact verification, components by star rounds.

A document's set holds the distinct shingles of K words (A-Z lower-cased); a shorter one is a single shingle. Two sets are
linked if their Jaccard similarity is at least PERCENT / 100. Sets that are equal form a class, and only the smallest id
of each class goes on.

1. One scan makes the minima of HASHES universal hashes (a x + b modulo 2**32) and a digest of each set.
2. Bands of ROWS minima are bucket keys. Each member of a bucket is paired with the bucket's smallest id, its hub: a
   bucket makes as many pairs as it has members, never their square.
3. Pairs pass if their signatures agree on ESTIMATE of the minima (five standard errors below the threshold), then if
   the full sets, made again from the whole texts, reach the similarity. Links give components.
4. Where a bucket still holds several components, members outside its hub's component are compared with all others of
   the bucket, by signature and then on full sets, in tasks of two blocks of BLOCK members or BLOCK_BYTES of shingles each. A task sends on the
   links that join components, never the pairs. So no link between candidates is lost, and pairs within a component
   found before are not tried.

A pair at the threshold misses every band with a chance of (1 - 0.75**4)**24 = 0.0001.

Null or blank texts have an empty set and link with nothing. Rows with a null id link with nothing, their component is
null and they are kept. Rows that repeat an id and text are one document; of an id with different texts, one text
is linked through (that of the smallest digest). Very long texts are read whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WordHash, batched, bounded, gram_hashes, groups_of, materialize, raw_texts, small_batches
from quern.llm.components import components

K, PERCENT, HASHES, ROWS, ESTIMATE = 5, 75, 96, 4, 0.52
BANDS = HASHES // ROWS
#: Members of a bucket that are compared in one block, and bytes of their shingles, on average at most.
BLOCK, BLOCK_BYTES = 512, 16 << 20

_rng = np.random.default_rng(20240501)
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]


def shingle_set(text: bytes, table: WordHash, k: int = K) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    words = text.lower().split()
    if len(words) >= k:
        return np.unique(gram_hashes(table.of(words), k))
    if words:
        return gram_hashes(table.of(words), len(words)) ^ np.uint64(len(words))
    return np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    minima = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 2048):
        np.minimum(minima, (_A * low[start : start + 2048] + _B).min(1), out=minima)
    return minima


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = WordHash()
    for batch in batched(batches, "text"):
        sizes, keys, minima = [], [], []
        for text in raw_texts(batch, "text"):
            shingles = shingle_set(text, table)
            sizes.append(len(shingles))
            keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            minima.append(signature(shingles).tobytes() if len(shingles) else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(minima, pa.binary())], names=["id", "n", "key", "minima"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = WordHash()
    for batch in batched(batches, "text", 4 << 20):
        sets = [shingle_set(x, table) for x in raw_texts(batch, "text")]
        same = [i for i, (s, key) in enumerate(zip(sets, batch.column("key").to_pylist(), strict=True)) if xxhash.xxh3_128_digest(s.tobytes()) == key]
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(same, pa.int64())), pa.array([sets[i].tobytes() for i in same], pa.binary())], names=["id", "shingles"])


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < PERCENT * len(y):
        return False
    both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)
        keep = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in pairs]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("left", "right"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array((x == y).mean(1) >= ESTIMATE))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links between components in one task of a bucket: members inside the hub's component against others, or
    two blocks of others. Once two components are joined here, no more of their pairs are tried."""
    for group in groups_of(batches, ["bucket", "task"]):
        ids, comps, own = (group.column(c).to_numpy() for c in ("id", "comp", "own"))
        band, hub, hub_comp, kind = (group.column(c)[0].as_py() for c in ("band", "hub", "hub_comp", "kind"))
        minima = np.frombuffer(b"".join(group.column("minima").to_pylist()), np.uint32).reshape(-1, HASHES)
        sets = group.column("shingles")
        minor = np.flatnonzero(comps != hub_comp)
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while x in above:  # noqa: B023
                x = above[x]  # noqa: B023
            return x

        found = []
        for start in range(0, len(minor), 128):
            rows = minor[start : start + 128]
            alike = np.zeros((len(rows), len(ids)), np.int16)
            for h in range(HASHES):
                alike += minima[rows, h][:, None] == minima[None, :, h]
            tried = (alike >= ESTIMATE * HASHES) & (comps[rows][:, None] != comps[None, :]) & (ids[rows][:, None] != hub) & (ids[None, :] != hub)
            # Kind 0: against the hub's component. Others meet each other within a block (1) or between two (2).
            tried &= (comps == hub_comp)[None, :] if kind == 0 else ids[rows][:, None] < ids[None, :] if kind == 1 else own[rows][:, None] < own[None, :]
            i, j = np.nonzero(tried)
            # A pair is tried in the first bucket that it shares.
            first = ~(minima[rows[i]].reshape(-1, BANDS, ROWS)[:, :band] == minima[j].reshape(-1, BANDS, ROWS)[:, :band]).all(2).any(1)
            i, j = i[first], j[first]
            for k in np.argsort(-alike[i, j], kind="stable").tolist():
                x, y = int(rows[i[k]]), int(j[k])
                p, q = top(int(comps[x])), top(int(comps[y]))
                if p != q and _similar(np.frombuffer(sets[x].as_py(), np.uint64), np.frombuffer(sets[y].as_py(), np.uint64)):
                    above[max(p, q)] = min(p, q)
                    found.append((int(comps[x]), int(comps[y])))
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _both(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with the column of either side as left and right."""
    right = pairs.join(values.select(F.col("id").alias("b"), F.col(column).alias("right")), "b")
    return right.join(values.select(F.col("id").alias("a"), F.col(column).alias("left")), "a").select("a", "b", "left", "right")


def _sets(ids: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """(id, shingles) of the ids (id, key)."""
    wanted = bounded(materialize(ids, f"{name}-ids"))
    return materialize(docs.join(wanted, "id").select("id", "key", "text").mapInArrow(_full_sets, "id long, shingles binary"), f"{name}-sets")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the smallest id reachable), kept."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = materialize(texts.mapInArrow(_sketch, "id long, n long, key binary, minima binary"), "minhash-sketches")
    classes = sketches.where("id is not null and key is not null").groupBy("key").agg(F.min("id").alias("rep"))
    classes = materialize(classes, "minhash-classes")
    keys = classes.groupBy(F.col("rep").alias("id")).agg(F.min("key").alias("key"))
    reps = materialize(sketches.join(keys, ["id", "key"], "left_semi").dropDuplicates(["id"]).select("id", "key", "n", "minima"), "minhash-reps")

    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("minima", b * 4 * ROWS + 1, F.lit(4 * ROWS))))
    members = reps.select("id", "n", F.posexplode(band).alias("band", "bucket"))
    # Written before they are joined: Spark splits a hot key's partition in a join of two plain exchanges only.
    hubs = materialize(members.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1"), "minhash-hubs")
    inside = materialize(members.join(hubs, "bucket"), "minhash-buckets")
    stars = inside.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    alike = materialize(_both(stars, reps, "minima").mapInArrow(_agree, "a long, b long"), "minhash-pairs")
    known = reps.select("id", "key")
    sets = _sets(alike.select(F.col("a").alias("id")).union(alike.select("b")).distinct().join(known, "id"), texts, "minhash-stars")
    links = materialize(_both(alike, sets, "shingles").mapInArrow(_verify, "a long, b long"), "minhash-links")
    labels = materialize(components(links, "minhash-cc"), "minhash-labels")

    # Buckets that still hold more than one component, and whose hub has not met all pairs.
    placed = inside.where("size > 2").join(labels.withColumnRenamed("node", "id"), "id", "left").select("bucket", "band", "id", "n", "hub", F.coalesce("component", "id").alias("comp"))
    # The weight of a member, so that a block of weight 1 is within both bounds.
    weight = F.greatest(F.lit(1 / BLOCK), F.col("n") * 8 / BLOCK_BYTES)
    parts = placed.groupBy("bucket", "comp").agg(F.sum(weight).alias("n"), F.min("id").alias("least"))
    blocks = lambda n: F.greatest(F.ceil(n).cast("long"), F.lit(1).cast("long"))
    torn = parts.groupBy("bucket").agg(F.count("*").alias("comps"), F.min_by("comp", "least").alias("hub_comp"), F.min_by("n", "least").alias("n_major"), F.sum("n").alias("size")).where("comps > 1")
    torn = torn.withColumn("n_minor", F.col("size") - F.col("n_major")).select("bucket", "hub_comp", blocks("n_major").alias("majors"), blocks("n_minor").alias("minors"))
    torn = materialize(torn, "minhash-tears")
    rest = placed.drop("n").join(torn, "bucket")
    major = F.col("comp") == F.col("hub_comp")
    own = F.pmod(F.xxhash64("id"), F.when(major, F.col("majors")).otherwise(F.col("minors")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    # Tasks of a bucket: a block inside the hub's component and one outside, or two blocks outside.
    inner = F.transform(upto("minors"), lambda c: F.struct((F.col("own") * F.col("minors") + c).alias("task"), F.lit(0).alias("kind")))
    outer = F.concat(
        F.transform(upto("majors"), lambda i: F.struct((i * F.col("minors") + F.col("own")).alias("task"), F.lit(0).alias("kind"))),
        F.transform(upto("minors"), lambda c: F.struct((F.col("majors") * F.col("minors") + F.least("own", c) * F.col("minors") + F.greatest("own", c)).alias("task"), F.when(F.col("own") == c, 1).otherwise(2).alias("kind"))),
    )
    rest = materialize(rest.withColumn("own", own), "minhash-torn")
    more = _sets(rest.select("id").distinct().join(known, "id"), texts, "minhash-late")
    full = rest.join(reps.select("id", "minima").join(more, "id"), "id").withColumn("t", F.explode(F.when(major, inner).otherwise(outer)))
    full = full.select("bucket", "t.task", F.col("t.kind").alias("kind"), "band", "own", "id", "hub", "comp", "hub_comp", "minima", "shingles")
    late = full.repartition("bucket", "task").sortWithinPartitions("bucket", "task", "id").mapInArrow(_across, "a long, b long")
    merged = components(materialize(late, "minhash-late"), "minhash-merge").select(F.col("node").alias("component"), F.col("component").alias("merged"))
    every = reps.select(F.col("id").alias("node")).join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    final = every.join(merged, "component", "left").select(F.col("node").alias("rep"), F.coalesce("merged", "component").alias("component_id"))
    # A class is linked through its smallest id, unless that id stands for another text.
    placed_classes = classes.join(keys.withColumnRenamed("id", "rep"), ["rep", "key"], "left_semi").join(final, "rep").select("key", "component_id").union(classes.join(keys.withColumnRenamed("id", "rep"), ["rep", "key"], "left_anti").select("key", "rep"))
    out = sketches.select("id", "n", "key").join(placed_classes, "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs that share a shingle, and what they reach; for small tables.
OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
g AS (SELECT doc_id, n, i, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS s FROM p),
s AS (SELECT DISTINCT doc_id, s FROM g WHERE i <= greatest(n - 5, 0)), k AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE 100 * c >= 75 * (x.k + y.k - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT w.doc_id, coalesce(k, 0) AS n_shingles, least(w.doc_id, coalesce(b, w.doc_id)) AS component_id, w.doc_id <= coalesce(b, w.doc_id) AS kept
FROM w LEFT JOIN k ON w.doc_id = k.doc_id LEFT JOIN reach ON w.doc_id = a
"""

"""Media columns in a store of content-defined chunks.

A payload becomes a medium: a binary PGM image of 8-bit samples, WIDTH to a row. The medium is cut where a rolling gear
hash over the last 32 bytes has CUT_BITS zero bits, so that equal passages make equal chunks wherever they stand; chunks
hold MIN_CHUNK to MAX_CHUNK bytes. A medium is stored as the ordered list of its chunks' digests (SHA-256, 16 bytes kept),
and each distinct chunk once, with the medium that owns it.

Owners come from joins on digests: media of equal content have one stored form; of a chunk that several media have, the
smallest digest of a medium owns it. A medium lies in the store as a row of its list and the chunks it owns; only chunks that
others refer to, and the few media that refer to them, are shuffled when media are read back. What is read is put together
in the order of the list, each chunk compared with its digest and the whole with the medium's, and an error raised where one
differs.

A null text has an empty payload, padded like any other to a row of blanks. Long texts are stored whole. Rows that repeat
are stored once. Equal texts have equal values. Other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import batched, bounded, materialize, seen, small_batches

#: Shared places whose list may be broadcast (some 40 MB).
MARKS = 1_000_000
WIDTH, CUT_BITS, MIN_CHUNK, MAX_CHUNK = 192, 11, 256, 16384
GEAR = np.random.default_rng(20240501).integers(0, 1 << 32, 256, dtype=np.uint32)


def medium(text: Column) -> Column:
    """The PGM file of a text's UTF-8 bytes, padded by blanks to whole rows, one at least."""
    payload = F.coalesce(text, F.lit("")).cast("binary")
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(payload) / WIDTH)).cast("int")
    header = F.concat(F.lit(f"P5\n{WIDTH} "), rows.cast("string"), F.lit("\n255\n")).cast("binary")
    return F.concat(header, payload, F.call_function("repeat", F.lit(" "), (rows * WIDTH - F.octet_length(payload)).cast("int")).cast("binary"))


def samples(image: bytes) -> bytes:
    """The samples of a PGM file made by medium()."""
    magic, size, most, data = image.split(b"\n", 3)
    width, rows = map(int, size.split())
    if magic != b"P5" or most != b"255" or len(data) != width * rows:
        raise ValueError("not a PGM file of 8-bit samples")
    return data


def cuts(data: bytes) -> list[int]:
    """The ends of a medium's chunks."""
    size = len(data)
    gear = GEAR[np.frombuffer(data, np.uint8)]
    for shift in (1, 2, 4, 8, 16):
        gear[shift:] = gear[shift:] + (gear[:-shift] << np.uint32(shift))
    marks = np.flatnonzero(gear >> np.uint32(32 - CUT_BITS) == 0) + 1
    ends, begin = [], 0
    for mark in marks.tolist():
        while mark - begin > MAX_CHUNK:
            begin += MAX_CHUNK
            ends.append(begin)
        if mark - begin >= MIN_CHUNK:
            begin = mark
            ends.append(begin)
    while size - begin > MAX_CHUNK:
        begin += MAX_CHUNK
        ends.append(begin)
    if begin < size or not ends:
        ends.append(size)
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batched(batches, "medium"):
        lists = [[digest(c) for c in chunks(m)] for m in batch.column("medium").to_pylist()]
        names = [x for x in batch.schema.names if x != "medium"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(lists, pa.list_(pa.binary()))], names=[*names, "chunks"])


STORED = "sha binary, complete boolean, chunks array<binary>, own array<struct<digest: binary, shared: boolean, data: binary>>"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A medium's list and the chunks that it owns. absent: places of chunks that it does not own, or owns at another place;
    lent: places of those that others refer to. A medium is complete if all of its list is its own."""
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("shared", pa.bool_()), ("data", pa.binary())]))
    for batch in batched(batches, "medium"):
        lists, own, complete = [], [], []
        for m, absent, lent in zip(batch.column("medium").to_pylist(), batch.column("absent").to_pylist(), batch.column("lent").to_pylist(), strict=True):
            gone, given, parts = set(absent or ()), set(lent or ()), chunks(m)
            lists.append([digest(c) for c in parts])
            own.append([{"digest": lists[-1][i], "shared": i in given, "data": c} for i, c in enumerate(parts) if i not in gone])
            complete.append({c["digest"] for c in own[-1]}.issuperset(lists[-1]))
        yield pa.RecordBatch.from_arrays([batch.column("sha"), pa.array(complete), pa.array(lists, pa.list_(pa.binary())), pa.array(own, kind)], names=["sha", "complete", "chunks", "own"])


READ = "sha binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature(data: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the highest of four sample ranges' shares."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts[counts > 0] / len(data)
    mean = float((counts * np.arange(256)).sum() / len(data))
    deviation = float(np.sqrt((counts * (np.arange(256) - mean) ** 2).sum() / len(data)))
    return f"mean={mean:.6f};std={deviation:.6f};entropy={-(share * np.log2(share)).sum():.6f};ranges={','.join(f'{x / len(data):.6f}' for x in counts.reshape(4, 64).sum(1))}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for sha, listed, parts in zip(batch.column("sha").to_pylist(), batch.column("chunks"), batch.column("parts"), strict=True):
            held = {p["digest"]: p["data"] for p in parts.as_py()}
            order = listed.as_py()
            image = b"".join(held.get(d, b"") for d in order)
            if any(d not in held or digest(held[d]) != d for d in set(order)) or hashlib.sha256(image).digest() != sha:
                raise ValueError(f"the chunks of medium {sha.hex()} do not make it up")
            data = samples(image)
            rows.append((sha, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(image), sha.hex(), feature(data)))
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])


def list_media(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, n_bytes, sha, chunks: ordered digests) of the texts' media, one row per row of docs."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    media = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), medium(F.col(text_col)).alias("medium"))
    media = media.select("id", "n_bytes", F.unhex(F.sha2("medium", 256)).alias("sha"), "medium")
    return materialize(media.mapInArrow(_list, f"id {id_type}, n_bytes long, sha binary, chunks array<binary>"), "media-lists")


def store_media(docs: DataFrame, listed: DataFrame, *, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The store of the media of list_media(): refs (sha, digest) of chunks that another medium owns, and the stored rows (sha,
    complete, chunks, own)."""
    media = docs.select(medium(F.col(text_col)).alias("medium")).withColumn("sha", F.unhex(F.sha2("medium", 256)))
    places = listed.select("sha", "chunks").dropDuplicates(["sha"]).select("sha", F.posexplode("chunks").alias("at", "digest"))
    # Of each digest that occurs more than once, its owner and the owner's first place of it. Written before it is joined: Spark
    # splits a hot key's partition in a join of two plain exchanges only.
    owners = places.groupBy("digest").agg(F.min(F.struct("sha", "at")).alias("o"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("o.sha").alias("owner"), F.col("o.at").alias("owner_at"))
    shared = materialize(places.join(materialize(owners, "media-owners"), "digest"), "media-shared")
    owned = (F.col("sha") == F.col("owner")) & (F.col("at") == F.col("owner_at"))
    marks = shared.groupBy("sha").agg(F.collect_list(F.when(~owned, F.col("at"))).alias("absent"), F.collect_list(F.when(owned, F.col("at"))).alias("lent"))
    # Broadcast only if their places, four bytes each, and digests of media are counted to be few.
    few = seen(shared)["rows"] <= MARKS
    marks = materialize(marks, "media-marks")
    marks = F.broadcast(marks) if few else marks
    # One row of each medium is stored: repeats are dropped by a join on the digests of media that have any.
    repeated = listed.groupBy("sha").agg(F.count("*").alias("n")).where("n > 1").select("sha")
    stored = media.join(marks, "sha", "left")
    again = bounded(materialize(repeated, "media-repeated"), 200_000)
    once = stored.join(again, "sha", "left_anti").mapInArrow(_store, STORED)
    more = media.join(again, "sha", "left_semi").dropDuplicates(["sha"]).join(marks, "sha", "left").mapInArrow(_store, STORED)
    rows = materialize(once.union(more), "media-store")
    return shared.where("sha <> owner").select("sha", "digest").distinct(), rows


def read_media(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """Every stored medium, read back by its list, with its features."""
    part = lambda c: F.struct(c["digest"].alias("digest"), c["data"].alias("data"))
    own = rows.select("sha", "complete", "chunks", F.transform("own", part).alias("parts"))
    lent = rows.select(F.explode(F.filter("own", lambda c: c["shared"])).alias("c")).select("c.digest", "c.data")
    fetched = refs.join(lent, "digest").groupBy("sha").agg(F.collect_list(F.struct("digest", "data")).alias("more"))
    torn = own.where("not complete").join(fetched, "sha", "left").select("sha", "chunks", F.concat("parts", F.coalesce("more", F.slice("parts", 1, 0))).alias("parts"))
    return own.where("complete").select("sha", "chunks", "parts").mapInArrow(_read, READ).union(torn.mapInArrow(_read, READ))


def media_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes, and what reading its stored medium back gives."""
    listed = list_media(docs, id_col=id_col, text_col=text_col)
    read = materialize(read_media(*store_media(docs, listed, text_col=text_col)), "media-read")
    return listed.select("id", "n_bytes", "sha").join(read, "sha").select(F.col("id").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op3_media_chunks(spark, sf_dir: str) -> DataFrame:
    return media_column(spark.read.parquet(f"{sf_dir}/documents.parquet"))

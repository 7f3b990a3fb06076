"""Removal of passages that an earlier document has too: seed and extend.

A passage is a window of SPAN consecutive words. Seeds: the winnowed K-word anchors of each document, of each window the
K-gram of the smallest hash, so equal windows have equal anchors at the same place. Documents are joined on anchors with the
first holder, the place of the anchor in the document of the smallest id. Extension: the words around the anchor are
compared with the holder's, one by one, to both sides as long as they agree; what agrees is a maximal repeat, and where it is
at least SPAN words long its words are removed. The holder's words come in segments of SEGMENT words, each fetched once.

A window of an anchor may be missing at its first holder's and still stand in another earlier document. Such windows go on
by the 35 words to either side of the anchor, then whole, by a SHA-256 of their words (16 bytes kept), each only if more than one
document has it, and meet the smallest document that has the same. Documents with the same words there go on as one before
anything is joined, and places of a document with the same words (a word pair over and over) as one row. So nothing is lost,
and text that is shared costs no row by window.

Texts of equal words form a class: the smallest id goes on, and the others are removed whole (if SPAN words long). No
pairs of documents are made: an anchor costs one row for each place that has it, however many share it.

Null or blank texts have no words. Rows with a null id keep their words and cause no removal. Rows that repeat an id are
judged one by one; an id does not cause removal in itself. Very long texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WordHash, batched, bounded, gram_hashes, materialize, raw_texts, release, small_batches

SPAN, K, SEGMENT = 50, 20, 64
#: K-grams in a window, words of a window beyond its anchor, and those of them that a half takes.
GRAMS, REACH, HALF = SPAN - K + 1, SPAN - K, (SPAN - K) // 2
EMPTY = hashlib.sha256(b"").hexdigest()
SEEDS = "array<struct<key:bigint,at:int,lo:int,hi:int>>"
_SEED = pa.struct([("key", pa.int64()), ("at", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])
_SPARE = pa.struct([("key", pa.int64()), ("los", pa.list_(pa.int32())), ("words", pa.binary())])


def seeds(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, and the first and last of the windows that it is chosen for: the leftmost smallest."""
    low = gram_hashes(hashes, K)
    if len(low) < GRAMS:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    at, width = np.arange(len(low)), 1
    while width < GRAMS:
        step = min(width, GRAMS - width)
        right = low[step:] < low[:-step]
        low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
        width += step
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return low[start], at[start], start, np.r_[start[1:], len(at)] - 1


def _unit(digest: bytes) -> int:
    """Tells texts of one id apart."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = WordHash()
    for batch in batched(batches, "text"):
        sizes, digests, parts, ends = [], [], [], [0]
        for text in raw_texts(batch, "text"):
            words = text.split()
            sizes.append(len(words))
            digests.append(_digest(words))
            if len(words) >= SPAN:
                parts.append(seeds(table.of(words)))
            ends.append(ends[-1] + (len(parts[-1][0]) if len(words) >= SPAN else 0))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3]
        flat = pa.StructArray.from_arrays([pa.array(columns[0].view(np.int64)), *(pa.array(c.astype(np.int32)) for c in columns[1:])], fields=list(_SEED))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        units = pa.array([_unit(d) for d in digests], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), units, lists], names=["id", "n_words", "digest", "unit", "seeds"])


def _asked(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], bytes]]:
    """Rows whose text is the one of the unit asked for: place, words and digest."""
    for i, (text, unit) in enumerate(zip(raw_texts(batch, "text"), batch.column("unit").to_pylist(), strict=True)):
        words = text.split()
        digest = _digest(words)
        if _unit(digest) == unit:
            yield i, words, digest


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batched(batches, "text"):
        out: list[tuple[int, int, int, bytes]] = []
        ids, units, asked = (batch.column(c).to_pylist() for c in ("id", "unit", "parts"))
        for i, words, _ in _asked(batch):
            out += [(ids[i], units[i], n, b" ".join(words[n * SEGMENT : (n + 1) * SEGMENT])) for n in asked[i] if n * SEGMENT < len(words)]
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["f_id", "f_unit", "part", "words"])


class Holder:
    """The words of a first holder, as far as they are given."""

    def __init__(self) -> None:
        self.parts: dict[int, list[bytes]] = {}

    def __getitem__(self, i: int) -> bytes | None:
        part = self.parts.get(i // SEGMENT) if i >= 0 else None
        return part[i % SEGMENT] if part is not None and i % SEGMENT < len(part) else None


def extend(words: list[bytes], holder: Holder, at: int, off: int) -> tuple[int, int]:
    """The maximal run around words[at:at + K] that agrees with the holder's words, which stand off places before; empty if the
    anchor itself does not."""
    end = at
    while end < len(words) and holder[end - off] == words[end]:
        end += 1
    if end < at + K:
        return at, at
    begin = at
    while begin and holder[begin - 1 - off] == words[begin - 1]:
        begin -= 1
    return begin, end


def _spare(words: list[bytes], at: int, lo: int, hi: int) -> Iterator[tuple[int, int, bytes]]:
    """The windows lo to hi of the anchor at a place, by the half of their other words that they all have: key, place and words.
    The words settle the key."""
    turn = at - HALF
    for key, first, last in ((words[max(turn, 0) : at + K], lo, min(hi, turn)), (words[at : at + K + HALF], max(lo, turn + 1), hi)):
        if first <= last:
            yield xxhash.xxh3_64_intdigest(b" ".join(key), seed=int(first > turn)) - (1 << 63), first, b" ".join(words[first : last + SPAN])


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batched(batches, "text", 1 << 20):
        ids, out = batch.column("id").to_pylist(), []
        places, given = batch.column("places"), batch.column("given")
        for i, words, digest in _asked(batch):
            holders: dict[tuple[int, int], Holder] = {}
            for part in given[i].as_py() or ():
                holders.setdefault((part["f_id"], part["f_unit"]), Holder()).parts[part["part"]] = part["words"].split()
            runs: dict[tuple[int, int, int], tuple[int, int]] = {}
            spans, spare = [], {}
            for p in sorted(places[i].as_py(), key=lambda p: p["at"]):
                at, lo, hi = p["at"], p["lo"], p["hi"]
                begin = end = at
                if p["f_id"] < ids[i]:
                    chain = p["f_id"], p["f_unit"], at - p["f_at"]
                    begin, end = runs.get(chain, (0, 0))
                    if not begin <= at <= at + K <= end:
                        begin, end = runs[chain] = extend(words, holders.get(chain[:2], Holder()), at, chain[2])
                        if end - begin >= SPAN:
                            spans.append((begin, end))
                if p["more"]:
                    inner = (max(lo, begin), min(hi, end - SPAN))
                    for a, b in ((lo, inner[0] - 1), (inner[1] + 1, hi)) if inner[0] <= inner[1] else ((lo, hi),):
                        if a <= b:
                            for key, place, run in _spare(words, at, a, b):
                                spare.setdefault((key, run), []).append(place)
            n, kept = _without(words, spans)
            out.append((ids[i], digest, _unit(digest), n, kept, [x for s in spans for x in s], [{"key": k, "los": v, "words": w} for (k, w), v in spare.items()]))
        if out:
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(_SPARE))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "digest", "unit", "n_removed", "kept_sha256", "spans", "spare"])


EXTENDED = "id long, digest binary, unit long, n_removed long, kept_sha256 string, spans array<int>, spare array<struct<key:bigint,los:array<int>,words:binary>>"


def _without(words: list[bytes], spans: list[tuple[int, int]]) -> tuple[int, str]:
    """How many words the spans cover, and the SHA-256 of the others."""
    edges = np.zeros(len(words) + 1, np.int64)
    for a, b in spans:
        edges[a] += 1
        edges[b] -= 1
    gone = np.cumsum(edges[:-1]) > 0
    return int(gone.sum()), _digest([w for w, x in zip(words, gone.tolist(), strict=True) if not x]).hex()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batched(batches, "words", 1 << 20):
        rows, places, hashes = [], [], []
        for i, words in enumerate(batch.column("words").to_pylist()):
            every = words.split()
            for k in range(len(every) - SPAN + 1):
                rows.append(i)
                places.append(k)
                hashes.append(_digest(every[k : k + SPAN])[:16])
        of = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in ("run", "least", "most")), pa.array(places, pa.int32()), pa.array(hashes, pa.binary())], names=["run", "least", "most", "place", "window"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batched(batches, "text"):
        ids, out = batch.column("id").to_pylist(), []
        spans, starts = batch.column("spans"), batch.column("starts")
        for i, words, digest in _asked(batch):
            flat = spans[i].as_py() or []
            out.append((ids[i], digest, *_without(words, [*zip(flat[::2], flat[1::2], strict=True), *((s, s + SPAN) for s in starts[i].as_py())])))
        if out:
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "digest", "n_late", "late_sha256"])


def _with_text(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, with the texts of its ids. Texts of no use are dropped in the scan where the ids are few."""
    return texts.join(bounded(materialize(wanted.select("id").distinct(), "repeat-ids")), "id", "left_semi").join(wanted, "id")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scanned = materialize(texts.mapInArrow(_scan, f"id long, n_words long, digest binary, unit long, seeds {SEEDS}"), "repeat-scan")
    long = scanned.where((F.col("n_words") >= SPAN) & F.col("id").isNotNull())
    # Counted keys are written before they are joined: Spark splits a hot key's partition in a join of two plain exchanges only.
    classes = long.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    classes = bounded(materialize(classes, "repeat-classes"))
    known = long.select("id", "unit", "digest", "seeds").join(classes, "digest", "left")
    once, again = known.where("first is null"), known.where("id = first").dropDuplicates(["id", "digest"])
    places = once.union(again).select("id", "unit", F.inline("seeds"))

    keys = places.groupBy("key").agg(F.min(F.struct("id", "unit", "at")).alias("f"), F.max("id").alias("high"), F.count("*").alias("n"))
    keys = materialize(keys.where("f.id < high").select("key", F.col("f.id").alias("f_id"), F.col("f.unit").alias("f_unit"), F.col("f.at").alias("f_at"), (F.col("n") > 2).alias("more")), "repeat-keys")
    first = (F.col("id") == F.col("f_id")) & (F.col("unit") == F.col("f_unit")) & (F.col("at") == F.col("f_at"))
    hits = materialize(places.join(keys, "key").where(~first & ((F.col("f_id") < F.col("id")) | F.col("more"))).drop("key"), "repeat-hits")
    reach = F.sequence(F.floor(F.greatest(F.col("f_at") - REACH, F.lit(0)) / SEGMENT), F.floor((F.col("f_at") + K + REACH - 1) / SEGMENT))
    needed = materialize(hits.where("f_id < id").select("id", "unit", "f_id", "f_unit", F.explode(reach.cast("array<int>")).alias("part")).distinct(), "repeat-needed")
    asked = needed.groupBy(F.col("f_id").alias("id"), F.col("f_unit").alias("unit")).agg(F.collect_set("part").alias("parts"))
    segments = materialize(_with_text(texts, asked).select("id", "unit", "parts", "text").mapInArrow(_segments, "f_id long, f_unit long, part int, words binary"), "repeat-segments")
    given = needed.join(segments, ["f_id", "f_unit", "part"]).groupBy("id", "unit").agg(F.collect_list(F.struct("f_id", "f_unit", "part", "words")).alias("given"))
    extending = hits.groupBy("id", "unit").agg(F.collect_list(F.struct("at", "lo", "hi", "f_id", "f_unit", "f_at", "more")).alias("places")).join(given, ["id", "unit"], "left")
    extended = materialize(_with_text(texts, materialize(extending, "repeat-given")).select("id", "unit", "places", "given", "text").mapInArrow(_extended, EXTENDED), "repeat-extended")

    # What the first holders lack, and another earlier document may have.
    # Documents that share such words share a run of windows: it is joined and its windows are made once, and a document costs a row by run.
    spare = extended.select("id", "unit", F.inline("spare")).withColumn("run", F.unhex(F.sha2("words", 256)))
    runs = materialize(spare.groupBy("run").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.any_value("key").alias("key"), F.any_value("words").alias("words")), "repeat-runs")
    halves = materialize(runs.groupBy("key").agg(F.min("least").alias("low"), F.max("most").alias("high")).where("low < high").select("key"), "repeat-halves")
    windows = materialize(runs.join(halves, "key").select("run", "least", "most", "words").mapInArrow(_windows, "run binary, least long, most long, place int, window binary"), "repeat-windows")
    least = materialize(windows.groupBy("window").agg(F.min("least").alias("low"), F.max("most").alias("high")).where("low < high").select("window", "low"), "repeat-least")
    held = materialize(windows.join(least, "window").where("most > low").groupBy("run").agg(F.collect_list(F.struct("place", "low")).alias("held")), "repeat-held")
    starts = F.flatten(F.transform(F.filter("held", lambda h: h["low"] < F.col("id")), lambda h: F.transform("los", lambda lo: lo + h["place"])))
    late = spare.select("id", "unit", "los", "run").join(held, "run").select("id", "unit", starts.alias("starts")).where(F.size("starts") > 0).groupBy("id", "unit").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    late = materialize(late.join(extended.select("id", "unit", "spans").dropDuplicates(["id", "unit"]), ["id", "unit"]), "repeat-late")
    cut = _with_text(texts, late).select("id", "unit", "spans", "starts", "text").mapInArrow(_remove, "id long, digest binary, n_late long, late_sha256 string").dropDuplicates(["id", "digest"])
    done = extended.select("id", "digest", "n_removed", "kept_sha256").dropDuplicates(["id", "digest"]).join(cut, ["id", "digest"], "left")
    done = materialize(done.select("id", "digest", F.coalesce("n_late", "n_removed").alias("n_removed"), F.coalesce("late_sha256", "kept_sha256").alias("kept_sha256")).where("n_removed > 0"), "repeat-done")
    release(keys, hits, needed, segments, runs, halves, windows, least, held, extended)

    copy = F.col("first").isNotNull() & (F.col("id") > F.col("first"))
    out = scanned.select("id", "n_words", "digest").join(classes, "digest", "left").join(done, ["id", "digest"], "left")
    removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest"))))
    return out.select(F.col("id").alias(id_col), "n_words", removed.cast("long").alias("n_removed"), kept.alias("kept_sha256"))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every window of every document; for small tables.
OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
g AS (SELECT doc_id, n, i, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM g WHERE i <= n - 50 GROUP BY h),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM g JOIN f USING (h) WHERE i <= n - 50 AND doc_id > first),
k AS (SELECT p.doc_id, count(r.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.i) FILTER (r.i IS NULL), '') AS kept FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.i = r.i GROUP BY p.doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""

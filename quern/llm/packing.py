"""Lexical retrieval packing: documents that share words fill a window together.

Terms are pairs of neighbouring tokens, hashed to FEATURES values. One scan tokenizes the documents and counts, over all of
them, in how many each term occurs, and their mean length. Then every document gets two of its terms by weighted minima: the
first in either of two fixed pseudo-random orders in which a term comes early in proportion to its inverse document frequency. Two
documents get the same one with a chance equal to the weight of the terms that they share, of all that either has; so
neighbours gather when documents are dealt by the first of these terms, sorted by both, and cut, in this order, into shards of
bounded size. What is too large for one task is split over several.

Each shard has a BM25 inverted index with the statistics of the whole corpus. The next unused document seeds a window; the
unused documents of the shard follow by falling score for all of the seed's terms until the window is full, and documents in
order only when no unused one has a positive score. A document that does not fit is cut there, and what is left of it seeds
the next window, so windows hold WINDOW tokens and no padding; the end of a shard is cut to powers of two, which need none.

What a task holds is bounded by the shard, what is broadcast by FEATURES (8 MB). Neighbours in other shards are not found; how many
that are is measured (python -m quern.llm.recall) and stated in the README.

A null text is empty and has the end token alone. Very long documents fill windows of their own. Repeated rows are
packed as often as they occur. An empty table gives an empty one. Only id and text columns are read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import batched, materialize, mix64, raw_texts, seen, small_batches

WINDOW, END = 1024, 0
#: A shard holds so many documents or tokens at most (one document may exceed it).
SHARD_DOCS, SHARD_TOKENS, K1, B = 1024, 1_000_000, 1.2, 0.75
#: Values that pairs of tokens are hashed to, and blocks in which their counts are added up.
BITS, BLOCKS = 20, 64
FEATURES = 1 << BITS
#: Bytes of texts or tokens that are turned into terms at once.
BATCH = 1 << 20
#: The ranks of byte_bpe_50k.json: the same ids, at four times the speed.
TOKENIZER = "byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, shard_id long"


class Encoder:
    """Token ids of a byte-level BPE vocabulary given as ranks. The end-of-text mark counts as the one token it names."""

    MARK, MARK_ID = "<|endoftext|>", 50256

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        #: Bytes of a token id as it is stored.
        self.width = 2 if max(max(ranks.values()), self.MARK_ID) < 1 << 16 else 4
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        parts = [self.bpe.encode_ordinary(part) for part in text.split(self.MARK)]
        for part in parts[1:]:
            parts[0].append(self.MARK_ID)
            parts[0] += part
        return parts[0]


@cache
def encoder(path: str | None) -> Encoder:
    import public_tokenizers

    return Encoder(path or public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def pairs_of(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The terms of documents, place by place, and the place of the document that each is of. The end token is of none."""
    sizes = np.array([len(d) for d in docs], np.int64)
    if not sizes.sum():
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    flat, ends = np.concatenate(docs).astype(np.uint64), np.cumsum(sizes)
    own = np.ones(len(flat), bool)
    own[ends - 1] = own[ends - 2] = False
    at = np.flatnonzero(own)
    return (mix64(flat[at] << np.uint64(32) | flat[at + 1]) >> np.uint64(64 - BITS)).astype(np.uint32), np.repeat(np.arange(len(docs)), sizes)[at]


def postings(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, document and frequency, in this order, of up to 4096 documents: by one plain sort."""
    term, doc = pairs_of(docs)
    every = np.sort(term << np.uint32(12) | doc.astype(np.uint32))
    begin = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][: len(every)])
    return (every[begin] >> np.uint32(12)).astype(np.int64), (every[begin] & np.uint32(4095)).astype(np.int64), np.diff(np.r_[begin, len(every)])


def distinct_terms(docs: list[np.ndarray]) -> np.ndarray:
    """The distinct terms of each of up to 4096 documents, all in one."""
    term, doc = pairs_of(docs)
    every = np.sort(term << np.uint32(12) | doc.astype(np.uint32))
    return every[np.r_[True, every[1:] != every[:-1]][: len(every)]] >> np.uint32(12)


def terms_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a document, and how often each occurs."""
    term, _, often = postings([ids])
    return term, often


class Stats:
    """Document frequencies of all terms over n documents of a mean length."""

    def __init__(self, df: np.ndarray, n: int, mean: float):
        self.n, self.mean = n, max(mean, 1.0)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.alone = df < 2
        self.made: list[np.ndarray] = []

    def orders(self) -> list[np.ndarray]:
        """Two pseudo-random orders of the terms, those of weight first; terms of a single document gather nothing and are last.
        Made once in a worker."""
        out = self.made
        if out:
            return out
        for seed in (1, 2):
            u = ((mix64(np.arange(1, FEATURES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
            out.append(np.where(self.alone, np.inf, -np.log(u) / np.maximum(self.idf, 1e-6)).astype(np.float32))
        return out


def stats_of(docs: list[np.ndarray]) -> Stats:
    """Of a few documents."""
    df = np.zeros(FEATURES, np.int64)
    for start in range(0, len(docs), 4096):
        df += np.bincount(distinct_terms(docs[start : start + 4096]), minlength=FEATURES)
    return Stats(df, len(docs), float(np.mean([max(len(d) - 1, 0) for d in docs])) if docs else 0.0)


class Index:
    """BM25 postings of a shard of up to 4096 documents, by term and by document. Terms that one in DENSE documents has are
    scored for all seeds at once, by a product of matrices; the rest by postings, seed by seed."""

    DENSE = 16

    def __init__(self, docs: list[np.ndarray], stats: Stats | None = None):
        n, stats = len(docs), stats or stats_of(docs)
        sizes = np.array([max(len(d) - 1, 0) for d in docs], np.int64)
        term, doc, often = postings(docs)
        begin = np.flatnonzero(np.r_[True, term[1:] != term[:-1]][: len(term)])
        df = np.diff(np.r_[begin, len(term)])
        # A term of one document retrieves nothing.
        shared = np.repeat(df > 1, df)
        term, self.doc, often, df = term[shared], doc[shared], often[shared].astype(np.float32), df[df > 1]
        self.begin = np.r_[0, np.cumsum(df)]
        norm = (K1 * (1 - B + B * sizes / stats.mean)).astype(np.float32)
        self.weight = (stats.idf[term] * often * np.float32(K1 + 1) / (often + norm[self.doc])).astype(np.float64)
        number = np.repeat(np.arange(len(df)), df)
        back = np.argsort(self.doc.astype(np.uint16), kind="stable")
        self.own_term = number[back]
        self.own = np.searchsorted(self.doc[back], np.arange(n + 1))
        self.n, dense = n, df * self.DENSE >= n
        self.dense = dense
        row, inside = np.cumsum(dense) - 1, dense[number]
        rows = np.zeros((int(dense.sum()), n), np.float32)
        rows[row[number[inside]], self.doc[inside]] = self.weight[inside]
        self.common = (rows > 0).astype(np.float32).T @ rows

    def scores(self, seed: int) -> np.ndarray:
        """The scores of all documents for all terms of the seed."""
        terms = self.own_term[self.own[seed] : self.own[seed + 1]]
        terms = terms[~self.dense[terms]]
        size = self.begin[terms + 1] - self.begin[terms]
        at = np.repeat(self.begin[terms] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.doc[at], self.weight[at], self.n) + self.common[seed]

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """All documents unused at the first call that share a term with the seed, by falling score for all of its
        terms; ties by position. Scored when the first is asked for, and sorted as far as they are asked for."""
        score = self.scores(seed)
        score[~unused] = 0
        found, k = np.flatnonzero(score), 16
        while len(found):
            least = np.partition(score[found], len(found) - k)[len(found) - k] if len(found) > k else 0
            best = found[score[found] >= least]
            yield from best[np.lexsort((best, -score[best]))].tolist()
            found, k = found[score[found] < least], 4 * k


def pack(ids: list[np.ndarray], stats: Stats | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of a shard of encoded documents."""
    tokens = [len(x) for x in ids]
    index = Index(ids, stats)
    unused, cursor = np.ones(len(ids), bool), 0
    pieces: list[tuple[int, int, int]] = []
    room, queue, carried = WINDOW, iter(()), None
    while True:
        if carried is not None:
            d, start = carried
        else:
            d = next(queue, None)
            if d is None:
                while cursor < len(ids) and not unused[cursor]:
                    cursor += 1
                if cursor == len(ids):
                    break
                d = cursor
            unused[d], start = False, 0
        if room == WINDOW:
            queue = index.neighbours(d, unused)
        size = min(room, tokens[d] - start)
        pieces.append((d, start, size))
        room -= size
        carried = (d, start + size) if start + size < tokens[d] else None
        if not room:
            room = WINDOW
    total = sum(tokens)
    ends = list(range(WINDOW, total + 1, WINDOW))
    at = ends[-1] if ends else 0
    for bit in reversed(range(WINDOW.bit_length() - 1)):
        if (total - at) >> bit & 1:
            at += 1 << bit
            ends.append(at)
    out, seq, offset, begin = [], 0, 0, 0
    for d, start, size in pieces:
        while size:
            part = min(size, ends[seq] - begin - offset)
            out.append((d, start, part, seq, offset))
            start, size, offset = start + part, size - part, offset + part
            if begin + offset == ends[seq]:
                begin, offset, seq = ends[seq], 0, seq + 1
    return out


def _tokenize(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind, df = f"<u{enc.width}", np.zeros(FEATURES, np.int64)
        held: list[np.ndarray] = []
        for batch in batched(batches, "text", BATCH):
            every = []
            for text in raw_texts(batch, "text"):
                ids = enc.encode(text.decode())
                ids.append(END)
                every.append(np.fromiter(ids, kind, len(ids)))
            held.append(distinct_terms(every))
            if sum(map(len, held)) > FEATURES:
                df += np.bincount(np.concatenate(held), minlength=FEATURES)
                held = []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in every], pa.int64()), pa.array([x.tobytes() for x in every], pa.binary())], names=["doc_id", "tokens", "ids"])
        if held:
            df += np.bincount(np.concatenate(held), minlength=FEATURES)
        if df.any():
            # The counts of this task, in rows of their own, told from documents by a negative number.
            parts = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in np.split(df.astype("<u4"), BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.nulls(BLOCKS, pa.int64()), pa.array(range(-BLOCKS, 0), pa.int64()), pa.array(parts, pa.binary())], names=["doc_id", "tokens", "ids"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, part in zip(batch.column("tokens").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            counts = np.frombuffer(pa.decompress(part, 4 * FEATURES // BLOCKS, "zstd", asbytes=True), "<u4").astype(np.int64)
            sums[block] = sums[block] + counts if block in sums else counts
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["tokens", "ids"])


def _decoded(batch: pa.RecordBatch) -> list[np.ndarray]:
    kinds = {2: np.dtype("<u2"), 4: np.dtype("<u4")}
    return [np.frombuffer(x, kinds[len(x) // n]) for x, n in zip(batch.column("ids").to_pylist(), batch.column("tokens").to_pylist(), strict=True)]


def _route(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = shared.value.orders()
        for batch in batched(batches, "ids", BATCH):
            term, doc = pairs_of(_decoded(batch))
            begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][: len(doc)])
            keys = np.full((2, batch.num_rows), -1, np.int64)
            for k, order in enumerate(orders):
                # The least value of an order stands for the term that has it.
                if len(begin):
                    keys[k, doc[begin]] = np.minimum.reduceat(order[term], begin).view(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys[0]), pa.array(keys[1])], names=[*batch.schema.names, "near", "nearer"])

    return run


def _mapper(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, part = shared.value, TaskContext.get().partitionId() << 36
        sequence, shard = part, part
        names, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal names, ids, held, sequence, shard
            d, start, size, seq, offset = (np.array(c, np.int64) for c in zip(*pack(ids, stats), strict=True))
            crc = [zlib.crc32(ids[i][s : s + n].astype("<u4").tobytes()) for i, s, n in zip(d.tolist(), start.tolist(), size.tolist(), strict=True)]
            tokens = np.array([len(x) for x in ids], np.int64)
            columns = [pa.array(names, pa.int64()).take(pa.array(d)), *(pa.array(x, pa.int64()) for x in (start, size, crc, tokens[d], seq + sequence, offset, np.full(len(d), shard)))]
            sequence, shard = sequence + int(seq[-1]) + 1, shard + 1
            names, ids, held = [], [], 0
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for name, one in zip(batch.column("doc_id").to_pylist(), _decoded(batch), strict=True):
                if ids and (len(ids) == SHARD_DOCS or held + len(one) > SHARD_TOKENS):
                    yield flush()
                names.append(name)
                ids.append(one)
                held += len(one)
        if ids:
            yield flush()

    return run


def corpus_stats(encoded: DataFrame) -> Stats:
    """Of the table of _tokenize(): the tasks' counts are added up by blocks, and FEATURES numbers reach the driver."""
    counts = encoded.where("tokens < 0").select("tokens", "ids").repartition("tokens").mapInArrow(_add_up, "tokens long, ids binary").toArrow()
    df = np.zeros(FEATURES, np.int64)
    for block, part in zip(counts.column("tokens").to_pylist(), counts.column("ids").to_pylist(), strict=True):
        np.split(df, BLOCKS)[block][:] += np.frombuffer(part, np.int64)
    n, total = seen(encoded)["n"], seen(encoded)["total"] or 0
    return Stats(df, n, total / max(n, 1))


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece. tokenizer: path of the ranks file on the executors; the installed public one if None."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = texts.mapInArrow(_tokenize(tokenizer), "doc_id long, tokens long, ids binary")
    of_docs = F.col("tokens") > 0
    encoded = materialize(encoded, "pack-tokens", "snappy", n=F.count_if(of_docs), total=F.sum(F.when(of_docs, F.col("tokens") - 1)))
    shared = docs.sparkSession.sparkContext.broadcast(corpus_stats(encoded))
    routed = encoded.where(of_docs).mapInArrow(_route(shared), "doc_id long, tokens long, ids binary, near long, nearer long")
    # Dealt by the first term; what is too large for a task, as the copies of one text may be, is split as it is read.
    order = ["near", "nearer", F.xxhash64("doc_id", "ids"), "doc_id"]
    return routed.hint("rebalance", "near").sortWithinPartitions(*order).select("doc_id", "tokens", "ids").mapInArrow(_mapper(shared), SCHEMA)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Near-duplicates, repeated passages and embeddings against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import embeddings, minhash, substrings
from quern.llm.common import array_groups
from quern.llm.components import components
from tests.llm.conftest import clashing, words


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_near(rows):
    """(id, text) -> id: (n_shingles, component)."""
    sets, parent = {}, {}
    for d, text in rows:
        w = (text or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
        parent[d] = d
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(parent, d)) for d in ids}


def check_near(docs):
    rows = docs.select("doc_id", "text").collect()
    want = brute_near([r for r in rows if r[0] is not None])
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_minhash_odd(odd_docs):
    check_near(clashing(odd_docs, "id", "key", "minima", "component_id", "kept", "n_shingles", "bucket"))


def test_minhash_empty(no_docs):
    assert minhash.near_duplicates(no_docs).collect() == []


def test_minhash_chains(spark):
    """A chain of edits: neighbours are linked, ends are not, and one component holds them all."""
    rng, rows = random.Random(5), []
    for group in range(3):
        w = words(group + 50, 150).split()
        for i in range(40):
            rows.append((group * 100 + i, " ".join(w)))
            w[rng.randrange(150)] = f"edit{i}"
            w[rng.randrange(150)] = f"also{i}"
    rows += [(1000 + i, words(900 + i, 60) + " " + words(7, 40)) for i in range(60)]
    rng.shuffle(rows)
    check_near(spark.createDataFrame(rows, "doc_id long, text string"))


def test_minhash_hot_bucket(spark, monkeypatch):
    """A bucket of several blocks, with members outside its hub's component."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    shared = words(1, 70)
    rows = [(i, shared + " " + words(i + 10, 25)) for i in range(40)] + [(100 + i, shared + " " + words(3, 24) + f" end{i}") for i in range(20)]
    check_near(spark.createDataFrame(rows, "doc_id long, text string"))


def test_minhash_hot_bucket_of_long_texts(spark, monkeypatch):
    """Blocks are bounded by bytes too: few members, long sets, and the links between blocks are found."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 1 << 16)
    shared = words(1, 3000)
    rows = [(i, shared + " " + words(i + 10, 1100)) for i in range(12)] + [(100 + i, shared + " " + words(3, 1100) + f" end{i}") for i in range(6)]
    check_near(spark.createDataFrame(rows, "doc_id long, text string"))


def test_array_groups():
    import pyarrow as pa

    rng = random.Random(4)
    keys = sorted((rng.randrange(6), rng.randrange(3)) for _ in range(200))
    table = pa.table({"a": [k[0] for k in keys], "b": [k[1] for k in keys], "v": range(200)})
    got = [(int(g["a"][0]), int(g["b"][0]), g["v"].tolist()) for g in array_groups(iter(table.to_batches(max_chunksize=7)), ["a", "b"], ["v"])]
    assert [g[:2] for g in got] == sorted(set(keys)) and [v for g in got for v in g[2]] == list(range(200))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(500, i) for i in range(501, 600)] + [(7, 7), (8, 9), (9, 8), (None, 3)]
    parent = {x: x for e in edges if None not in e for x in e}
    for a, b in (e for e in edges if None not in e):
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {x: find(parent, x) for x in parent if x != 7}
    assert components(spark.createDataFrame([], "a long, b long"), "none").collect() == []


def brute_repeats(rows):
    seen, out = {}, []
    for d, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - 49):
            if d is not None:
                key = tuple(w[i : i + 50])
                seen[key] = min(seen.get(key, d), d)
    for d, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if d is not None and seen[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check_repeats(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in substrings.remove_repeats(docs).collect()), key=str) == brute_repeats(rows)


def test_repeats_odd(odd_docs):
    check_repeats(clashing(odd_docs, "id", "digest", "anchors", "n_words", "n_removed", "first", "unit"))


def test_repeats_empty(no_docs):
    assert substrings.remove_repeats(no_docs).collect() == []


def test_repeats_passages(spark):
    """Passages of 49 to 60 words within other text, overlaps, repeats within a document, an id with two texts."""
    long = words(1, 400).split()
    part = lambda a, n: " ".join(long[a : a + n])
    rows = [(i, f"{words(20 + i, 30)} {part(i * 7, 44 + i)} {words(70 + i, 12)} {part(200 - i, 60)}") for i in range(18)]
    rows += [(50, part(0, 55) + " " + part(0, 55)), (51, part(0, 55)), (51, part(100, 80)), (52, part(90, 100)), (53, part(0, 400)), (54, "same " * 120), (55, "same " * 200)]
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_of_blocks(spark, seed):
    """Documents of shared blocks in random order: most windows stand in an earlier document other than the anchor's first holder."""
    rng = random.Random(seed)
    blocks = [words(seed * 100 + i, rng.choice((8, 14, 19, 25, 31, 40))) for i in range(14)]
    rows = [(i, " ".join(rng.choice(blocks) for _ in range(rng.randint(2, 14)))) for i in rng.sample(range(500), 90)]
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string"))


def test_repeats_extend():
    rng = random.Random(5)
    for _ in range(200):
        a = [rng.choice([b"x", b"y"]) for _ in range(rng.randint(20, 150))]
        off = rng.randint(-5, 5)
        b = {i - off: w for i, w in enumerate(a) if rng.random() < 0.99}
        holder = substrings.Holder()
        for n in range(4):
            holder.parts[n] = [b.get(i, b"?") for i in range(n * substrings.SEGMENT, (n + 1) * substrings.SEGMENT)]
        at = rng.randint(0, len(a) - 20)
        same = [holder[i - off] == w for i, w in enumerate(a)]
        begin, end = substrings.extend(a, holder, at, off)
        if not all(same[at : at + 20]):
            assert begin == end
            continue
        assert all(same[begin:end]) and begin <= at and end >= at + 20
        assert (begin == 0 or not same[begin - 1]) and (end == len(a) or not same[end])


def test_repeats_make_no_row_by_window(spark, monkeypatch):
    """A passage that many documents share is found by its anchors: no window goes on by itself."""
    made = {}
    kept = substrings.materialize
    monkeypatch.setattr(substrings, "materialize", lambda df, name: made.setdefault(name, kept(df, name)))
    passage = words(9, 150)
    rows = [(i, f"{words(200 + i, 40)} {passage} {words(900 + i, 40)}") for i in range(40)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.n_removed for r in got} == {0, 150} and made["repeat-windows"]._quern["rows"] < 40 * 10


def brute_vectors(rows, threshold=0.98):
    unit, n, parent = [], [0] * len(rows), {r[0]: r[0] for r in rows if r[0] is not None}
    for i, v, label in rows:
        good = i is not None and v and label is not None and None not in v and all(map(math.isfinite, v)) and any(v)
        unit.append(np.array(v, float) / np.abs(v).max() if good else None)
        unit[-1] = unit[-1] / np.linalg.norm(unit[-1]) if good else None
    for i, x in enumerate(rows):
        for j, y in enumerate(rows):
            if i != j and unit[i] is not None and unit[j] is not None and x[2] == y[2] and len(x[1]) == len(y[1]) and unit[i] @ unit[j] >= threshold:
                n[i] += 1
                a, b = find(parent, x[0]), find(parent, y[0])
                parent[max(a, b)] = min(a, b)
    return sorted(((r[0], n[k], find(parent, r[0]) if r[0] is not None else None) for k, r in enumerate(rows)), key=str)


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.05 * (i % 5)).tolist(), i % 3) for i in range(300)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [math.nan] + [1.0] * 15, 1), (404, [None] + [1.0] * 15, 1), (405, rows[0][1], None), (406, rows[0][1], rows[0][2]), (407, [3 * x for x in rows[0][1]], rows[0][2]), (None, rows[0][1], 0), (408, [1.0, 2.0], 0), (409, [1e300] * 16, 1), (410, [1e-300] * 16, 1), (411, [math.inf] + [1.0] * 15, 1)]
    rows += [rows[5]]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "id", "key", "n_links", "component_id", "signs", "vector")
    got = embeddings.near_duplicates(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id or r.vec_id is None) for r in got)
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [0, 10, 10**6, 10**10])
def test_vector_plan(n):
    bits, tables = embeddings.plan(n)
    assert n / 2**bits <= 64 and (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** tables <= embeddings.MISS


def test_signature_estimates():
    table = substrings.WordHash()
    a, b = words(1, 2000), words(1, 1800) + " " + words(2, 200)
    x, y = (minhash.shingle_set(t.encode(), table) for t in (a, b))
    exact = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((minhash.signature(x) == minhash.signature(y)).mean() - exact) < 0.2


def test_no_rows_of_pairs(spark):
    """A thousand near copies make rows in proportion, and one component."""
    base = words(1, 150)
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit(base + " "), F.col("id").cast("string")).alias("text"))
    assert {r.component_id for r in minhash.near_duplicates(df).collect()} == {0}

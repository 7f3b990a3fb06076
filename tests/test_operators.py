"""Operators on small tables with zeros, ties, blanks and nulls, against dense or hand-made results."""

import gzip
import math
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import scalars, special
from quern.operators import benchmarks, geometry, markers, matrix, models, sequences, sets, tables
from quern.registry import REGISTRY, Operator, OperatorRegistry, threads
from quern.sources import readers, writers
from quern.streaming.sessions import session_minutes

N, M = 30, 12


@pytest.fixture(scope="module")
def dense():
    """Counts with an empty column, an empty row, a constant column and ties."""
    x = np.random.default_rng(1).poisson(1.2, (N, M)).astype(float)
    x[:, 3] = 0
    x[5] = 0
    x[:, 7] = 2
    return x


@pytest.fixture(scope="module")
def cells(spark, dense):
    rows = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)]
    return spark.createDataFrame(rows, "row_id long, col_id long, value double").cache()


GROUPS = [None if i % 9 == 8 else "abc"[i % 3] if i else "solo" for i in range(N)]


@pytest.fixture(scope="module")
def obs(spark):
    return spark.createDataFrame(list(enumerate(GROUPS)), "row_id long, grp string").cache()


def test_normalize(cells, dense):
    sums = dense.sum(1)
    goal = np.median(sums[sums > 0])
    for r in matrix.normalize_total(cells).collect():
        assert r.value == pytest.approx(dense[r.row_id, r.col_id] * goal / sums[r.row_id])
    assert matrix.normalize_total(cells.limit(0)).collect() == []


def test_column_stats(cells, obs, dense):
    got = {r.col_id: r for r in matrix.column_stats(cells, obs, -0.5).collect()}
    assert set(got) == {j for j in range(M) if dense[:, j].any()}
    for j, r in got.items():
        assert (r["mean"], r["var"], r.nnz, r.detected) == (pytest.approx(dense[:, j].mean()), pytest.approx(dense[:, j].var(ddof=1)), (dense[:, j] != 0).sum(), N)


def test_group_summary_leaves_out_null_groups(cells, obs, dense):
    for r in matrix.group_summary(cells, obs, dense=True).collect():
        rows = [i for i in range(N) if GROUPS[i] == r.grp]
        assert (r["size"], r.total, r["mean"]) == (len(rows), dense[rows, r.col_id].sum(), pytest.approx(dense[rows, r.col_id].mean()))


def test_trimean_counts_zeros(cells, obs, dense):
    got = {(r.col_id, r.grp): r.trimean for r in matrix.group_trimean(cells, obs).collect()}
    for (j, g), v in got.items():
        q = np.quantile(dense[[i for i in range(N) if GROUPS[i] == g], j], [0.25, 0.5, 0.75])
        assert v == pytest.approx((q[0] + 2 * q[1] + q[2]) / 4)


def test_trimean_of_ten(spark):
    cells = spark.createDataFrame([(i, 0, float(i)) for i in range(1, 11)], "row_id long, col_id long, value double")
    assert matrix.group_trimean(cells, cells.select("row_id", F.lit("g").alias("grp"))).first().trimean == 5.5


def test_scale_constant_column(cells, obs, dense):
    got = {(r.row_id, r.col_id): r.value for r in matrix.scale(cells, obs, 1.5).collect()}
    assert all(got[i, 7] == 0 for i in range(N)) and max(map(abs, got.values())) <= 1.5
    z = (dense[:, 1] - dense[:, 1].mean()) / dense[:, 1].std(ddof=1)
    assert [got[i, 1] for i in range(N)] == pytest.approx(np.clip(z, -1.5, 1.5))


def test_smooth_by_hand(spark, cells, obs, dense):
    order = spark.createDataFrame([(j, j % 2, j // 2 + 1) for j in range(M)], "col_id long, block int, place int")
    grid = matrix.densify(cells, obs, order)
    got = {(r.row_id, r.col_id): r.value for r in matrix.smooth(grid, order, 5).collect()}
    for (i, j), v in got.items():
        near = [(dense[i, k], 3 - abs(k // 2 - j // 2)) for k in range(M) if k % 2 == j % 2 and abs(k // 2 - j // 2) <= 2]
        assert v == pytest.approx(sum(a * w for a, w in near) / sum(w for _, w in near))
    assert matrix.smooth(grid, order, 1).count() == N * M


def test_value_checks(spark, cells):
    assert tuple(matrix.value_checks(cells).first()) == (True, False)
    bad = spark.createDataFrame([(1, 1, float("nan")), (1, 2, -0.5)], cells.schema)
    assert tuple(matrix.value_checks(bad).first()) == (False, True)
    assert matrix.mean_implies_count(0.0, 3.0, 1.0, 10, 4) and not matrix.mean_implies_count(-1.0, 3.0, 1.0, 10, 4)


def ranks_of(x):
    order = np.argsort(x, kind="stable")
    r = np.empty(len(x))
    r[order] = np.arange(1, len(x) + 1)
    for v in np.unique(x):
        r[x == v] = r[x == v].mean()
    return r


def test_rank_sums_by_hand(cells, obs, dense):
    for r in markers.rank_sums(cells, obs).collect():
        rank = ranks_of(dense[:, r.col_id])
        rows = [i for i in range(N) if GROUPS[i] == r.grp]
        _, t = np.unique(dense[:, r.col_id], return_counts=True)
        assert (r.rank_sum, r.nnz, r.ties) == (pytest.approx(rank[rows].sum()), (dense[rows, r.col_id] > 0).sum(), (t.astype(float) ** 3 - t).sum())


def test_wilcoxon_flavors(cells, obs):
    ranks = markers.rank_sums(cells, obs)
    for flavor in ("plain", "partial_ties", "all_ties", "floored"):
        got = markers.wilcoxon(ranks, flavor).collect()
        assert all(r.p == pytest.approx(math.erfc(abs(r.z) / 2**0.5), abs=1e-12) and 0 <= r.p <= 1 for r in got)


def test_bh_by_hand(spark):
    p = [0.01, 0.02, 0.03, 0.5, 0.02, 1.0]
    got = sorted((r.p, r.p_adj) for r in markers.adjust_bh(spark.createDataFrame([("g", v) for v in p], "g string, p double"), ["g"]).collect())
    want, low = {}, 1.0
    for k, v in reversed(list(enumerate(sorted(p), 1))):
        low = min(low, v * len(p) / k)
        want[k] = low
    assert [b for _, b in got] == pytest.approx([want[k] for k in range(1, len(p) + 1)])


def test_markers_small_groups(cells, obs):
    logged = matrix.log_normalize(cells)
    assert "solo" not in {r.grp for r in markers.find_markers(logged, obs, return_p=None).collect()}
    assert markers.rank_genes_groups(logged, obs, 3, groups=["a"]).count() == 3


def test_enrichment_edges(spark):
    stats = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 4, 3, 1, 0.5, -0.5, -1, -3, -4, -5])], "item long, stat double")
    pairs = [("top", i) for i in (0, 1, 2)] + [("end", i) for i in (8, 9)] + [("top", 99)]
    got = {r.set_id: r for r in sets.enrichment_scores(stats, spark.createDataFrame(pairs, "set_id string, item long")).collect()}
    assert got["top"].es == pytest.approx(1.0) and got["top"].leading_edge == "0,1,2"
    assert got["end"].es == pytest.approx(-1.0) and set(got["end"].leading_edge.split(",")) == {"8", "9"}


def test_over_representation_by_hand(spark):
    sets_df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(5, 25)] + [("c", 99)], "set_id string, item long")
    got = {r.set_id: r for r in sets.over_representation(spark.createDataFrame([("q", i) for i in (0, 1, 2, 6, 500)], "cluster string, item long"), sets_df, 5).collect()}
    total, n = 26, 4
    tail = sum(math.comb(10, i) * math.comb(16, n - i) for i in range(4, 5)) / math.comb(total, n)
    assert got["a"].p == pytest.approx(tail) and got["a"].gene_ratio == "4/4" and got["a"].bg_ratio == "10/26" and set(got) == {"a", "b"}


def test_signature_parsing():
    assert sets.parse_signature(["A", "B+", "C-"]) == [("A", 1), ("B", 1), ("C", -1)]


def test_permutation_results_repeat(cells, obs, spark):
    pairs = spark.createDataFrame([(0, 0, 1), (1, 2, 4), (2, 3, 5)], "pair_id long, a long, b long")
    a, b = (sorted(map(tuple, sets.cluster_pair_p(cells, obs, pairs, 8).collect())) for _ in range(2))
    assert a == b and all(0 <= r[-1] <= 1 for r in a)
    assert sets.shuffled(obs, 3).groupBy("turn", "grp").count().select("grp", "count").distinct().count() == 4


def test_erfc():
    import duckdb

    for x in (0, 1e-6, 0.3, 1, 1.99, 2, 2.5, 4, 9, 20):
        got = duckdb.sql(f"SELECT {special.erfc_sql('x')} FROM (SELECT {x}e0 AS x)".replace("e-06e0", "e-6")).fetchall()[0][0]
        assert got == pytest.approx(math.erfc(x), rel=1e-9)


def test_special_columns(spark):
    xs = [0.01, 0.5, 1, 2, 3.7, 10, 171, 1e6]
    got = spark.createDataFrame([(float(x),) for x in xs], "x double").select("x", special.lgamma(F.col("x")).alias("g"), special.erfc(F.col("x")).alias("e"), special.chi2_tail(F.col("x"), 1).alias("c")).collect()
    for r in got:
        assert r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12) and r.e == pytest.approx(math.erfc(r.x), rel=1e-9) and r.c == pytest.approx(math.erfc(math.sqrt(r.x / 2)), rel=1e-9)


def test_clean_variants(spark):
    head = ["HUGO_symbol", "chromosome", "Start_Position", "End_position", "Reference_Allele", "Tumor_Seq_Allele2", "Variant_Classification", "Variant_Type", "Tumor_Sample_Barcode", "pos"]
    rows = [("", "1", "10", "x", "A", "C", "Silent", "SNP", "TCGA-AA-1234-01", 1), (None, "1", "10", "11", "A", "C", "Missense_Mutation", "SNP", "TCGA-AA-1234-01", 2), ("TP53", "2", "7", "8", "G", "T", "Missense_Mutation", "SNP", "TCGA-AA-1234-02", 3)]
    got = tables.clean_variants(spark.createDataFrame(rows, head), [F.asc("pos")], barcodes=True).orderBy("pos").collect()
    assert [(r.Hugo_Symbol, r.End_Position, r.Tumor_Sample_Barcode, r.silent) for r in got] == [("Unknown", None, "TCGA-AA-1234", True), ("TP53", 8, "TCGA-AA-1234", False)]
    with pytest.raises(ValueError, match="missing column Chromosome"):
        tables.canonical_columns(spark.createDataFrame(rows, [*head[:1], "chrom", *head[2:]]))


def test_label_filter(spark):
    rows = spark.createDataFrame([(1, {"k": "3", "c": "x"}), (2, {"k": "abc"}), (3, {}), (4, None)], "id int, l map<string,string>")
    assert [r.id for r in rows.where(scalars.label_filter("k>=3", F.col("l"))).collect()] == [1]
    assert [r.id for r in rows.where(scalars.label_filter("c = x", F.col("l"))).collect()] == [1]
    for bad in ("k>=x", "what"):
        with pytest.raises(ValueError):
            scalars.label_filter(bad, F.col("l"))


def test_sources(spark, tmp_path):
    text = "# note\n# other\nHugo_Symbol\tValue\textra\nA\t1\nB\t\"2\tz\n"
    with gzip.open(tmp_path / "x.maf.gz", "wt") as f:
        f.write(text)
    got = readers.read_tsv(spark, str(tmp_path / "x.maf.gz"), "Hugo_Symbol").collect()
    assert [tuple(r) for r in got] == [("A", "1", None), ("B", '"2', "z")]
    with pytest.raises(ValueError, match="no line"):
        readers.read_tsv(spark, str(tmp_path / "x.maf.gz"), "Nothing")
    (tmp_path / "speedups.tsv").write_text("task\tplatform\na\t\nb\tDarwin\n")
    assert [r.platform for r in readers.read_shards(spark, str(tmp_path)).collect()] == ["mac", "mac"]
    (tmp_path / "log").write_text("wall: 1.5 s\nwall: 2.5 s\nnoise\npeak_mb = 7e2\nbad: x\n")
    assert {(r.key, r.value) for r in readers.read_log_metrics(spark, str(tmp_path / "log")).collect()} == {("wall", 2.5), ("peak_mb", 700.0)}
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in readers.read_json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()) == [1, 2]
    a, b = (readers.synthetic_traces(spark, 1, 2, 10).repartition(n).orderBy("trace_id").collect() for n in (1, 2))
    assert a == b


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, [1.5, 2.0]), (2, "x", [])], "a int, b string, c array<double>")
    writers.write_tsv(df.coalesce(1), str(tmp_path / "t"))
    assert (next((tmp_path / "t").glob("part*"))).read_text() == "a\tb\tc\n1\t\t1.5, 2.0\n2\tx\t\n"
    assert writers.markdown(df.select("a", "b")) == "| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | x |"


def test_season(spark):
    import datetime as dt

    def days(year, warm):
        start = dt.date(year, 1, 1)
        return [(1, start + dt.timedelta(i), 10.0 if any(a <= i < b for a, b in warm) else 0.0) for i in range(365)]

    rows = days(2001, [(100, 250)]) + days(2002, []) + days(2003, [(150, 365)]) + days(2005, [(20, 23), (200, 300)])
    got = {r.year: r.length for r in sequences.season_length(spark.createDataFrame(rows, "k int, day date, value double"), "k", 5.0).collect()}
    assert got == {2001: 150, 2002: 0, 2003: 215, 2005: 0}


@pytest.mark.parametrize(("low", "high", "corners", "seen", "gone"), [(3, 8, 4, 5, 20), (3, 8, 3, 5, 0.5), (10, 50, 4, 30, 1), (10, 60, 3, 30, 1)])
def test_bandpass_response(spark, low, high, corners, seen, gone):
    t = np.arange(2000) / 100
    df = spark.createDataFrame([(i, np.sin(2 * np.pi * f * t).tolist()) for i, f in enumerate((seen, gone))], "trace_id long, samples array<double>")
    a, b = (np.array(r.samples)[500:1500] for r in sequences.bandpass(df, 100.0, low, high, corners, True).orderBy("trace_id").collect())
    assert 0.9 < np.abs(a).max() < 1.1 and np.abs(b).max() < 0.02


def test_viterbi(spark):
    x = [0.1, -0.2, 0.0, 3.1, 2.9, 3.0, 0.1]
    got = sequences.viterbi(spark.createDataFrame([(1, i, v) for i, v in enumerate(x)] + [(2, 0, 9.0)], "series_id long, place long, value double"), [0.0, 3.0], 0.5, 0.9)
    rows = got.orderBy("series_id", "place").collect()
    assert [r.state for r in rows] == [1, 1, 1, 2, 2, 2, 1, 3]


def test_rmsd_ignores_rotation(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(8, 3))
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    rows = [(f, i, *map(float, v)) for f, q in enumerate((p, p @ turn + 5, p * 1.1)) for i, v in enumerate(q)]
    frames = spark.createDataFrame(rows, "frame long, atom int, x double, y double, z double")
    got = [r.rmsd for r in sequences.superposed_rmsd(frames, frames.where("frame = 0").drop("frame")).orderBy("frame").collect()]
    assert got[0] == pytest.approx(0, abs=1e-6) and got[1] == pytest.approx(0, abs=1e-6) and got[2] > 0.05


def test_box_finds_period(spark):
    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(0, 60, 1500))
    y = 1 - 0.2 * ((t % 1.5) < 0.15) + rng.normal(0, 0.01, len(t))
    got = sequences.box_least_squares(spark.createDataFrame([(0, float(a), float(b), 0.01) for a, b in zip(t, y, strict=True)], "curve_id long, t double, y double, dy double"), [1.1, 1.5, 2.3], 0.15).collect()
    best = max(got, key=lambda r: r.snr)
    assert best.period == 1.5 and best.depth == pytest.approx(0.2, abs=0.03)


def test_tensor_isotropic(spark):
    dirs = np.random.default_rng(1).normal(size=(20, 3))
    dirs /= np.linalg.norm(dirs, axis=1, keepdims=True)
    design = [[0.0] * 6 + [1.0]] + [[-x * x, -y * y, -z * z, -2 * x * y, -2 * x * z, -2 * y * z, 1.0] for x, y, z in dirs]
    signal = [100.0] + [100 * math.exp(-0.7)] * 20
    r = sequences.tensor_fit(spark.createDataFrame([(1, signal)], "voxel_id long, signal array<double>"), design).first()
    assert r.fa == pytest.approx(0, abs=1e-5) and r.md == pytest.approx(0.7, rel=1e-6)


def test_pairs_and_neighbours(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(-5, 5, (80, 3))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id long, x double, y double, z double")
    got = {(r.a, r.b) for r in geometry.pairs_within(df, 2.0, ["x", "y", "z"]).collect()}
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if ((p[i] - p[j]) ** 2).sum() <= 4}
    v = df.select("id", F.array("x", "y", "z").alias("v"))
    near = geometry.nearest(v, v.where("id < 5"), 4).collect()
    for i in range(5):
        order = np.lexsort((np.arange(80), np.sqrt(((p - p[i]) ** 2).sum(1))))[:4]
        assert [r.nbr_id for r in sorted(near, key=lambda r: r["rank"]) if r.id == i] == order.tolist()


def test_fuzzy_weights_reach_target(spark):
    rng = np.random.default_rng(6)
    v = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "id long, v array<double>")
    got = geometry.fuzzy_weights(geometry.nearest(v, v, 9)).groupBy("src").agg(F.sum("weight").alias("s"), F.max("weight").alias("m")).collect()
    assert all(r.s == pytest.approx(math.log2(9), abs=1e-3) and r.m == pytest.approx(1) for r in got)


def test_communities_find_blocks(spark):
    rng = random.Random(1)
    edges = [(a, b, 1.0) for block in (range(0, 12), range(20, 32)) for a in block for b in block if a < b and rng.random() < 0.8] + [(3, 25, 0.1)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    labels = geometry.label_communities(df, 6)
    got = {r.node: r.label for r in labels.collect()}
    assert len({got[i] for i in range(12) if i in got}) == 1 and got[1] != got[21]
    assert geometry.modularity(df, labels).first().modularity > 0.4


def test_cox_gradient_is_zero(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 2))
    t = np.round(np.minimum(rng.exponential(np.exp(-x @ [0.7, -0.4])), 1.5), 1)
    e = (t < 1.5).astype(int)
    fit = models.cox_regression(spark.createDataFrame([(float(a), int(b), *map(float, c)) for a, b, c in zip(t, e, x, strict=True)], "T double, E int, x0 double, x1 double"), "T", "E", ["x0", "x1"]).collect()

    def loglik(beta):
        r, out = np.exp(x @ beta), 0.0
        for u in np.unique(t[e == 1]):
            d = (t == u) & (e == 1)
            for p in range(d.sum()):
                out -= math.log(r[t >= u].sum() - p / d.sum() * r[d].sum())
            out += (x[d] @ beta).sum()
        return out

    b = np.array([r.coefficient for r in fit])
    for i in range(2):
        h = np.eye(2)[i] * 1e-4
        assert (loglik(b + h) - loglik(b - h)) / 2e-4 == pytest.approx(0, abs=1e-4)


def test_pca_matches_svd(spark, cells, obs, dense):
    scores, loadings, variances = models.principal_components(cells, obs, 3)
    used = [j for j in range(M) if dense[:, j].any()]
    c = dense[:, used] - dense[:, used].mean(0)
    s = np.linalg.svd(c, compute_uv=False)
    assert [r.variance for r in variances.orderBy("pc").collect()] == pytest.approx((s[:3] ** 2 / (N - 1)).tolist())
    got = np.zeros((N, 3))
    for r in scores.collect():
        got[r.row_id, r.pc] = r.score
    w = np.zeros((M, 3))
    for r in loadings.collect():
        w[r.col_id, r.pc] = r.loading
    assert np.allclose(got, (dense - dense.mean(0)) @ w)


def test_eigengenes_and_trend(spark, cells, obs):
    grid = matrix.densify(cells, obs, cells.select("col_id").distinct())
    modules = spark.createDataFrame([(j, "m") for j in range(6)], "col_id long, module string")
    got = models.module_eigengenes(grid, modules).collect()
    assert sum(r.eigengene**2 for r in got) == pytest.approx(1) and 0 < got[0].explained <= 1
    chosen = models.variance_trend_features(cells, obs, 4).where("highly_variable").count()
    assert chosen == 4


def test_loess_follows_a_parabola():
    x = np.linspace(0, 3, 60)
    assert np.allclose(models.loess(x, 2 + x - 0.5 * x**2), 2 + x - 0.5 * x**2, atol=1e-6)


def test_regression_solvers(spark):
    rng = np.random.default_rng(8)
    x, w = rng.normal(size=(100, 2)), rng.uniform(0.5, 2, 100)
    y = x @ [1.5, -2.0] + rng.normal(0, 0.1, 100)
    rows = [(float(c), float(d), *map(float, a)) for a, c, d in zip(x, y, w, strict=True)]
    got = [r.coefficient for r in models.weighted_least_squares(spark.createDataFrame(rows, "y double, w double, a double, b double"), "y", ["a", "b"], "w").collect()]
    assert got == pytest.approx(np.linalg.solve((x.T * w) @ x, (x.T * w) @ y).tolist())
    counts = rng.poisson(np.exp(0.3 + x @ [0.5, -0.2]))
    df = spark.createDataFrame([(float(c), 1.0, *map(float, a)) for a, c in zip(x, counts, strict=True)], "y double, one double, a double, b double")
    beta = np.array([r.coefficient for r in models.poisson_regression(df, "y", ["one", "a", "b"]).collect()])
    full = np.column_stack([np.ones(100), x])
    assert np.abs(full.T @ (counts - np.exp(full @ beta))).max() < 1e-3


def test_dispersion_is_a_maximum(spark):
    y = np.random.default_rng(9).negative_binomial(4, 0.3, 200).astype(float)
    a = models.dispersion_fit(spark.createDataFrame([(1, y.tolist(), [float(y.mean())] * 200)], "col_id long, ys array<double>, mus array<double>")).first().log_alpha
    assert a == pytest.approx(math.log(1 / 4), abs=0.5)


def test_decontamination(cells, obs):
    got = models.decontaminate(cells, obs.select("row_id", (F.col("row_id") % 2).alias("z")), 4).collect()
    assert all(0 <= r.contamination <= 1 for r in got)


def test_diffusion_keeps_mass():
    x = models.implicit_diffusion([0, 0, 9, 0, 0], 1.0, 0.1, 1.0, 50)
    assert sum(x) == pytest.approx(9) and max(x) < 9 and x == pytest.approx(x[::-1])


def test_gate(spark):
    rows = spark.createDataFrame([(0.5, "lte", 1.0), (0.99, "lte", 1.0), (1.01, "lte", 1.0), (2.0, "gte", 1.0), (None, "gte", 1.0), (0.96, "gte", 0.95), (0.951, "gte", 0.95), (0.949, "gte", 0.95), (0.049, "lte", 0.05)], "v double, c string, t double")
    assert [r.g for r in rows.select(benchmarks.gate(F.col("v"), F.col("c"), F.col("t")).alias("g")).collect()] == ["PASS", "BORDERLINE", "FAIL", "PASS", "FAIL", "PASS", "BORDERLINE", "FAIL", "BORDERLINE"]
    near = spark.createDataFrame([(5.6, 0.019), (5.8, 0.019), (0.1, 0.0), (0.1, None)], "d double, cv double")
    assert [r.n for r in near.select(benchmarks.speed_borderline(F.col("d"), F.col("cv")).alias("n")).collect()] == [True, False, False, False]


def test_sessions_stream_like_tables(spark, tmp_path):
    import datetime as dt

    rows = [(u, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for u, ms in ((1, (0, 5, 9, 60, 61)), (2, (3, 30))) for m in ms] + [(9, dt.datetime(2024, 1, 9))]
    table = spark.createDataFrame(rows, "user long, ts timestamp")
    table.write.parquet(str(tmp_path / "in"))
    stream = session_minutes(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), "user", "ts", 10, "1 minute")
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("sessions").collect()))
    want = sorted(map(tuple, session_minutes(table, "user", "ts", 10).collect()))
    assert got == [w for w in want if w[0] != 9]


def test_registry(spark, cells):
    assert {"matrix", "markers", "sets", "tables", "benchmarks", "sequences", "geometry", "models", "sources", "sinks"} <= set(REGISTRY.groups())
    with pytest.raises(KeyError, match="row_sums"):
        REGISTRY.get("row_sum")
    assert REGISTRY.inspect("row_sums")["ids"] == ("G1",)
    mine = OperatorRegistry()
    mine.add(Operator("double", lambda df: df.withColumn("v", F.col("value") * 2), reference=lambda df: df.withColumn("v", F.col("value") + F.col("value"))))
    assert mine.verify("double", cells)
    with mine.disabled("double"):
        assert not mine.status()["double"]
    assert mine.status()["double"] and mine.benchmark("double", cells, reps=2)["n"] == 2
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        mine.add(Operator("double", lambda df: df))
    assert seen
    mine.get("double").tested = "0.1"
    with pytest.raises(RuntimeError):
        mine.activate("double", strict=True)
    assert threads(99) == 16 and threads(2) == 2 and threads() == 4


def test_fits(spark):
    from quern.operators import fits

    rng = np.random.default_rng(11)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + 2 * x)))).astype(int)
    df = spark.createDataFrame([(1, int(b), 1.0, float(a)) for a, b in zip(x, y, strict=True)] + [(2, 1, 1.0, 5.0), (2, 0, 1.0, -5.0)], "col_id long, y int, one double, x double")
    got = {(r.col_id, r.term): r.coefficient for r in fits.bayes_logistic(df, ["one", "x"]).collect()}
    assert got[1, "x"] == pytest.approx(2, abs=0.5) and 0 < got[2, "x"] < 5
    t = np.sort(rng.uniform(0, 1, 150))
    c = rng.poisson(np.exp(1 + 2 * t))
    r = fits.smooth_counts(spark.createDataFrame([(1, float(a), float(b), 0.0) for a, b in zip(t, c, strict=True)], "col_id long, t double, y double, offset double")).first()
    assert r.start == pytest.approx(1, abs=0.5) and r.end == pytest.approx(3, abs=0.4)


def test_spots(spark):
    from quern.operators import fits

    profiles = {"a": [90, 5, 5, 1, 1], "b": [1, 80, 1, 10, 8], "c": [1, 1, 1, 1, 96]}
    ref = spark.createDataFrame([(f"g{i}", k, float(v)) for k, p in profiles.items() for i, v in enumerate(p)], "gene string, type string, mean double")
    rng = np.random.default_rng(3)
    mix = {1: np.array(profiles["a"]) * 10, 2: np.array(profiles["a"]) * 6 + np.array(profiles["c"]) * 4}
    counts = spark.createDataFrame([(s, f"g{i}", float(rng.poisson(v))) for s, p in mix.items() for i, v in enumerate(p)], "spot_id long, gene string, count double")
    got = {r.spot_id: r for r in fits.deconvolve_spots(counts, ref).collect()}
    assert (got[1].first_type, got[1]["class"]) == ("a", "singlet")
    assert (got[2].first_type, got[2].second_type, got[2]["class"]) == ("a", "c", "doublet_certain") and got[2].weight == pytest.approx(0.6, abs=0.05)


def test_curve_and_layout(spark):
    from quern.operators import fits

    a = np.linspace(0, np.pi, 120)
    rng = np.random.default_rng(4)
    pts = np.column_stack([np.cos(a), np.sin(a)]) + rng.normal(0, 0.02, (120, 2))
    got = fits.principal_curve(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pts)], "id long, v array<double>")).orderBy("id").collect()
    lam = np.array([r["lambda"] for r in got])
    assert abs(np.corrcoef(lam, a)[0, 1]) > 0.97 and np.mean([r.distance for r in got]) < 0.15
    edges = [(i, j, 1.0) for b in (0, 20) for i in range(b, b + 15) for j in range(i + 1, b + 15)]
    xy = {r.node: np.array([r.x, r.y]) for r in fits.layout(spark.createDataFrame(edges, "src long, dst long, weight double"), 150).collect()}
    inside = np.mean([np.linalg.norm(xy[i] - xy[j]) for i, j, _ in edges])
    assert inside < 0.5 * np.linalg.norm(np.mean([xy[i] for i in range(15)], 0) - np.mean([xy[i] for i in range(20, 35)], 0))


def test_simulated_counts(spark):
    from quern.operators import fits

    got = fits.simulate_counts(spark.range(3000).selectExpr("id as row_id", "1.0D as depth"), spark.createDataFrame([(0, 0.5), (1, 4.0), (2, 30.0)], "col_id long, mean double"))
    for r in got.groupBy("col_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q")).collect():
        mean = r.s / 3000
        assert mean == pytest.approx([0.5, 4, 30][r.col_id], rel=0.06) and r.q / 3000 - mean**2 == pytest.approx(mean, rel=0.12)
    model = fits.offset_models(got, spark.range(3000).selectExpr("id as row_id", "34.5D as base"), 500, 10).collect()
    assert len(model) == 3 and all(r.theta > 0 for r in model)


def test_command_line(capsys):
    from quern.__main__ import main

    assert main(["list", "markers"]) == 0 and "rank_sums" in capsys.readouterr().out
    assert main(["inspect", "row_sums"]) == 0 and '"G1"' in capsys.readouterr().out
    assert main(["queries"]) == 0 and "rank_genes_groups" in capsys.readouterr().out
    assert main([]) == 2


def test_row_numbers(spark):
    from pyspark.sql import Window as W

    from quern.operators.order import row_numbers

    df = spark.range(5000).select("id", (F.xxhash64("id") % 50).alias("k")).repartition(7)
    want = df.withColumn("n", F.row_number().over(W.orderBy(F.desc("k"), "id")))
    assert sorted(map(tuple, row_numbers(df, [F.desc("k"), F.asc("id")], "n").collect())) == sorted(map(tuple, want.collect()))
    assert row_numbers(df.limit(0), [F.asc("id")], "n").collect() == []


def test_ship(spark, monkeypatch, tmp_path):
    from quern import workers

    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: sent.append(path))
    monkeypatch.setattr(spark.sparkContext, "_quern_shipped", False, raising=False)
    workers.ship(spark)
    assert sent == []
    monkeypatch.setenv("PYTHONPATH", "")
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(spark.sparkContext, "_quern_shipped", False, raising=False)
    workers.ship(spark)
    workers.ship(spark)
    assert len(sent) == 1 and sent[0].endswith("quern.zip")

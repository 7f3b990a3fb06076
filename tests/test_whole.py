"""Registered queries cover every row of their tables: against brute force on tables with ids and lines beyond any prefix."""

import random

import numpy as np
import pytest

from quern.operators import fits, geometry, sequences
from quern.plans import all_queries
from quern.plans.base import Tables
from quern.plans.sequences import _knn, _vectors

QUERIES = all_queries()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """70 suppliers with lines 1 to 4, and 80 vectors."""
    rng = random.Random(1)
    folder = tmp_path_factory.mktemp("whole")
    lines = [(o, n, o % 70 + 1, float(rng.randint(1, 50)), rng.randint(0, 10) / 100) for o in range(1, 1401) for n in range(1, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{folder}/lineitem.parquet")
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(80)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder), lines


def test_bandpass_takes_every_vector(spark, tables):
    got = {r.trace_id: r.samples for r in QUERIES["bandpass"].run(spark, tables[0]).collect()}
    assert sorted(got) == list(range(80))
    sections = sequences._butterworth(1.0, 20.0, 100.0, 4)
    for r in spark.read.parquet(f"{tables[0]}/embeddings.parquet").where("vec_id >= 75").collect():
        once = sequences._run_sections(np.array(r.embedding * 4, float), sections)
        assert np.allclose(got[r.vec_id], sequences._run_sections(once[::-1], sections)[::-1], atol=1e-6)


def test_smooth_counts_takes_every_line(spark, tables):
    got = {r.col_id: r.deviance for r in QUERIES["smooth_counts"].run(spark, tables[0]).collect()}
    assert sorted(got) == list(range(1, 71))
    for supplier in (1, 19, 20, 70):
        sums = {}
        for _, _, s, quantity, discount in tables[1]:
            if s == supplier:
                sums[discount * 10] = sums.get(discount * 10, 0.0) + quantity
        alone = spark.createDataFrame([(supplier, t + y * 1e-6, y, 0.0) for t, y in sums.items()], "col_id long, t double, y double, offset double")
        assert fits.smooth_counts(alone).first().deviance == pytest.approx(got[supplier], abs=2e-3)


def test_implicit_diffusion_takes_every_supplier(spark, tables):
    got = [r.value for r in QUERIES["implicit_diffusion"].run(spark, tables[0]).orderBy("cell").collect()]
    x = np.array([np.mean([q for _, _, s, q, _ in tables[1] if s == k]) for k in range(1, 71)])
    a = np.diag(np.full(70, 1.2)) - 0.1 * (np.eye(70, k=1) + np.eye(70, k=-1))
    a[0, 0] = a[-1, -1] = 1.1
    for _ in range(20):
        x = np.linalg.solve(a, x)
    assert np.allclose(got, x, atol=1e-6)


def test_curve_and_layout_run_with_defaults(spark, tables):
    t = Tables(spark, tables[0])
    want = {r.id: r.distance for r in fits.principal_curve(_vectors(t)).collect()}
    assert {r.id: r.distance for r in QUERIES["principal_curve"].run(spark, tables[0]).collect()} == pytest.approx(want, abs=1e-4)
    want = {r.node: r.x for r in fits.layout(geometry.symmetrize(geometry.fuzzy_weights(_knn(t)))).collect()}
    assert {r.node: r.x for r in QUERIES["layout"].run(spark, tables[0]).collect()} == pytest.approx(want, abs=1e-6)


def test_offset_models_runs_with_defaults(spark, data, monkeypatch):
    given = []
    run = fits.offset_models
    monkeypatch.setattr(fits, "offset_models", lambda *a, **b: given.append((a[2:], b)) or run(*a, **b))
    QUERIES["offset_models"].run(spark, str(data))
    assert given == [((), {})]


def test_communities_settle(spark):
    """Along a path whose weights fall, a label moves on by one node a round."""
    path = [(i, i + 1, 100.0 - i) for i in range(14)]
    labels = geometry.label_communities(spark.createDataFrame(path, "src long, dst long, weight double"))
    assert {r.label for r in labels.collect()} == {1}

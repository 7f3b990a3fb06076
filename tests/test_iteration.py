"""Plans of iterative operators do not grow with their rounds, and scratch tables go where they should."""

import os

import pytest

from quern import scratch
from quern.operators import geometry, models


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.fixture(scope="module")
def counts(spark):
    return spark.range(400).selectExpr("id % 20 as row_id", "id div 20 as col_id", "cast(1 + id * 7 % 5 as double) as value")


def test_decontamination_by_rounds(spark, counts):
    z = spark.range(20).selectExpr("id as row_id", "id % 2 as z")
    plans = {n: models.decontaminate(counts, z, n) for n in (1, 2, 10)}
    assert len({exchanges(df) for df in plans.values()}) == 1 and exchanges(plans[10]) < 4
    got = {r.row_id: r.contamination for r in plans[10].collect()}
    assert len(got) == 20 and all(0 < x < 1 for x in got.values())


def test_communities_by_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0 + i % 3) for i in range(12)], "src long, dst long, weight double")
    with pytest.warns(UserWarning):
        few = exchanges(geometry.label_communities(edges, 1))
        assert exchanges(geometry.label_communities(edges, 3)) == few


def test_scratch(spark, counts):
    table = scratch.materialize(counts, "some")
    path = scratch.seen(table)["path"]
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and scratch.seen(table)["rows"] == 400
    assert os.path.isdir(path.removeprefix("file://"))
    scratch.release(table)
    assert not os.path.exists(path.removeprefix("file://"))
    assert "broadcast" in scratch.bounded(counts, 400)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in scratch.bounded(counts, 399)._jdf.queryExecution().analyzed().toString().lower()

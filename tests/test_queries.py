"""Every registered query of this library beside its SQL, on the smallest tables."""

import importlib.util
import math

import duckdb
import pytest

from quern.plans import all_queries

QUERIES = all_queries()


@pytest.fixture(scope="session")
def sql(data):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in data.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, sql, name):
    q = QUERIES[name]
    df = q.run(spark, str(data))
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if q.sql is None:
        assert ours
        return
    rel = sql.sql(q.sql)
    assert sorted(rel.columns) == cols
    theirs = sorted((tuple(map(plain, r)) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()), key=str)
    assert ours == theirs


def test_entry(spark):
    spec = importlib.util.find_spec("__spark_entry__")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert entry.entry(spark).columns == ["grp", "col_id", "z", "p_adj", "log2fc", "pts", "pts_rest", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(QUERIES) > 150

"""Queries over sparse matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import matrix as m
from quern.plans.base import query, r


@query("G1", sql="SELECT row_id, sum(value) AS total FROM @cells GROUP BY row_id")
def row_sums(t):
    return m.row_sums(t.cells())


@query("M1", sql="""
WITH s AS (SELECT row_id, sum(value) AS total FROM @cells GROUP BY row_id), g AS (SELECT median(total) AS goal FROM s WHERE total > 0)
SELECT row_id, col_id, round(value * goal / total, 6) + 0.0 AS value FROM cells JOIN s USING (row_id), g""")
def normalize_total(t):
    return m.normalize_total(t.cells()).withColumn("value", r("value"))


@query("M2", sql="SELECT row_id, col_id, round(ln(1 + value), 6) + 0.0 AS value FROM @cells")
def log1p(t):
    return m.log1p(t.cells()).withColumn("value", r("value"))


LOGGED = "logged AS (SELECT row_id, col_id, ln(1 + 1e4 * value / sum(value) OVER (PARTITION BY row_id)) AS value FROM @cells)"


@query("M3", sql=f"WITH {LOGGED} SELECT row_id, col_id, round(value, 6) + 0.0 AS value FROM logged")
def log_normalize(t):
    return m.log_normalize(t.cells()).withColumn("value", r("value"))


@query("M13", sql="SELECT row_id, col_id, round(log2(value + 1), 6) + 0.0 AS value FROM @cells")
def log2_plus_one(t):
    return m.log2_plus_one(t.cells()).withColumn("value", r("value"))


@query("M13", sql="SELECT row_id, col_id, round(value + 1, 6) AS value FROM @cells")
def power_of_two(t):
    return m.power_of_two(m.log2_plus_one(t.cells())).withColumn("value", r("value"))


@query("M14", sql="""
WITH s AS (SELECT o.row_id, coalesce(sum(value), 0) AS total FROM @obs o LEFT JOIN @cells c ON o.row_id = c.row_id GROUP BY o.row_id), g AS (SELECT median(total) AS goal FROM s)
SELECT c.row_id, col_id, round(value * goal / total, 6) + 0.0 AS value FROM cells c JOIN s ON c.row_id = s.row_id, g""")
def normalize_depth(t):
    return m.normalize_depth(t.cells(), t.obs()).withColumn("value", r("value"))


@query("G2", "G9", sql="""
WITH n AS (SELECT count(*) AS n FROM @obs)
SELECT col_id, sum(value) AS total, round(sum(value) / n, 9) AS mean, round((sum(value * value) - sum(value) * sum(value) / n) / (n - 1), 6) AS var,
  count(*) FILTER (value <> 0) AS nnz, count(*) FILTER (value > 20) AS detected FROM @cells, n GROUP BY col_id, n""")
def column_stats(t):
    return m.column_stats(t.cells(), t.obs(), 20.0).withColumns({"mean": r("mean", 9), "var": r("var")})


@query("G2", sql="""
WITH n AS (SELECT count(*) AS n FROM @panel_obs)
SELECT col_id, sum(value) AS total, count(*) FILTER (value <> 0) AS nnz, count(*) FILTER (value > -1) + n - count(*) FILTER (value <> 0) AS detected FROM @panel, n GROUP BY col_id, n""")
def column_stats_zeros_detected(t):
    return m.column_stats(t.panel(), t.panel_obs(), -1.0).select("col_id", "total", "nnz", "detected")


@query("G3", "G5", sql="""
WITH s AS (SELECT grp, count(*) AS size FROM @obs WHERE grp IS NOT NULL GROUP BY grp)
SELECT col_id, o.grp, sum(value) AS total, round(sum(value) / size, 9) AS mean, count(*) FILTER (value > 10) AS detected, size
FROM @cells c JOIN obs o ON c.row_id = o.row_id JOIN s ON o.grp = s.grp GROUP BY col_id, o.grp, size""")
def group_summary(t):
    return m.group_summary(t.cells(), t.obs(), 10.0).withColumn("mean", r("mean", 9))


@query("G3", sql="""
WITH s AS (SELECT grp, count(*) AS size FROM @panel_obs GROUP BY grp), g AS (SELECT col_id, grp, size FROM (SELECT DISTINCT col_id FROM @panel), s),
v AS (SELECT col_id, grp, sum(value) AS total, count(*) AS k FROM panel JOIN panel_obs USING (row_id) GROUP BY ALL)
SELECT g.col_id, g.grp, coalesce(total, 0) AS total, round(coalesce(total, 0) / size, 9) AS mean, coalesce(k, 0) AS detected, size FROM g LEFT JOIN v ON g.col_id = v.col_id AND g.grp = v.grp""")
def group_summary_dense(t):
    return m.group_summary(t.panel(), t.panel_obs(), dense=True).withColumn("mean", r("mean", 9))


NULLED = "SELECT l_suppkey AS col_id, l_returnflag AS grp, CASE WHEN l_quantity > 49 THEN NULL ELSE l_quantity - 20 END AS value FROM lineitem"


def _nulled(t):
    return t.lineitem.select(F.col("l_suppkey").alias("col_id"), F.col("l_returnflag").alias("grp"), F.when(F.col("l_quantity") <= 49, F.col("l_quantity") - 20).alias("value"))


@query("G4", sql=f"""
SELECT col_id, grp, CASE WHEN count(*) = count(value) THEN sum(value) END AS total, CASE WHEN count(*) = count(value) THEN round(avg(value), 9) + 0.0 END AS mean,
  CASE WHEN count(*) = count(value) THEN count(*) FILTER (value > 0) END AS detected FROM ({NULLED}) GROUP BY ALL""")
def dense_group_summary(t):
    return m.dense_group_summary(_nulled(t)).withColumn("mean", r("mean", 9))


@query("G4", sql=f"SELECT col_id, grp, coalesce(sum(value), 0) AS total, round(avg(value), 9) + 0.0 AS mean, count(*) FILTER (value > 0) AS detected FROM ({NULLED}) GROUP BY ALL")
def dense_group_summary_na_rm(t):
    return m.dense_group_summary(_nulled(t), na_rm=True).withColumn("mean", r("mean", 9))


@query("G10", sql=f"""
WITH {LOGGED} SELECT col_id, grp, count(*) AS nnz, round(sum(exp(value) - 1), 4) + 0.0 AS total FROM logged JOIN @obs USING (row_id) WHERE grp IS NOT NULL GROUP BY ALL""")
def group_expm1(t):
    return m.group_expm1(m.log_normalize(t.cells()), t.obs()).withColumn("total", r("total", 4))


@query("G7", sql="""
WITH b AS (SELECT grp, count(*) AS n FROM @panel_obs GROUP BY grp UNION ALL SELECT NULL, count(*) FROM panel_obs),
a AS (SELECT grp, col_id, sum(value) AS s, sum(value * value) AS ss FROM @panel JOIN panel_obs USING (row_id) GROUP BY GROUPING SETS ((grp, col_id), (col_id)))
SELECT a.grp, col_id, round(s / n, 6) AS mean, CASE WHEN n > 1 THEN round((ss - s * s / n) / (n - 1), 5) END AS var FROM a JOIN b ON a.grp IS NOT DISTINCT FROM b.grp""")
def batch_moments(t):
    return m.batch_moments(t.panel(), t.panel_obs()).withColumns({"mean": r("mean"), "var": r("var", 5)})


@query("G8", sql="""
WITH clip AS (SELECT grp, col_id, max(value) / 2 AS clip FROM @panel JOIN @panel_obs USING (row_id) GROUP BY ALL)
SELECT grp, col_id, round(sum(least(value, clip)), 6) AS total, round(sum(least(value, clip) * least(value, clip)), 6) AS squares FROM panel JOIN panel_obs USING (row_id) JOIN clip USING (grp, col_id) GROUP BY ALL""")
def clipped_sums(t):
    clip = t.panel().join(t.panel_obs(), "row_id").groupBy("grp", "col_id").agg((F.max("value") / 2).alias("clip"))
    return m.clipped_sums(t.panel(), t.panel_obs(), clip).withColumns({"total": r("total"), "squares": r("squares")})


@query("G9", sql="""
WITH n AS (SELECT count(*) AS n FROM @obs), f AS (SELECT col_id, sum(value) / n AS mean, sqrt((sum(value * value) - sum(value) * sum(value) / n) / (n - 1)) AS sd FROM @cells, n GROUP BY col_id, n)
SELECT col_id, round((sum(power(least((value - mean) / sd, sqrt(n)), 2)) + (n - count(*)) * power(mean / sd, 2)) / (n - 1), 6) AS variance_standardized
FROM cells JOIN f USING (col_id), n WHERE sd > 0 GROUP BY col_id, mean, sd, n""")
def standardized_variance(t):
    fitted = m.column_stats(t.cells(), t.obs()).select("col_id", "mean", F.sqrt("var").alias("sd"))
    return m.standardized_variance(t.cells(), t.obs(), fitted).withColumn("variance_standardized", r("variance_standardized"))


@query("G11", sql="""
WITH d AS (SELECT c.col_id, o.row_id, o.grp FROM (SELECT DISTINCT col_id FROM @panel) c, @panel_obs o),
q AS (SELECT d.col_id, d.grp, quantile_cont(coalesce(value, 0), [0.25, 0.5, 0.75]) AS q, count(value) AS k FROM d LEFT JOIN panel p ON p.row_id = d.row_id AND p.col_id = d.col_id GROUP BY ALL)
SELECT col_id, grp, round((q[1] + 2 * q[2] + q[3]) / 4, 6) AS trimean FROM q WHERE k > 0""")
def group_trimean(t):
    return m.group_trimean(t.panel(), t.panel_obs()).withColumn("trimean", r("trimean"))


GRID = """grid AS MATERIALIZED (SELECT o.row_id, c.col_id, coalesce(value, 0) AS value FROM @panel_obs o CROSS JOIN (SELECT DISTINCT col_id FROM @panel) c LEFT JOIN panel p ON p.row_id = o.row_id AND p.col_id = c.col_id)"""


def _grid(t):
    return m.densify(t.panel(), t.panel_obs(), t.panel().select("col_id").distinct())


@query("M4", sql=f"""
WITH {GRID}, s AS (SELECT col_id, avg(value) AS mean, stddev_samp(value) AS sd FROM grid GROUP BY col_id)
SELECT row_id, col_id, round(greatest(least((value - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 2), -2), 5) + 0.0 AS value FROM grid JOIN s USING (col_id)""")
def scale(t):
    return m.scale(t.panel(), t.panel_obs(), 2.0).withColumn("value", r("value", 5))


@query("M5", sql=f"""
WITH {GRID}, s AS (SELECT col_id, avg(value) AS mean, stddev_samp(value) AS sd FROM grid GROUP BY col_id)
SELECT row_id, col_id, round(least((value - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 1.5), 5) + 0.0 AS value FROM grid JOIN s USING (col_id)""")
def scale_upper(t):
    return m.scale(t.panel(), t.panel_obs(), 1.5, both_sides=False).withColumn("value", r("value", 5))


DISPERSIONS = f"""{LOGGED}, n AS (SELECT count(*) AS n FROM @obs),
a AS (SELECT col_id, sum(exp(value) - 1) AS s, sum((exp(value) - 1) * (exp(value) - 1)) AS ss, any_value(n) AS n FROM logged, n GROUP BY col_id),
b AS (SELECT col_id, s / n AS mu, greatest(ss - s * s / n, 0) / (n - 1) AS v FROM a),
c AS (SELECT col_id, ln(1 + mu) AS means, CASE WHEN v > 0 THEN ln(v / mu) END AS dispersions FROM b),
e AS (SELECT min(means) AS low, max(means) AS high FROM c),
d AS (SELECT c.*, CAST(least(greatest(floor((means - low) / ((high - low) / 20)), 0), 19) AS INT) AS bin FROM c, e),
f AS (SELECT bin, avg(dispersions) AS mu, stddev_samp(dispersions) AS sd, count(dispersions) AS k FROM d GROUP BY bin),
h AS (SELECT col_id, means, dispersions, bin, CASE WHEN k = 1 THEN 1 ELSE (dispersions - mu) / CASE WHEN sd = 0 THEN mu ELSE sd END END AS dispersions_norm FROM d JOIN f USING (bin))"""


@query("G6", "W8", sql=f"WITH {DISPERSIONS} SELECT col_id, round(means, 6) AS means, round(dispersions, 6) + 0.0 AS dispersions, bin, round(dispersions_norm, 5) + 0.0 AS dispersions_norm FROM h")
def dispersions(t):
    got = m.dispersions(m.log_normalize(t.cells()), t.obs())
    return got.withColumns({"means": r("means"), "dispersions": r("dispersions"), "dispersions_norm": r("dispersions_norm", 5)})


@query("M6", "K3", sql=f"WITH {DISPERSIONS} SELECT col_id, dispersions_norm IS NOT NULL AND dispersions_norm >= (SELECT min(x) FROM (SELECT dispersions_norm AS x FROM h WHERE dispersions_norm IS NOT NULL ORDER BY 1 DESC LIMIT 100)) AS highly_variable FROM h")
def variable_features_top(t):
    return m.variable_features(m.log_normalize(t.cells()), t.obs(), 100).select("col_id", "highly_variable")


@query("M6", "M9", "P14", sql=f"WITH {DISPERSIONS} SELECT col_id, means > 0.0125 AND means < 5 AND coalesce(dispersions_norm, 0) > 0.5 AS highly_variable FROM h")
def variable_features_limits(t):
    return m.variable_features(m.log_normalize(t.cells()), t.obs(), max_mean=5.0).select("col_id", "highly_variable")


@query("P8", sql="WITH k AS (SELECT col_id FROM @cells GROUP BY col_id HAVING sum(value) / (SELECT count(*) FROM @obs) >= 0.05) SELECT row_id, col_id, value FROM cells WHERE col_id IN (SELECT col_id FROM k)")
def columns_by_mean(t):
    return m.columns_by_mean(t.cells(), t.obs(), 0.05).select("row_id", "col_id", "value")


@query("P9", "P10", sql="WITH k AS (SELECT col_id FROM @cells GROUP BY col_id HAVING count(*) FILTER (value > 0) >= 31) SELECT row_id, col_id, value FROM cells WHERE col_id IN (SELECT col_id FROM k)")
def columns_by_count(t):
    return m.columns_by_count(t.cells(), 31).select("row_id", "col_id", "value")


@query("P11", sql=f"SELECT col_id, count(*) = count(value) AS complete, coalesce(var_samp(value) > 0, false) AS varies FROM ({NULLED}) GROUP BY col_id")
def good_columns(t):
    return m.good_columns(_nulled(t))


@query("P12", "P13", sql="SELECT bool_and(isfinite(value)) AS finite, bool_or(value < 0 OR value <> floor(value)) AS not_counts FROM @cells")
def value_checks(t):
    return m.value_checks(t.cells())


REFERENCES = "SELECT * FROM panel_obs WHERE grp IN ('ASIA', 'EUROPE')"
SUBTRACTED = f"{GRID}, g AS (SELECT col_id, grp, avg(value) AS m FROM grid JOIN ({REFERENCES}) USING (row_id) GROUP BY ALL), l AS MATERIALIZED (SELECT col_id, min(m) AS low, max(m) AS high, avg(m) AS mid FROM g GROUP BY col_id)"


def _references(t):
    return t.panel_obs().where("grp in ('ASIA', 'EUROPE')")


@query("M15", sql=f"WITH {SUBTRACTED} SELECT row_id, col_id, round(value - least(greatest(value, low), high), 6) + 0.0 AS value FROM grid JOIN l USING (col_id)")
def subtract_reference(t):
    return m.subtract_reference(_grid(t), _references(t)).withColumn("value", r("value"))


@query("M15", sql=f"WITH {SUBTRACTED} SELECT row_id, col_id, round(value - mid, 6) + 0.0 AS value FROM grid JOIN l USING (col_id)")
def subtract_reference_mean(t):
    return m.subtract_reference(_grid(t), _references(t), bounds=False).withColumn("value", r("value"))


@query("M16", "M17", sql=f"WITH {GRID}, l AS (SELECT row_id, median(value) AS level FROM grid GROUP BY row_id) SELECT row_id, col_id, round(least(greatest(value - level, -9), 9), 6) + 0.0 AS value FROM grid JOIN l USING (row_id)")
def center_and_clamp(t):
    return m.clamp(m.center_rows(_grid(t)), 9.0).withColumn("value", r("value"))


@query("M16", sql=f"WITH {GRID}, l AS (SELECT row_id, avg(value) AS level FROM grid GROUP BY row_id) SELECT row_id, col_id, round(value - level, 6) + 0.0 AS value FROM grid JOIN l USING (row_id)")
def center_by_mean(t):
    return m.center_rows(_grid(t), "mean").withColumn("value", r("value"))


ORDER = "o AS (SELECT DISTINCT col_id, CAST(col_id % 3 AS INT) AS block, (col_id - col_id % 3) // 3 + CASE WHEN col_id % 3 = 0 THEN 0 ELSE 1 END AS place FROM grid)"


def _order(t):
    return t.panel().select("col_id").distinct().select("col_id", (F.col("col_id") % 3).cast("int").alias("block"), F.expr("(col_id - col_id % 3) div 3 + if(col_id % 3 = 0, 0, 1)").alias("place"))


@query("W15", "W16", sql=f"""
WITH {GRID}, {ORDER}, p AS (SELECT * FROM grid JOIN o USING (col_id))
SELECT a.row_id, a.col_id, round(sum(b.value * (6 - abs(a.place - b.place))) / sum(6 - abs(a.place - b.place)), 6) + 0.0 AS value
FROM p a JOIN p b ON a.row_id = b.row_id AND a.block = b.block AND abs(a.place - b.place) <= 5 GROUP BY ALL""")
def smooth(t):
    return m.smooth(_grid(t), _order(t), 11).withColumn("value", r("value"))


@query("M18")
def copy_number_smoothing(t):
    return m.copy_number_smoothing(t.panel(), t.panel_obs(), _references(t), _order(t), window=11).withColumn("value", r("value"))


@query("M19", sql=f"""
WITH {GRID}, n AS (SELECT count(*) AS n FROM panel_obs), b AS (SELECT row_id, sum(value) AS base FROM grid GROUP BY row_id), t AS (SELECT sum(base) AS total FROM b),
f AS (SELECT col_id, ln(sum(value) / total) AS b0, 2.0 AS theta FROM grid, t GROUP BY col_id, total),
u AS (SELECT row_id, col_id, value, exp(b0) * base AS mu, theta FROM grid JOIN b USING (row_id) JOIN f USING (col_id))
SELECT row_id, col_id, round(greatest(least((value - mu) / sqrt(mu + mu * mu / theta), 4), -4), 5) + 0.0 AS value FROM u""")
def pearson_residuals(t):
    return _residuals(t).withColumn("value", r("value", 5))


def _residuals(t, center=False):
    cells = t.panel()
    rows = t.panel_obs().join(m.row_sums(cells), "row_id", "left").select("row_id", F.coalesce("total", F.lit(0.0)).alias("base"))
    model = cells.groupBy("col_id").agg(F.ln(F.sum("value") / cells.agg(F.sum("value")).scalar()).alias("b0")).withColumn("theta", F.lit(2.0))
    return m.pearson_residuals(cells, rows, model, 4.0, center)


@query("M20")
def pearson_residuals_centered(t):
    return _residuals(t, True).withColumn("value", r("value", 5))


@query("M11", "M12", sql="SELECT l_orderkey AS row_id, l_partkey AS col_id, sum(l_quantity - 25) AS value FROM lineitem GROUP BY ALL HAVING sum(l_quantity - 25) <> 0")
def prepare(t):
    return m.prepare(t.lineitem.select(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("col_id"), (F.col("l_quantity") - 25).alias("value")))


@query("E28", sql="WITH v AS (SELECT p_partkey AS col_id, 1 AS k, p_retailprice AS x FROM part UNION ALL SELECT p_partkey, 2, p_size FROM part) SELECT row_id, k, round(sum(value * x), 3) AS y FROM @cells JOIN v USING (col_id) GROUP BY ALL")
def times_vector(t):
    v = t.part.select(F.col("p_partkey").alias("col_id"), F.posexplode(F.array(F.col("p_retailprice"), F.col("p_size").cast("double"))).alias("k", "x")).withColumn("k", F.col("k") + 1)
    return m.times_vector(t.cells(), v).withColumn("y", r("y", 3))


@query("G26", sql="SELECT a.col_id AS a, b.col_id AS b, sum(a.value * b.value) AS value FROM @panel a JOIN panel b ON a.row_id = b.row_id AND a.col_id <= b.col_id GROUP BY ALL")
def gram(t):
    return m.gram(t.panel())


@query("M22", sql="""
WITH th AS (SELECT row_id, row_id % 2 AS z, 0.2 + 0.1 * (row_id % 5) AS theta FROM @panel_obs), c AS (SELECT DISTINCT col_id FROM @panel),
f AS (SELECT col_id, z, (1.0 + col_id % 7 + z) / 100 AS phi, (1.0 + col_id % 4) / 50 AS eta FROM c, (VALUES (0), (1)) v(z))
SELECT p.row_id, p.col_id, round(value * theta * phi / (theta * phi + (1 - theta) * eta), 6) AS value FROM panel p JOIN th USING (row_id) JOIN f USING (z, col_id)""")
def native_counts(t):
    theta = t.panel_obs().selectExpr("row_id", "row_id % 2 as z", "0.2D + 0.1D * (row_id % 5) as theta")
    both = t.panel().select("col_id").distinct().withColumn("z", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    phi, eta = both.selectExpr("z", "col_id", "(1.0D + col_id % 7 + z) / 100 as phi"), both.selectExpr("z", "col_id", "(1.0D + col_id % 4) / 50 as eta")
    return m.native_counts(t.panel(), theta, phi, eta).withColumn("value", r("value"))

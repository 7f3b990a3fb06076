"""Queries of series, points, graphs and models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quern.operators import geometry as g
from quern.operators import matrix as mx
from quern.operators import models as md
from quern.operators import sequences as q
from quern.plans.base import query, r
from quern.plans.matrix import GRID, _grid
from quern.streaming.sessions import session_minutes as session_minutes_of

STATES = "SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS place, min(l_returnflag) AS st FROM lineitem GROUP BY ALL"


@query("W14", sql=f"""
WITH v AS ({STATES}), s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY place) - row_number() OVER (PARTITION BY k, st ORDER BY place) AS isl, count(*) OVER (PARTITION BY k) AS c FROM v),
u AS (SELECT k, st, min(place) AS first, max(place) AS last, count(*) AS n FROM s WHERE c >= 2 GROUP BY k, st, isl) SELECT k, st, first, last, n, row_number() OVER (ORDER BY k, first) AS region FROM u""")
def run_lengths(t):
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place")).agg(F.min("l_returnflag").alias("st"))
    return q.run_lengths(rows, ["k"], "place", "st")


@query("W13", "S1", sql="""
WITH d AS (SELECT r_regionkey AS k, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
a AS (SELECT k, year(day) AS year, day, value >= 200000 AS warm, row_number() OVER w AS i, count(*) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) = 4 AS fl, bool_and(value >= 200000) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS up, bool_or(value >= 200000) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS anyw FROM d WINDOW w AS (PARTITION BY k, year(day) ORDER BY day)),
f AS (SELECT k, year, min(i) FILTER (fl AND up AND strftime(day, '%m-%d') < '07-01') AS st, min(i) FILTER (fl AND NOT anyw AND strftime(day, '%m-%d') >= '07-01') AS en, max(i) AS n FROM a GROUP BY ALL)
SELECT k, year, CASE WHEN st IS NULL THEN 0 ELSE coalesce(en, n + 1) - st END AS length FROM f""")
def season_length(t):
    n = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("k"))
    daily = t.orders.join(n, F.col("o_custkey") == F.col("c_custkey")).groupBy("k", F.col("o_orderdate").cast("date").alias("day")).agg(F.avg("o_totalprice").alias("value"))
    return q.season_length(daily, "k", 200000.0, 4)


def _traces(t):
    return t.embeddings.select(F.col("vec_id").alias("trace_id"), F.flatten(F.array_repeat(F.col("embedding").cast("array<double>"), 4)).alias("samples"))


@query("G38", sql="""
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 36000000000 THEN 0 ELSE 1 END AS st FROM events), s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros, count(*) AS events FROM s GROUP BY user_id, n""")
def session_minutes(t):
    return session_minutes_of(t.events, "user_id", "ts", 600).select("user_id", F.round(F.col("minutes") * 60e6).cast("long").alias("micros"), "events")


@query("S2", "SRC9")
def bandpass(t):
    return q.bandpass(_traces(t), 100.0, 1.0, 20.0, 4, True).select("trace_id", F.transform("samples", lambda x: F.round(x, 6)).alias("samples"))


@query("S3")
def box_least_squares(t):
    curve = t.events.select((F.col("user_id") % 3).alias("curve_id"), (F.col("event_id") % 1000 / 10).alias("t"), F.col("value").alias("y"), F.lit(1.0).alias("dy"))
    return q.box_least_squares(curve, [1.0, 1.5, 2.5, 4.0], 0.2)


@query("E29")
def viterbi(t):
    series = t.lineitem.groupBy(F.col("l_suppkey").alias("series_id"), F.col("l_orderkey").alias("place")).agg(F.avg("l_quantity").alias("value"))
    return q.viterbi(series, [5.0, 15.0, 25.0, 35.0, 45.0], 8.0, 0.9)


def _frames(t):
    """Vectors as frames of atoms: three numbers to an atom."""
    xyz = F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(i.alias("atom"), *[F.col("e")[3 * i + j].cast("double").alias(c) for j, c in enumerate("xyz")])))
    return t.embeddings.select(F.col("vec_id").alias("frame"), F.col("embedding").alias("e")).select("frame", xyz.alias("p")).select("frame", "p.*")


@query("S5", "SRC8")
def superposed_rmsd(t):
    frames = _frames(t)
    return q.superposed_rmsd(frames, frames.where("frame = 0").drop("frame")).withColumn("rmsd", r("rmsd", 5))


@query("S7")
def tensor_fit(t):
    angles = [i * 2 * math.pi / 15 for i in range(15)]
    dirs = [(math.cos(a), math.sin(a) * math.cos(3 * a), math.sin(a) * math.sin(3 * a)) for a in angles]
    design = [[0.0] * 6 + [1.0]] + [[-x * x, -y * y, -z * z, -2 * x * y, -2 * x * z, -2 * y * z, 1.0] for x, y, z in dirs]
    signal = F.transform(F.slice("embedding", 1, 16), lambda x: F.exp(-F.abs(x)).cast("double") * 100)
    return q.tensor_fit(t.embeddings.select(F.col("vec_id").alias("voxel_id"), signal.alias("signal")), design)


@query("M25", sql="SELECT CAST(n_nationkey AS DOUBLE) AS t, 1 + 2e0 * t + 0.5 * t * t AS p_x, 2 + t AS v_x, 1e0 AS a_x, 3 - t AS p_y, -1e0 AS v_y, 0e0 AS a_y FROM nation")
def orbit_at(t):
    return q.orbit_at(t.nation.select(F.col("n_nationkey").cast("double").alias("t")), {"x": [1.0, 2.0, 0.5], "y": [3.0, -1.0]})


@query("M24", sql="""
WITH e AS (SELECT r_regionkey * 10e0 AS az, 100e0 + r_regionkey AS o, 1e0 + r_regionkey AS c0, 0.5 * r_regionkey AS c1 FROM region), s AS (SELECT *, lead(az) OVER w AS az1, lead(o) OVER w AS o1, lead(c0) OVER w AS c01, lead(c1) OVER w AS c11 FROM e WINDOW w AS (ORDER BY az)),
p AS (SELECT s_suppkey, s_suppkey % 50 - 1e0 AS az, 100e0 + s_suppkey AS slant FROM supplier), j AS (SELECT p.*, (p.az - s.az) / (az1 - s.az) AS f, o, o1, c0, c01, c1, c11 FROM p LEFT JOIN s ON p.az >= s.az AND (p.az < az1 OR (p.az = az1 AND az1 = 40)))
SELECT s_suppkey AS point_id, round(c0 + (c01 - c0) * f + (c1 + (c11 - c1) * f) * (slant - (o + (o1 - o) * f)), 6) + 0.0 AS ground FROM j""")
def ground_range(t):
    epochs = t.region.select((F.col("r_regionkey") * 10.0).alias("azimuth"), (F.col("r_regionkey") + 100.0).alias("origin"), F.array(F.col("r_regionkey") + 1.0, F.col("r_regionkey") * 0.5).alias("coefficients"))
    points = t.supplier.select(F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") % 50 - 1.0).alias("azimuth"), (F.col("s_suppkey") + 100.0).alias("slant"))
    return q.ground_range(points, epochs).withColumn("ground", r("ground"))


@query("M26", "S10", sql="SELECT p_partkey AS point_id, round((p_size - 1) * 2e0 + (p_retailprice - 2) * 3 + (p_partkey - 3e0) * 4, 4) AS plane, round((p_size - 1) * 0.1 + (p_retailprice - 2) * 0.2 + (p_partkey - 3e0) * 0.3 - 29, 4) + 0.0 AS rate, round(sqrt(power(p_size - 1, 2) + power(p_retailprice - 2, 2) + power(p_partkey - 3, 2)), 5) AS slant FROM part")
def zero_doppler(t):
    fixed = {"p_x": 1.0, "p_y": 2.0, "p_z": 3.0, "v_x": 2.0, "v_y": 3.0, "v_z": 4.0, "a_x": 0.1, "a_y": 0.2, "a_z": 0.3}
    points = t.part.select(F.col("p_partkey").alias("point_id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.col("p_partkey").cast("double").alias("z"), *[F.lit(v).alias(c) for c, v in fixed.items()])
    got = q.zero_doppler(points)
    return got.select("point_id", r("plane", 4).alias("plane"), r("rate", 4).alias("rate"), r("slant", 5).alias("slant"))


@query("M23", "S10", sql="""
WITH p AS (SELECT s_suppkey AS point_id, radians(s_suppkey % 170 - 85e0) AS lat, radians(s_suppkey % 359 - 179e0) AS lon, s_acctbal AS h, 6378137e0 / sqrt(1 - 0.0066943799901413165 * power(sin(radians(s_suppkey % 170 - 85e0)), 2)) AS n FROM supplier)
SELECT point_id, round((n + h) * cos(lat) * cos(lon), 3) + 0.0 AS x, round((n + h) * cos(lat) * sin(lon), 3) + 0.0 AS y, round((n * (1 - 0.0066943799901413165) + h) * sin(lat), 3) + 0.0 AS z FROM p""")
def geodetic_to_ecef(t):
    points = t.supplier.select(F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") % 170 - 85.0).alias("lat"), (F.col("s_suppkey") % 359 - 179.0).alias("lon"), F.col("s_acctbal").alias("height"))
    return q.geodetic_to_ecef(points).withColumns({c: r(c, 3) for c in "xyz"})


@query("M27", "S10", sql="SELECT a.l_orderkey * 10 + a.l_linenumber AS point_id, p.p_size AS value FROM lineitem a LEFT JOIN part p ON p.p_partkey % 40 = CAST(floor(l_quantity / 2 + 0.5) AS BIGINT) AND p.p_partkey // 40 = CAST(floor(l_discount * 100 / 2 + 0.5) AS BIGINT)")
def nearest_cell(t):
    grid = t.part.select((F.col("p_partkey") % 40).alias("i"), F.expr("p_partkey div 40").alias("j"), F.col("p_size").alias("value"))
    points = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), F.col("l_quantity").alias("u"), (F.col("l_discount") * 100).alias("v"))
    return q.nearest_cell(points, grid, 2.0)


CURVE = "SELECT n_nationkey / 4.0 AS t, 2 * (1 - exp(-n_nationkey / 4.0)) AS u, 1 / 0.5 * (1 - exp(-0.5 * n_nationkey / 4.0)) + 1 / (0.5 - 1) * (exp(-0.5 * n_nationkey / 4.0) - exp(-n_nationkey / 4.0)) AS s FROM nation"


def _curve(t):
    return t.nation.select((F.col("n_nationkey") / 4).alias("t"))


@query("E27", sql="SELECT n_nationkey / 4.0 AS t, round(1 / 2e0 * (1 - exp(-2 * n_nationkey / 4.0)), 8) AS u, round(1 / 0.5 * (1 - exp(-0.5 * n_nationkey / 4.0)) + 1 / (0.5 - 2) * (exp(-0.5 * n_nationkey / 4.0) - exp(-2 * n_nationkey / 4.0)), 8) AS s FROM nation")
def splicing_curve(t):
    return q.splicing_curve(_curve(t), 1.0, 2.0, 0.5).withColumns({"u": r("u", 8), "s": r("s", 8)})


@query("W19", "E27", sql="WITH c AS (SELECT n_nationkey AS t, n_nationkey * 2.0 AS u, power(n_nationkey, 2) / 5.0 AS s FROM nation) SELECT p_partkey AS point_id, arg_min(t, (power(p_size - u, 2) + power(p_partkey % 100 - s, 2), t)) AS t FROM part, c GROUP BY 1")
def nearest_time(t):
    curve = t.nation.select(F.col("n_nationkey").alias("t"), (F.col("n_nationkey") * 2.0).alias("u"), (F.pow("n_nationkey", F.lit(2)) / 5).alias("s"))
    points = t.part.select(F.col("p_partkey").alias("point_id"), F.col("p_size").alias("u"), (F.col("p_partkey") % 100).alias("s"))
    return q.nearest_time(points, curve).select("point_id", "t")


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


KNN = """e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), d AS (SELECT a.vec_id AS id, b.vec_id AS nbr_id, list_distance(a.v, b.v) AS dist FROM e a, e b), kn AS (SELECT id, nbr_id, dist, row_number() OVER (PARTITION BY id ORDER BY dist, nbr_id) AS rank FROM d QUALIFY rank <= 10)"""


def _knn(t):
    return g.nearest(_vectors(t), _vectors(t), 10)


@query("W17", "W18", "N5", "K5", sql=f"WITH {KNN} SELECT id, rank, nbr_id, round(dist, 5) AS dist FROM kn WHERE id % 50 = 0")
def nearest_neighbours(t):
    return g.nearest(_vectors(t), _vectors(t).where("id % 50 = 0"), 10).withColumn("dist", r("dist", 5))


@query("N7", sql=f"WITH {KNN} SELECT x.id AS a, y.id AS b, round(count(*) / (20 - count(*)), 6) AS weight FROM kn x JOIN kn y ON x.nbr_id = y.nbr_id AND x.id < y.id GROUP BY ALL HAVING count(*) / (20 - count(*)) >= 1 / 15.0")
def shared_neighbours(t):
    return g.shared_neighbours(_knn(t), 10).withColumn("weight", r("weight"))


@query("N6", "J15")
def fuzzy_graph(t):
    return g.symmetrize(g.fuzzy_weights(_knn(t))).withColumn("weight", r("weight"))


@query("J15", sql="WITH e AS (SELECT l_suppkey AS src, l_partkey % 100 AS dst, min(l_discount) AS weight FROM lineitem WHERE l_suppkey <> l_partkey % 100 GROUP BY ALL) SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(1 - min(1 - weight) * CASE WHEN count(*) > 1 THEN max(1 - weight) ELSE 1 END, 6) + 0.0 AS weight FROM e GROUP BY 1, 2")
def symmetrized(t):
    e = t.lineitem.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst"), "l_discount").groupBy("src", "dst").agg(F.min("l_discount").alias("weight"))
    return g.symmetrize(e).withColumn("weight", r("weight"))


EDGES = "ed AS (SELECT least(2 * l_suppkey, 2 * l_partkey + 1) AS src, greatest(2 * l_suppkey, 2 * l_partkey + 1) AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL)"


def _edges(t):
    """Suppliers (even nodes) and parts (odd ones) of all lines, each edge once."""
    edges = t.lineitem.groupBy((2 * F.col("l_suppkey")).alias("src"), (2 * F.col("l_partkey") + 1).alias("dst")).agg(F.sum("l_quantity").alias("weight"))
    return g.upper_edges(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))


@query("N10", sql=f"WITH {EDGES} SELECT src, dst, weight FROM ed")
def upper_edges(t):
    return _edges(t)


@query("N9", sql=f"""
WITH {EDGES}, m AS (SELECT sum(weight) AS m FROM ed), i AS (SELECT sum(weight) FILTER (src % 5 = dst % 5) AS i FROM ed), k AS (SELECT l, sum(w) AS d FROM (SELECT src % 5 AS l, weight AS w FROM ed UNION ALL SELECT dst % 5, weight FROM ed) GROUP BY l)
SELECT round(coalesce(i, 0) / m - (SELECT sum(d * d) FROM k) / (4 * m * m), 6) + 0.0 AS modularity FROM m, i""")
def modularity(t):
    e = _edges(t)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("label", F.col("node") % 5)
    return g.modularity(e, nodes).withColumn("modularity", r("modularity"))


@query("N4", sql="""
WITH e AS (SELECT vec_id AS id, vec_id % 3 AS obj, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), d AS (SELECT a.id AS a, b.id AS b, a.obj AS oa, b.obj AS ob, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.obj <> b.obj),
k AS (SELECT a, b, oa, ob FROM (SELECT *, row_number() OVER (PARTITION BY a, ob ORDER BY d, b) AS n FROM d) WHERE n <= 5)
SELECT x.a, x.b, x.oa AS obj_a, x.ob AS obj_b FROM k x JOIN k y ON x.a = y.b AND x.b = y.a""")
def anchors(t):
    return g.anchors(_vectors(t).withColumn("obj", F.col("id") % 3), 5)


@query("N9")
def label_communities(t):
    return g.label_communities(g.symmetrize(g.fuzzy_weights(_knn(t))))


POINTS = "pt AS (SELECT vec_id AS id, label, 10e0 * embedding[1] AS x, 10e0 * embedding[2] AS y, 10e0 * embedding[3] AS z FROM embeddings)"


def _points(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "label", *[(F.col("embedding")[i].cast("double") * 10).alias(c) for i, c in enumerate("xyz")])


@query("J10", sql=f"WITH {POINTS} SELECT a.id AS a, b.id AS b, round(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2), 5) AS d2 FROM pt a JOIN pt b ON a.id < b.id WHERE power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) <= 1.69")
def pairs_within(t):
    return g.pairs_within(_points(t), 1.3, ["x", "y", "z"]).withColumn("d2", r("d2", 5))


@query("J11", "G23", "S4", sql=f"""
WITH {POINTS}, th AS (SELECT * FROM (VALUES (0.5), (1.0), (2.0)) v(threshold)), pr AS (SELECT a.label AS i, b.label AS j, power(a.x - b.x, 2) + power(a.y - b.y, 2) AS d2 FROM pt a JOIN pt b ON a.id <> b.id),
c AS (SELECT CAST(threshold AS DOUBLE) AS threshold, i, j, count(*) AS n FROM pr, th WHERE d2 > 0 AND d2 <= threshold * threshold GROUP BY ALL)
SELECT threshold, i, j, round(n / sum(n) OVER (PARTITION BY threshold, i) / (sum(n) OVER (PARTITION BY threshold, j) / sum(n) OVER (PARTITION BY threshold)), 6) AS ratio FROM c""")
def co_occurrence(t):
    return g.co_occurrence(_points(t), [0.5, 1.0, 2.0], ["x", "y"]).withColumn("ratio", r("ratio"))


@query("J12", "S9", sql=f"WITH {POINTS} SELECT a.label, a.id AS a, b.id AS b, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 5) AS dist FROM pt a JOIN pt b ON a.label = b.label AND a.id < b.id")
def distances_within_groups(t):
    return g.distances_within_groups(_points(t), "label", ["x", "y"]).withColumn("dist", r("dist", 5))


@query("S6", sql=f"""
WITH {POINTS}, pr AS (SELECT a.id AS a, b.id AS b FROM pt a JOIN pt b ON a.id <> b.id WHERE power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) <= 1) SELECT a, b, -1e0 AS value FROM pr UNION ALL SELECT a, a, CAST(count(*) AS DOUBLE) FROM pr GROUP BY a""")
def contact_matrix(t):
    return g.contact_matrix(_points(t), 1.0)


@query("S6", sql=f"""
WITH {POINTS}, pr AS (SELECT a.id AS a, b.id AS b, [b.x - a.x, b.y - a.y, b.z - a.z] AS d, power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) AS d2 FROM pt a JOIN pt b ON a.id <> b.id WHERE power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) <= 1),
h AS (SELECT a, b, p, q, -d[p + 1] * d[q + 1] / d2 AS value FROM pr, range(3) x(p), range(3) y(q))
SELECT a, b, CAST(p AS INT) AS p, CAST(q AS INT) AS q, round(value, 6) + 0.0 AS value FROM h UNION ALL SELECT a, a, CAST(p AS INT), CAST(q AS INT), round(-sum(value), 6) + 0.0 FROM h GROUP BY a, p, q""")
def elastic_network(t):
    return g.elastic_network(_points(t), 1.0, digits=6)


@query("N13", sql=f"""
WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), d AS (SELECT a.vec_id AS id, c.vec_id AS centre, power(list_distance(a.v, c.v), 2) AS d2 FROM e a, e c WHERE c.vec_id < 5), w AS (SELECT id, centre, exp(-(d2 - min(d2) OVER (PARTITION BY id)) / 0.5) AS e FROM d)
SELECT id, centre, round(e / sum(e) OVER (PARTITION BY id), 6) AS weight FROM w""")
def soft_assignment(t):
    centres = _vectors(t).where("id < 5").withColumnRenamed("id", "centre")
    return g.soft_assignment(_vectors(t), centres, 0.5).withColumn("weight", r("weight"))


@query("N11", sql=f"""
WITH {GRID}, r AS (SELECT x.col_id AS a, y.col_id AS b, power((1 + corr(x.value, y.value)) / 2, 6) AS w FROM grid x JOIN grid y ON x.row_id = y.row_id AND x.col_id <> y.col_id GROUP BY ALL), k AS (SELECT a, sum(w) AS k FROM r GROUP BY a),
l AS (SELECT x.a, y.b, sum(x.w * y.w) AS l FROM r x JOIN r y ON x.b = y.a AND x.a < y.b GROUP BY ALL)
SELECT r.a, r.b, round(w, 5) AS adjacency, round((l + w) / (least(p.k, q.k) + 1 - w), 5) AS tom FROM r JOIN l ON r.a = l.a AND r.b = l.b JOIN k p ON p.a = r.a JOIN k q ON q.a = r.b WHERE r.a < r.b""")
def topological_overlap(t):
    return g.topological_overlap(t.panel(), t.panel_obs()).withColumns({"adjacency": r("adjacency", 5), "tom": r("tom", 5)})


@query("E17", sql="SELECT 'slope' AS term, round(regr_slope(l_extendedprice, l_quantity), 4) AS coefficient FROM lineitem UNION ALL SELECT 'one', round(regr_intercept(l_extendedprice, l_quantity), 4) FROM lineitem")
def least_squares(t):
    df = t.lineitem.select(F.lit(1.0).alias("one"), F.col("l_quantity").alias("slope"), "l_extendedprice")
    return md.weighted_least_squares(df, "l_extendedprice", ["one", "slope"]).select("term", r("coefficient", 4).alias("coefficient"))


@query("E17", sql="""
WITH s AS (SELECT sum(w) AS w, sum(w * x) AS wx, sum(w * x * x) AS wxx, sum(w * y) AS wy, sum(w * x * y) AS wxy FROM (SELECT l_tax + 0.01 AS w, l_quantity AS x, l_extendedprice AS y FROM lineitem))
SELECT 'slope' AS term, round((w * wxy - wx * wy) / (w * wxx - wx * wx), 3) AS coefficient FROM s UNION ALL SELECT 'one', round((wxx * wy - wx * wxy) / (w * wxx - wx * wx), 3) FROM s""")
def weighted_least_squares(t):
    df = t.lineitem.select(F.lit(1.0).alias("one"), F.col("l_quantity").alias("slope"), "l_extendedprice", (F.col("l_tax") + 0.01).alias("w"))
    return md.weighted_least_squares(df, "l_extendedprice", ["one", "slope"], "w").select("term", r("coefficient", 3).alias("coefficient"))


@query("E16", sql="SELECT 'F' AS term, round(ln(avg(l_quantity) FILTER (l_linestatus = 'F')), 5) AS coefficient FROM lineitem UNION ALL SELECT 'O', round(ln(avg(l_quantity) FILTER (l_linestatus <> 'F')), 5) FROM lineitem")
def poisson_regression(t):
    df = t.lineitem.select((F.col("l_linestatus") == "F").cast("int").alias("F"), (F.col("l_linestatus") != "F").cast("int").alias("O"), "l_quantity")
    return md.poisson_regression(df, "l_quantity", ["F", "O"]).withColumn("coefficient", r("coefficient", 5))


@query("M10", sql=f"""
WITH {GRID}, x AS (SELECT row_id, row_id % 7 AS k FROM @panel_obs), b AS (SELECT col_id, regr_slope(value, k) AS s, regr_intercept(value, k) AS i FROM grid JOIN x USING (row_id) GROUP BY 1)
SELECT row_id, col_id, round(value - i - s * k, 7) + 0.0 AS value FROM grid JOIN x USING (row_id) JOIN b USING (col_id)""")
def regress_out(t):
    rows = t.panel_obs().select("row_id", (F.col("row_id") % 7).alias("k"))
    return md.regress_out(_grid(t), rows, ["k"]).withColumn("value", r("value", 7))


@query("N1", "N2", sql=f"WITH {GRID}, v AS (SELECT col_id, var_samp(value) AS v FROM grid GROUP BY 1) SELECT round(sum(v), 3) AS total, 1e0 AS share FROM v")
def pca_total_variance(t):
    _, _, variances = md.principal_components(t.panel(), t.panel_obs(), 50)
    return variances.agg(r(F.sum("variance"), 3).alias("total"), r(F.sum("ratio"), 6).alias("share"))


@query("N1", "N2")
def pca_scores(t):
    return md.principal_components(t.panel(), t.panel_obs(), 5)[0].withColumn("score", r("score", 5))


@query("N3")
def canonical_correlations(t):
    grid = _grid(t)
    return md.canonical_correlations(grid.where("row_id % 2 = 0"), grid.where("row_id % 2 = 1"), 3)


@query("N12")
def module_eigengenes(t):
    modules = t.panel().select("col_id").distinct().select("col_id", F.concat(F.lit("m"), F.col("col_id") % 4).alias("module"))
    return md.module_eigengenes(_grid(t), modules).withColumns({"eigengene": r("eigengene", 5), "explained": r("explained", 5)})


@query("M7", "M8", "W9")
def variance_trend_features(t):
    return md.variance_trend_features(t.panel(), t.panel_obs(), 10).withColumn("variance_standardized", r("variance_standardized", 4))


def _survival(t):
    return t.lineitem.select("l_orderkey", F.round("l_extendedprice", -3).alias("T"), (F.col("l_returnflag") == "R").cast("int").alias("E"), (F.col("l_quantity") / 50).alias("x0"), (F.col("l_discount") * 10).alias("x1"))


@query("E18", "P12", "SRC4")
def cox_regression(t):
    return md.cox_regression(_survival(t), "T", "E", ["x0", "x1"], 8).withColumns({"coefficient": r("coefficient"), "se": r("se")})


@query("E19", sql="SELECT l_orderkey, round((l_quantity / 50 - (SELECT avg(l_quantity / 50) FROM lineitem)) * 0.5 + (l_discount * 10 - (SELECT avg(l_discount * 10) FROM lineitem)) * -0.25, 6) + 0.0 AS hazard FROM lineitem")
def log_partial_hazard(t):
    return md.log_partial_hazard(_survival(t), "l_orderkey", {"x0": 0.5, "x1": -0.25}).withColumn("hazard", r("hazard"))


@query("E14", "K8", sql="""
WITH f AS (SELECT l_partkey AS col_id, avg(l_discount - 0.05) AS c, var_samp(l_discount) / count(*) + 1e-6 AS cv, avg(l_tax - 0.04) AS d, var_samp(l_tax) / count(*) + 1e-6 AS dv FROM lineitem GROUP BY 1 HAVING count(*) > 1)
SELECT col_id, round(c * c / cv, 4) AS chi_cont, round(d * d / dv, 4) AS chi_disc, round(c * c / cv + d * d / dv, 4) AS chi_both, round(exp(-(c * c / cv + d * d / dv) / 2), 6) AS p_both FROM f""")
def wald_tests(t):
    n = F.count("*")
    fits = t.lineitem.groupBy(F.col("l_partkey").alias("col_id")).agg(F.avg(F.col("l_discount") - 0.05).alias("cont"), (F.var_samp("l_discount") / n + 1e-6).alias("cont_var"), F.avg(F.col("l_tax") - 0.04).alias("disc"), (F.var_samp("l_tax") / n + 1e-6).alias("disc_var"), n.alias("n")).where("n > 1")
    return md.wald_tests(fits).drop("p_cont").select("col_id", *[r(c, 4).alias(c) for c in ("chi_cont", "chi_disc", "chi_both")], r("p_both").alias("p_both"))


@query("E22", sql="""
WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity - 1 AS y, 5 + l_tax * 100 AS mu, 2.5e0 AS th FROM lineitem)
SELECT id, round(lgamma(y + th) - lgamma(th) - lgamma(y + 1) + th * ln(th / (th + mu)) + y * ln(mu / (th + mu)), 6) + 0.0 AS logp, round(-2 * (y - mu) * th / (mu + th), 6) + 0.0 AS d_eta, round(2 * mu * th * (y + th) / power(mu + th, 2), 6) AS d2_eta FROM v""")
def negative_binomial(t):
    df = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") - 1).alias("y"), (F.col("l_tax") * 100 + 5).alias("mu"), F.lit(2.5).alias("theta"))
    return md.negative_binomial(df).select("id", r("logp").alias("logp"), r("d_eta").alias("d_eta"), r("d2_eta").alias("d2_eta"))


@query("E26", sql="WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS y, 1.5 + l_tax AS a, 0.1 + l_discount AS b FROM lineitem) SELECT id, round(lgamma(a + y) - lgamma(a) - lgamma(y + 1) + a * ln(b) - (a + y) * ln(b + 1), 6) + 0.0 AS logp FROM v")
def gamma_poisson(t):
    df = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("y"), (F.col("l_tax") + 1.5).alias("concentration"), (F.col("l_discount") + 0.1).alias("rate"))
    return md.gamma_poisson(df).withColumn("logp", r("logp"))


@query("E21")
def dispersion_fit(t):
    df = t.panel().groupBy("col_id").agg(F.collect_list("value").alias("ys"), F.avg("value").alias("mean")).withColumn("mus", F.array_repeat("mean", F.size("ys")))
    return md.dispersion_fit(df).withColumn("log_alpha", r("log_alpha", 3))


@query("E25", "G27")
def decontaminate(t):
    return md.decontaminate(t.panel(), t.panel_obs().select("row_id", (F.col("row_id") % 3).alias("z"))).withColumn("contamination", r("contamination", 5))


@query("N16")
def initial_clusters(t):
    return md.initial_clusters(_vectors(t), 4)


@query("E31", sql="SELECT row_id, grp || '_s1' AS subcluster FROM @panel_obs WHERE grp NOT IN ('ASIA')")
def subcluster_labels(t):
    return md.subcluster_labels(t.panel_obs(), ["ASIA"])


@query("S8")
def implicit_diffusion(t):
    start = [float(x.v) for x in t.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("v")).orderBy("l_suppkey").collect()]
    return t.spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(md.implicit_diffusion(start, 1.0, 0.1, 1.0, 20))], "cell int, value double")

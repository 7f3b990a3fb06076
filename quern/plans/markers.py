"""Queries of rank tests, markers and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.special import two_sided_sql
from quern.operators import markers as k
from quern.operators import matrix as m
from quern.operators import sets as s
from quern.plans.base import query, r
from quern.plans.matrix import LOGGED

RANKS = f"""{LOGGED}, n AS (SELECT count(*) AS n FROM @obs), c AS (SELECT DISTINCT col_id FROM logged), g AS (SELECT grp, count(*) AS size FROM obs GROUP BY grp),
v AS (SELECT l.*, o.grp FROM logged l JOIN obs o ON l.row_id = o.row_id),
z AS (SELECT col_id, any_value(n) - count(*) AS zeros, any_value(n) AS n FROM v, n GROUP BY col_id),
w AS (SELECT v.*, zeros + rank() OVER (PARTITION BY v.col_id ORDER BY value) - 1 + (count(*) OVER (PARTITION BY v.col_id, value) + 1) / 2.0 AS rank FROM v JOIN z USING (col_id)),
t AS (SELECT col_id, sum(power(k, 3) - k) AS t_all, sum(CASE WHEN value < top THEN power(k, 3) - k ELSE 0 END) AS t_part FROM (SELECT col_id, value, count(*) AS k, max(value) OVER (PARTITION BY col_id) AS top FROM v GROUP BY col_id, value) GROUP BY col_id),
h AS (SELECT col_id, grp, sum(rank) AS held, count(*) AS nnz, sum(value) AS s, sum(exp(value) - 1) AS e FROM w GROUP BY ALL),
tot AS (SELECT col_id, sum(value) AS total, sum(exp(value) - 1) AS total_e, count(*) AS above FROM v GROUP BY col_id),
rs AS (SELECT c.col_id, g.grp, size, coalesce(nnz, 0) AS nnz, coalesce(held, 0) + (size - coalesce(nnz, 0)) * (zeros + 1) / 2.0 AS rank_sum, n, coalesce(s, 0) AS s, coalesce(e, 0) AS e, total, total_e, above,
  t_all + CASE WHEN zeros > 0 THEN power(zeros, 3) - zeros ELSE 0 END AS ties, t_part + CASE WHEN zeros > 0 THEN power(zeros, 3) - zeros ELSE 0 END AS ties_but_last
  FROM c CROSS JOIN g LEFT JOIN h ON h.col_id = c.col_id AND h.grp = g.grp JOIN z ON z.col_id = c.col_id JOIN tot ON tot.col_id = c.col_id JOIN t ON t.col_id = c.col_id)"""
PLAIN_Z = "(rank_sum - size * (n + 1) / 2.0) / sqrt(1e0 * size * (n - size) * (n + 1) / 12)"


def _logged(t):
    """Values rounded where ties could differ in the last bit."""
    return m.log_normalize(t.cells()).withColumn("value", F.round("value", 9))


RANKS = RANKS.replace(LOGGED, LOGGED.replace("ln(1 + 1e4 * value / sum(value) OVER (PARTITION BY row_id))", "round(ln(1 + 1e4 * value / sum(value) OVER (PARTITION BY row_id)), 9)"))


@query("W1", "W2", sql=f"WITH {RANKS} SELECT col_id, grp, size, nnz, rank_sum, n, ties, ties_but_last FROM rs")
def rank_sums(t):
    got = k.rank_sums(_logged(t), t.obs())
    return got.withColumn("rank_sum", F.col("rank_sum").cast("double"))


@query("W3", sql=f"WITH {RANKS}, y AS (SELECT col_id, grp, {PLAIN_Z} AS z, abs({PLAIN_Z}) AS a FROM rs) SELECT col_id, grp, round(z, 6) + 0.0 AS z, round({two_sided_sql('a')}, 7) AS p FROM y")
def wilcoxon_plain(t):
    got = k.wilcoxon(k.rank_sums(_logged(t), t.obs()))
    return got.select("col_id", "grp", r("z").alias("z"), r("p", 7).alias("p"))


def _corrected(ties: str, off: str) -> str:
    return f"""WITH {RANKS}, u AS (SELECT *, rank_sum - size * (size + 1) / 2.0 - 1e0 * size * (n - size) / 2 AS d, sqrt(1e0 * size * (n - size) * ((1e0 * n * n * n - n) - {ties}) / (12e0 * (1e0 * n * n - n))) AS sd FROM rs)
SELECT col_id, grp, round(coalesce(({off}) / sd, 0), 6) + 0.0 AS z FROM u"""


@query("W4", sql=_corrected("ties_but_last", "d - sign(d) * 0.5"))
def wilcoxon_partial_ties(t):
    return k.wilcoxon(k.rank_sums(_logged(t), t.obs()), "partial_ties").select("col_id", "grp", r("z").alias("z"))


@query("W5", sql=_corrected("ties", "d - sign(d) * 0.5"))
def wilcoxon_all_ties(t):
    return k.wilcoxon(k.rank_sums(_logged(t), t.obs()), "all_ties").select("col_id", "grp", r("z").alias("z"))


@query("W5", sql=_corrected("ties", "sign(d) * greatest(abs(d) - 0.5, 0)"))
def wilcoxon_floored(t):
    return k.wilcoxon(k.rank_sums(_logged(t), t.obs()), "floored").select("col_id", "grp", r("z").alias("z"))


@query("E1", "W6", "K1", sql=f"""
WITH {RANKS}, y AS (SELECT *, {PLAIN_Z} AS z, abs({PLAIN_Z}) AS a FROM rs), p AS (SELECT *, {two_sided_sql('a')} AS p FROM y),
q AS (SELECT *, count(*) OVER (PARTITION BY grp) AS m, row_number() OVER (PARTITION BY grp ORDER BY p) AS rn FROM p),
b AS (SELECT *, least(1, min(p * m / rn) OVER (PARTITION BY grp ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)) AS p_adj FROM q),
x AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(z, 9) DESC, col_id) AS rank FROM b)
SELECT grp, col_id, round(z, 6) + 0.0 AS z, round(p_adj, 6) AS p_adj, round(log2((exp(s / size) - 1 + 1e-9) / (exp((total - s) / (n - size)) - 1 + 1e-9)), 4) + 0.0 AS log2fc,
  round(nnz / size, 6) AS pts, round((above - nnz) / (n - size), 6) AS pts_rest, rank FROM x WHERE rank <= 20""")
def rank_genes_groups(t):
    scored = k.rank_genes_groups(_logged(t), t.obs(), None).withColumn("z", F.round("z", 9))
    got = k.top_by_group(scored, ["grp"], [F.desc("z"), F.asc("col_id")], 20)
    return got.select("grp", "col_id", r("z").alias("z"), r("p_adj").alias("p_adj"), r("log2fc", 4).alias("log2fc"), r("pts").alias("pts"), r("pts_rest").alias("pts_rest"), "rank")


@query("E1", "W7", sql=f"""
WITH {RANKS}, y AS (SELECT *, {PLAIN_Z} AS z, abs({PLAIN_Z}) AS a FROM rs), p AS (SELECT *, {two_sided_sql('a')} AS p FROM y),
x AS (SELECT *, least(1, p * count(*) OVER (PARTITION BY grp)) AS p_adj, row_number() OVER (PARTITION BY grp ORDER BY round(abs(z), 9) DESC, col_id) AS rank FROM p)
SELECT grp, col_id, round(z, 6) + 0.0 AS z, round(p_adj, 6) AS p_adj, rank FROM x WHERE rank <= 10""")
def rank_genes_bonferroni(t):
    scored = k.rank_genes_groups(_logged(t), t.obs(), None, "bonferroni", by_abs=True).withColumn("__a", F.round(F.abs("z"), 9))
    return k.top_by_group(scored, ["grp"], [F.desc("__a"), F.asc("col_id")], 10).select("grp", "col_id", r("z").alias("z"), r("p_adj").alias("p_adj"), "rank")


MARKERS = f"""{RANKS}, f AS (SELECT *, log2((e + 1) / size) - log2((total_e - e + 1) / (n - size)) AS fc, round(nnz / size, 3) AS pct_1, round((above - nnz) / (n - size), 3) AS pct_2 FROM rs),
u AS (SELECT *, rank_sum - size * (size + 1) / 2.0 - 1e0 * size * (n - size) / 2 AS d, sqrt(1e0 * size * (n - size) * ((1e0 * n * n * n - n) - ties_but_last) / (12e0 * (1e0 * n * n - n))) AS sd FROM f WHERE greatest(pct_1, pct_2) >= 0.005),
y AS (SELECT *, (d - sign(d) * 0.5) / sd AS z, abs((d - sign(d) * 0.5) / sd) AS a FROM u), p AS (SELECT *, {two_sided_sql('a')} AS p FROM y)"""


@query("E2", "P15", "K6", sql=f"WITH {MARKERS} SELECT grp, col_id, round(z, 5) + 0.0 AS z, round(fc, 5) + 0.0 AS avg_log2fc, pct_1, pct_2, round(least(p * (SELECT count(*) FROM c), 1), 6) AS p_adj FROM p WHERE abs(fc) >= 0.1 AND p < 0.05")
def find_all_markers(t):
    got = k.find_markers(_logged(t), t.obs(), min_pct=0.005, return_p=0.05)
    return got.select("grp", "col_id", r("z", 5).alias("z"), r("avg_log2fc", 5).alias("avg_log2fc"), "pct_1", "pct_2", r("p_adj").alias("p_adj"))


@query("E3", sql=f"WITH {MARKERS} SELECT col_id, round(z, 5) + 0.0 AS z, round(fc, 5) + 0.0 AS avg_log2fc, pct_1, pct_2 FROM p WHERE fc >= 0.2 AND grp = '1-URGENT'")
def find_markers_of_one(t):
    got = k.find_markers(_logged(t), t.obs(), logfc=0.2, min_pct=0.005, only_pos=True, return_p=None).where("grp = '1-URGENT'")
    return got.select("col_id", r("z", 5).alias("z"), r("avg_log2fc", 5).alias("avg_log2fc"), "pct_1", "pct_2")


QUERY_ITEMS = "SELECT DISTINCT l_returnflag AS cluster, l_partkey AS item FROM lineitem WHERE l_discount > 0.07 AND l_quantity > 45"
SETS = "SELECT p_brand AS set_id, p_partkey AS item FROM part"


def _sets(t):
    return t.part.select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("item"))


def _asked(t):
    return t.lineitem.where("l_discount > 0.07 and l_quantity > 45").select(F.col("l_returnflag").alias("cluster"), F.col("l_partkey").alias("item")).distinct()


@query("E4", "E6", "J6", sql=f"""
WITH q AS ({QUERY_ITEMS}), s AS ({SETS}), u AS (SELECT count(DISTINCT item) AS total FROM s), sz AS (SELECT set_id, count(*) AS m FROM s GROUP BY set_id HAVING count(*) BETWEEN 10 AND 500),
dr AS (SELECT cluster, count(*) AS n FROM q GROUP BY cluster), h AS (SELECT cluster, set_id, count(*) AS k, string_agg(CAST(item AS VARCHAR), '/' ORDER BY item) AS items FROM q JOIN s USING (item) GROUP BY ALL),
a AS (SELECT *, 1e0 * m * n / total AS mu FROM h JOIN sz USING (set_id) JOIN dr USING (cluster), u),
lf AS (SELECT *, list_sum([exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(total - m + 1) - lgamma(n - i + 1) - lgamma(total - m - n + i + 1) - lgamma(total + 1) + lgamma(n + 1) + lgamma(total - n + 1)) FOR i IN range(k, least(m, n) + 1)]) AS p FROM a)
SELECT cluster, set_id, k, k || '/' || n AS gene_ratio, m || '/' || total AS bg_ratio, round(k / m, 6) AS rich_factor, round(1e0 * k / m * total / n, 6) AS fold_enrichment, round((k - mu) / sqrt(mu * (total - n) * (total - m) / total / (total - 1)), 6) + 0.0 AS z, round(p, 6) AS p, items FROM lf""")
def over_representation(t):
    got = s.over_representation(_asked(t), _sets(t))
    return got.select("cluster", "set_id", "k", "gene_ratio", "bg_ratio", r("rich_factor").alias("rich_factor"), r("fold_enrichment").alias("fold_enrichment"), r("z").alias("z"), r("p").alias("p"), "items")


@query("E5", "U5", sql="SELECT set_id, item, count(*) OVER (PARTITION BY set_id) AS size FROM (SELECT DISTINCT l_returnflag AS set_id, l_suppkey AS item FROM lineitem)")
def annotation_index(t):
    return s.annotation_index(t.lineitem.select(F.col("l_returnflag").alias("set_id"), F.col("l_suppkey").alias("item")))


STATS = "SELECT l_partkey AS item, round(avg(l_discount) - 0.05, 9) AS stat FROM lineitem GROUP BY l_partkey"


def _stats(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("item")).agg(F.round(F.avg("l_discount") - 0.05, 9).alias("stat"))


@query("E7", "W11", sql=f"""
WITH st AS ({STATS}), s AS ({SETS}), pl AS (SELECT *, row_number() OVER (ORDER BY stat DESC, item) AS place, count(*) OVER () AS n FROM st),
a AS (SELECT *, count(*) OVER w AS m, abs(stat) / sum(abs(stat)) OVER w AS wt, row_number() OVER (PARTITION BY set_id ORDER BY place) AS i FROM s JOIN pl USING (item) WINDOW w AS (PARTITION BY set_id)),
b AS (SELECT *, sum(wt) OVER (PARTITION BY set_id ORDER BY place ROWS UNBOUNDED PRECEDING) - 1e0 * (place - i) / (n - m) AS top FROM a),
e AS (SELECT set_id, any_value(m) AS size, max(top) AS high, min(top - wt) AS low FROM b GROUP BY set_id)
SELECT set_id, size, round(CASE WHEN high > -low THEN high ELSE low END, 6) + 0.0 AS es FROM e""")
def enrichment_scores(t):
    return s.enrichment_scores(_stats(t), _sets(t)).select("set_id", "size", r("es").alias("es"))


@query("E7")
def enrichment_leading_edge(t):
    return s.enrichment_scores(_stats(t), _sets(t), least=10)


@query("E7")
def enrichment_permutations(t):
    return s.enrichment_p(_stats(t), _sets(t), 30)


@query("E8", "W10", "U4", sql="""
WITH c AS (SELECT DISTINCT col_id FROM @panel), tot AS (SELECT count(*) AS total, least(30, count(*)) AS cap FROM c),
sg AS (SELECT col_id AS item, CASE WHEN col_id % 2 = 0 THEN 'even' ELSE 'odd' END AS set_id, CASE WHEN col_id % 5 = 0 THEN -1 ELSE 1 END AS sign FROM c WHERE col_id <= 12),
g AS (SELECT o.row_id, c.col_id, coalesce(value, 0) AS value FROM @panel_obs o CROSS JOIN c LEFT JOIN panel p ON p.row_id = o.row_id AND p.col_id = c.col_id),
rk AS (SELECT *, least(cap, rank() OVER (PARTITION BY row_id ORDER BY value DESC) - 1 + (count(*) OVER (PARTITION BY row_id, value) + 1) / 2.0) AS rank FROM g, tot),
u AS (SELECT row_id, set_id, sign, 1 - (sum(rank) - count(*) * (count(*) + 1) / 2.0) / (count(*) * any_value(cap) - count(*) * (count(*) + 1) / 2.0) AS u FROM rk JOIN sg ON col_id = item GROUP BY ALL)
SELECT row_id, set_id, round(greatest(coalesce(sum(u) FILTER (sign > 0), 0) - coalesce(sum(u) FILTER (sign < 0), 0), 0), 6) + 0.0 AS score FROM u GROUP BY ALL""")
def signature_scores(t):
    columns = t.panel().select("col_id").distinct()
    signatures = columns.where("col_id <= 12").selectExpr("col_id as item", "if(col_id % 2 = 0, 'even', 'odd') as set_id", "if(col_id % 5 = 0, -1, 1) as sign")
    return s.signature_scores(t.panel(), t.panel_obs(), columns, signatures, 30).withColumn("score", r("score"))


@query("E9", "W12", "J5", sql="""
WITH sc AS (SELECT s_suppkey % 7 AS ligand, l_partkey AS item, sum(l_quantity) AS score FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), po AS (SELECT p_partkey AS item FROM part WHERE p_size <= 10),
mk AS (SELECT ligand, sc.item, score, CASE WHEN po.item IS NULL THEN 0 ELSE 1 END AS y FROM sc LEFT JOIN po USING (item)),
g AS (SELECT ligand, score, sum(y) AS tp, sum(1 - y) AS fp FROM mk GROUP BY ALL),
w AS (SELECT *, sum(tp) OVER d AS t, sum(fp) OVER d AS f, sum(tp) OVER (PARTITION BY ligand) AS p, sum(fp) OVER (PARTITION BY ligand) AS n FROM g WINDOW d AS (PARTITION BY ligand ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
a AS (SELECT ligand, sum(tp * (n - f + fp / 2)) / any_value(p * n) AS auroc, sum(tp / p * (CASE WHEN t - tp + f - fp = 0 THEN 1 ELSE (t - tp) / (t - tp + f - fp) END + t / (t + f)) / 2) AS aupr, any_value(p / (p + n)) AS share FROM w GROUP BY ligand)
SELECT a.ligand, round(auroc, 6) AS auroc, round(aupr, 6) AS aupr, round(aupr - share, 6) + 0.0 AS aupr_corrected, (SELECT round(corr(score, y), 6) + 0.0 FROM mk WHERE mk.ligand = a.ligand) AS pearson FROM a""")
def ligand_activity(t):
    scores = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy((F.col("s_suppkey") % 7).alias("ligand"), F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").alias("score"))
    got = s.activity(scores, t.part.where("p_size <= 10").select(F.col("p_partkey").alias("item")))
    return got.select("ligand", *[r(c).alias(c) for c in ("auroc", "aupr", "aupr_corrected", "pearson")])


PAIRS = "SELECT col_id AS pair_id, col_id AS a, col_id + 1 AS b FROM (SELECT DISTINCT col_id FROM panel)"


def _pairs(t, a="a", b="b"):
    return t.panel().select("col_id").distinct().selectExpr("col_id as pair_id", f"col_id as {a}", f"col_id + 1 as {b}")


@query("E10", "J13", sql=f"""
WITH pr AS ({PAIRS.replace('panel', '@panel', 1)}) SELECT x.row_id AS sender, y.row_id AS receiver, pair_id, round(sqrt(x.value * y.value), 6) AS value
FROM pr JOIN panel x ON x.col_id = a JOIN panel y ON y.col_id = b WHERE x.row_id % 4 = 1 AND y.row_id % 4 = 2 AND x.value > 0 AND y.value > 0""")
def interaction_matrix(t):
    rows = t.panel_obs()
    return s.interaction_matrix(t.panel(), rows.where("row_id % 4 = 1"), rows.where("row_id % 4 = 2"), _pairs(t, "ligand", "receptor"), 6)


@query("E11", "G5", "P6", sql=f"""
WITH pr AS ({PAIRS}), g AS (SELECT grp, count(*) AS n FROM @panel_obs GROUP BY grp), me AS (SELECT col_id, grp, sum(value) / any_value(n) AS mean, count(*) / any_value(n) AS share FROM @panel JOIN panel_obs USING (row_id) JOIN g USING (grp) GROUP BY ALL)
SELECT pair_id, x.grp AS cluster_a, y.grp AS cluster_b, round((x.mean + y.mean) / 2, 6) AS mean, x.share > 0.5 AND y.share > 0.5 AS present FROM pr JOIN me x ON x.col_id = a JOIN me y ON y.col_id = b""")
def cluster_pair_means(t):
    return s.cluster_pair_means(t.panel(), t.panel_obs(), _pairs(t), 0.5).withColumn("mean", r("mean"))


#: Ten shuffles of the groups.
SHUFFLED = """de AS (SELECT grp, row_number() OVER (ORDER BY row_id) AS place FROM panel_obs WHERE grp IS NOT NULL),
sh AS MATERIALIZED (SELECT turn, row_id, grp FROM (SELECT turn, row_id, row_number() OVER (PARTITION BY turn ORDER BY md5('turn:' || turn || ':' || row_id), row_id) AS place FROM panel_obs, range(10) z(turn) WHERE grp IS NOT NULL) JOIN de USING (place))"""


@query("E11", "G24", sql=f"""
WITH pr AS ({PAIRS}), g AS (SELECT grp, count(*) AS n FROM @panel_obs GROUP BY grp), {SHUFFLED}, me AS (SELECT col_id, grp, sum(value) / any_value(n) AS mean, count(*) / any_value(n) AS share FROM @panel JOIN panel_obs USING (row_id) JOIN g USING (grp) GROUP BY ALL),
nu AS (SELECT turn, col_id, grp, sum(value) / any_value(n) AS mean FROM panel JOIN sh USING (row_id) JOIN g USING (grp) GROUP BY ALL),
re AS (SELECT pair_id, x.grp AS cluster_a, y.grp AS cluster_b, (x.mean + y.mean) / 2 AS mean, x.share > 0.2 AND y.share > 0.2 AS present FROM pr JOIN me x ON x.col_id = a JOIN me y ON y.col_id = b),
sn AS (SELECT pair_id, x.grp AS cluster_a, y.grp AS cluster_b, (x.mean + y.mean) / 2 AS other FROM pr JOIN nu x ON x.col_id = a JOIN nu y ON y.col_id = b AND y.turn = x.turn)
SELECT pair_id, cluster_a, cluster_b, round(mean, 6) AS mean, CASE WHEN present AND mean > 0 THEN (SELECT count(*) FROM sn WHERE sn.pair_id = re.pair_id AND sn.cluster_a = re.cluster_a AND sn.cluster_b = re.cluster_b AND other > mean) / 10 ELSE 1 END AS p FROM re""")
def cluster_pair_p(t):
    return s.cluster_pair_p(t.panel(), t.panel_obs(), _pairs(t), 10, 0.2).withColumn("mean", r("mean"))


@query("G12", sql=f"""
WITH ob AS (SELECT * FROM @panel_obs), {SHUFFLED}, gr AS (SELECT turn, grp, col_id, coalesce(value, 0) AS value FROM sh CROSS JOIN (SELECT DISTINCT col_id FROM @panel) c LEFT JOIN panel p USING (row_id, col_id))
SELECT turn, col_id, grp, round((quantile_cont(value, 0.25) + 2 * quantile_cont(value, 0.5) + quantile_cont(value, 0.75)) / 4, 6) AS trimean FROM gr GROUP BY ALL HAVING max(value) > 0""")
def bootstrap_trimean(t):
    return s.bootstrap_trimean(t.panel(), t.panel_obs(), 10).withColumn("trimean", r("trimean"))


@query("E12", "G25", sql=f"""
WITH ob AS (SELECT * FROM @panel_obs), {SHUFFLED}, every AS (SELECT -1 AS turn, row_id, grp FROM ob UNION ALL SELECT * FROM sh), gr AS (SELECT turn, grp, col_id, coalesce(value, 0) AS value FROM every CROSS JOIN (SELECT DISTINCT col_id FROM @panel) c LEFT JOIN panel p USING (row_id, col_id)),
lv AS (SELECT turn, col_id, grp, (quantile_cont(value, 0.25) + 2 * quantile_cont(value, 0.5) + quantile_cont(value, 0.75)) / 4 AS level FROM gr GROUP BY ALL), cx AS (SELECT DISTINCT col_id // 2 AS complex_id, col_id FROM panel), sz AS (SELECT complex_id, count(*) AS k FROM cx GROUP BY 1),
cl AS (SELECT turn, complex_id, grp, exp(avg(ln(level))) AS level FROM lv JOIN cx USING (col_id) JOIN sz USING (complex_id) WHERE level > 0 GROUP BY turn, complex_id, grp, k HAVING count(*) = k),
pb AS (SELECT x.turn, x.complex_id AS pair_id, x.grp AS source, y.grp AS target, x.level * y.level / (1e5 + x.level * y.level) AS prob FROM cl x JOIN cl y ON y.turn = x.turn AND y.complex_id = x.complex_id + 1)
SELECT a.pair_id, a.source, a.target, round(a.prob, 6) AS prob, count(*) FILTER (b.prob > a.prob + 1e-12) / 10 AS p FROM pb a LEFT JOIN pb b ON b.turn >= 0 AND b.pair_id = a.pair_id AND b.source = a.source AND b.target = a.target WHERE a.turn = -1 GROUP BY a.pair_id, a.source, a.target, a.prob""")
def communication_p(t):
    complexes = t.panel().select(F.expr("col_id div 2").alias("complex_id"), "col_id").distinct()
    pairs = complexes.select("complex_id").distinct().selectExpr("complex_id as pair_id", "complex_id as ligand", "complex_id + 1 as receptor")
    return s.communication_p(t.panel(), t.panel_obs(), complexes, pairs, 10, 1e5).withColumn("prob", r("prob"))


@query("E12", "J14", "P20", sql="""
WITH lv AS (SELECT col_id, grp, sum(value) / 10 AS level FROM @panel JOIN @panel_obs USING (row_id) GROUP BY ALL), cx AS (SELECT DISTINCT col_id // 2 AS complex_id, col_id FROM panel), sz AS (SELECT complex_id, count(*) AS k FROM cx GROUP BY 1),
cl AS (SELECT complex_id, grp, exp(avg(ln(level))) AS level FROM lv JOIN cx USING (col_id) JOIN sz USING (complex_id) WHERE level > 0 GROUP BY complex_id, grp, k HAVING count(*) = k)
SELECT x.complex_id AS pair_id, x.grp AS source, y.grp AS target, round(x.level * y.level / (0.5 + x.level * y.level), 6) AS prob FROM cl x JOIN cl y ON y.complex_id = x.complex_id + 1""")
def communication_probability(t):
    levels = t.panel().join(t.panel_obs(), "row_id").groupBy("col_id", "grp").agg((F.sum("value") / 10).alias("level"))
    complexes = t.panel().select(F.expr("col_id div 2").alias("complex_id"), "col_id").distinct()
    pairs = complexes.select("complex_id").distinct().selectExpr("complex_id as pair_id", "complex_id as ligand", "complex_id + 1 as receptor")
    return s.communication_probability(levels, complexes, pairs).withColumn("prob", r("prob"))


BRAY = """p AS (SELECT row_id AS site, col_id AS species, value AS count FROM @panel), tt AS (SELECT site, sum(count) AS t FROM p GROUP BY site),
d AS (SELECT x.site AS a, y.site AS b, 1 - 2 * coalesce((SELECT sum(least(u.count, v.count)) FROM p u JOIN p v ON u.species = v.species WHERE u.site = x.site AND v.site = y.site), 0) / (x.t + y.t) AS distance FROM tt x JOIN tt y ON x.site < y.site)"""


def _bray(t):
    return s.bray_curtis(t.panel().selectExpr("row_id as site", "col_id as species", "value as count"))


@query("E13", sql=f"WITH {BRAY} SELECT a, b, round(distance, 6) AS distance FROM d")
def bray_curtis(t):
    return _bray(t).withColumn("distance", r("distance"))


@query("E13", sql=f"""
WITH {BRAY}, gr AS (SELECT o.* FROM @panel_obs o WHERE row_id IN (SELECT site FROM p)), sz AS (SELECT grp, count(*) AS size FROM gr GROUP BY grp), tot AS (SELECT sum(distance * distance) / (SELECT count(*) FROM gr) AS st FROM d),
wi AS (SELECT sum(distance * distance / size) AS w FROM d JOIN gr x ON d.a = x.row_id JOIN gr y ON d.b = y.row_id JOIN sz ON sz.grp = x.grp WHERE x.grp = y.grp), nk AS (SELECT count(*) AS n, count(DISTINCT grp) AS k FROM gr)
SELECT round((st - w) / (k - 1) / (w / (n - k)), 6) AS f, round((st - w) / st, 6) AS r2 FROM tot, wi, nk""")
def permanova(t):
    groups = t.panel_obs().join(t.panel(), "row_id", "left_semi")
    return s.permanova(_bray(t), groups, 9).select(r("f").alias("f"), r("r2").alias("r2"))

"""Queries of tables: variants, pivots, joins, dedupes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scalars as sc
from quern.functions.special import chi2_tail, hypergeometric_tail, lgamma
from quern.operators import tables as o
from quern.plans.base import query, r

#: Line items as variants: parts are genes, suppliers samples, flags classes, status the type (F as copy number).
VARIANTS = """v AS (SELECT CASE WHEN l_partkey % 97 = 0 THEN '' ELSE 'G' || l_partkey END AS hugo, CAST(l_linenumber AS VARCHAR) AS chr, CAST(l_orderkey AS VARCHAR) AS pos, l_returnflag AS cls, CASE WHEN l_linestatus = 'F' THEN 'Amp' ELSE 'SNP' END AS typ, 'S' || l_suppkey AS sample, l_quantity AS q FROM lineitem)"""
CLASSES = ["A", "N", "R"]


def _variants(t):
    ln = t.lineitem
    return ln.select(
        F.when(F.col("l_partkey") % 97 == 0, "").otherwise(F.concat(F.lit("G"), "l_partkey")).alias("hugo_symbol"), F.col("l_linenumber").cast("string").alias("CHROMOSOME"), F.col("l_orderkey").cast("string").alias("start_position"), F.lit("x").alias("End_position"),
        F.lit("A").alias("reference_allele"), F.lit("C").alias("tumor_seq_allele2"), F.col("l_returnflag").alias("variant_classification"), F.when(F.col("l_linestatus") == "F", "Amp").otherwise("SNP").alias("variant_type"), F.concat(F.lit("S"), "l_suppkey").alias("tumor_sample_barcode"), F.col("l_quantity").alias("q"), F.col("l_partkey").alias("place"),
    )


def _clean(t):
    return o.clean_variants(_variants(t), [F.asc("place")], non_silent=("A", "R"))


@query("P1", "P2", "P4", "P5", "U1", "SRC1", sql="""
WITH v AS (SELECT *, row_number() OVER (PARTITION BY l_linenumber, l_orderkey, l_suppkey ORDER BY l_partkey) AS n FROM lineitem)
SELECT CASE WHEN l_partkey % 97 = 0 THEN 'Unknown' ELSE 'G' || l_partkey END AS Hugo_Symbol, l_orderkey AS Start_Position, CAST(NULL AS BIGINT) AS End_Position, l_returnflag NOT IN ('A', 'R') AS silent, 'S' || l_suppkey AS Tumor_Sample_Barcode FROM v WHERE n = 1""")
def clean_variants(t):
    return _clean(t).select("Hugo_Symbol", "Start_Position", "End_Position", "silent", "Tumor_Sample_Barcode")


@query("P3", "P5", sql="SELECT substr('S' || l_suppkey, 1, 12) AS sample, count(*) AS n FROM lineitem WHERE l_partkey % 97 <> 0 AND l_partkey NOT IN (1, 2, 3) GROUP BY ALL")
def flagged_genes_removed(t):
    got = o.clean_variants(_variants(t), [F.asc("place")], barcodes=True, drop_genes=("G1", "G2", "G3", "Unknown"), remove_duplicates=False)
    return got.groupBy(F.col("Tumor_Sample_Barcode").alias("sample")).agg(F.count("*").alias("n"))


@query("G16", "G17", "G19", "J2", "J3", sql=f"""
WITH {VARIANTS} SELECT CASE WHEN hugo = '' THEN 'Unknown' ELSE hugo END AS Hugo_Symbol, count(*) FILTER (cls = 'A' AND typ <> 'Amp') AS A, count(*) FILTER (cls = 'N' AND typ <> 'Amp') AS N, count(*) FILTER (cls = 'R' AND typ <> 'Amp') AS R,
  count(*) FILTER (typ <> 'Amp') AS total, count(*) FILTER (typ = 'Amp') AS CNV_total, count(DISTINCT sample) FILTER (typ <> 'Amp') AS MutatedSamples, count(DISTINCT sample) AS AlteredSamples FROM v GROUP BY 1""")
def gene_summary(t):
    return o.gene_summary(o.clean_variants(_variants(t), [F.asc("place")], remove_duplicates=False), CLASSES)


@query("G17", "G18", sql=f"WITH {VARIANTS} SELECT sample AS Tumor_Sample_Barcode, count(*) FILTER (cls = 'A') AS A, count(*) FILTER (cls = 'N') AS N, count(*) FILTER (cls = 'R') AS R, count(*) AS total FROM v GROUP BY 1")
def sample_summary(t):
    return o.sample_summary(o.clean_variants(_variants(t), [F.asc("place")], remove_duplicates=False), CLASSES)


@query("G18", sql="""SELECT s_suppkey AS key, count(l_orderkey) FILTER (l_returnflag = 'A') AS A, count(l_orderkey) FILTER (l_returnflag = 'N') AS N, count(l_orderkey) FILTER (l_returnflag = 'Z') AS Z
FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey AND l_quantity > 49 AND l_linenumber = 1 GROUP BY 1""")
def pivot_all(t):
    few = t.lineitem.where("l_quantity > 49 and l_linenumber = 1").select(F.col("l_suppkey").alias("key"), "l_returnflag")
    return o.pivot_all(few, "key", "l_returnflag", ["A", "N", "Z"], t.supplier.select(F.col("s_suppkey").alias("key")))


@query("G20", sql="""SELECT name, round(avg(x), 3) AS mean, round(median(x), 3) AS median, round(sum(x), 2) AS total FROM
(SELECT 'l_quantity' AS name, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY 1""")
def column_summary(t):
    return o.column_summary(t.lineitem, ["l_quantity", "l_tax"]).withColumn("total", r("total", 2))


@query("G21", sql="SELECT string_agg(o_orderpriority, ';' ORDER BY k) AS values FROM (SELECT o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1)")
def distinct_joined(t):
    return o.distinct_joined(t.orders, "o_orderpriority", "o_orderkey")


NOTES = "SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders"


@query("J4", sql=f"SELECT o_custkey, o_orderpriority FROM ({NOTES}) WHERE n = 1 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def annotate(t):
    samples = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return o.annotate(samples, t.orders, "o_custkey", [F.asc("o_orderkey")])[0].select("o_custkey", "o_orderpriority")


@query("J4", sql="SELECT c_custkey AS o_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def unannotated(t):
    return o.annotate(t.customer.select(F.col("c_custkey").alias("o_custkey")), t.orders.where("o_orderpriority = '1-URGENT'"), "o_custkey", [F.asc("o_orderkey")])[1]


@query("J8", sql="""
WITH a AS (SELECT DISTINCT l_suppkey AS k, l_linenumber AS e FROM lineitem), b AS (SELECT l_suppkey AS k, l_linenumber AS e, l_orderkey * 10 + l_linenumber AS place FROM lineitem WHERE l_quantity > 48 AND l_linenumber <= 3)
SELECT k, e, place FROM (SELECT a.k, a.e, b.place, row_number() OVER (PARTITION BY a.k, a.e ORDER BY (b.e = a.e) DESC NULLS LAST, b.place) AS n FROM a LEFT JOIN b ON a.k = b.k) WHERE n = 1""")
def ranked_lookup(t):
    base = t.lineitem.where("l_quantity > 48 and l_linenumber <= 3").selectExpr("l_suppkey as k", "l_linenumber as e", "l_orderkey * 10 + l_linenumber as place")
    return o.ranked_lookup(t.lineitem.selectExpr("l_suppkey as k", "l_linenumber as e").distinct(), base, "k", "e", "place").select("k", "e", "place")


@query("J17", "B18", sql="""
WITH b AS (SELECT l_orderkey AS k, l_quantity AS v, l_shipdate AS stamp, 0 AS nu FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_orderkey, l_quantity, l_shipdate, 1 FROM lineitem WHERE l_linenumber = 2)
SELECT k, v, stamp FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY stamp DESC, nu DESC) AS n FROM b) WHERE n = 1""")
def upsert(t):
    side = lambda n: t.lineitem.where(f"l_linenumber = {n}").selectExpr("l_orderkey as k", "l_quantity as v", "l_shipdate as stamp")
    return o.upsert(side(1), side(2), ["k"], "stamp")


@query("J16", sql="""
WITH a AS (SELECT l_partkey AS k, sum(l_quantity) AS v FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), b AS (SELECT l_partkey AS k, sum(l_quantity) AS v FROM lineitem WHERE l_linenumber = 7 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.v AS before, b.v AS after, coalesce(b.v, 0) - coalesce(a.v, 0) AS change, CASE WHEN a.v IS NULL THEN 'appeared' WHEN b.v IS NULL THEN 'disappeared' ELSE 'common' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def compare(t):
    side = lambda n: t.lineitem.where(f"l_linenumber = {n}").groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("v"))
    return o.compare(side(1), side(7), "k", "v")


@query("J1", sql="SELECT p_brand, round(avg(l_quantity), 6) AS l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def mean_by_translation(t):
    return o.mean_by_translation(t.lineitem, t.part.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey", "p_brand", "l_quantity").withColumn("l_quantity", r("l_quantity"))


@query("P6", sql="WITH k AS (SELECT p_partkey FROM part WHERE p_size < 10 UNION SELECT s_suppkey FROM supplier WHERE s_nationkey < 9) SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (FROM k) AND l_suppkey IN (FROM k)")
def both_known(t):
    return o.both_known(t.lineitem.select("l_partkey", "l_suppkey").distinct(), "l_partkey", "l_suppkey", t.part.where("p_size < 10").select("p_partkey"), t.supplier.where("s_nationkey < 9").select("s_suppkey"))


@query("P7", sql="SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name ELSE p_brand END || '_' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS name FROM part")
def pair_name(t):
    return t.part.select("p_partkey", o.pair_name(F.col("p_size") > 25, F.col("p_name"), F.col("p_brand"), F.col("p_partkey") % 2 == 0, F.col("p_type"), F.col("p_brand")).alias("name"))


@query("G14", sql="SELECT l_suppkey, l_linenumber FROM (SELECT l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS n FROM lineitem GROUP BY 1, 2) WHERE n = 1")
def row_mode(t):
    return o.row_mode(t.lineitem, "l_suppkey", "l_linenumber")


@query("G15", sql="SELECT l_suppkey, round(count(*) FILTER (l_linenumber = 1) / count(*), 6) AS p_1, round(count(*) FILTER (l_linenumber = 2) / count(*), 6) AS p_2 FROM lineitem GROUP BY 1")
def state_shares(t):
    return o.state_shares(t.lineitem, "l_suppkey", "l_linenumber", [1, 2]).withColumns({"p_1": r("p_1"), "p_2": r("p_2")})


@query("G13", sql="""
WITH v AS (SELECT l_suppkey, l_extendedprice AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS i, floor(count(*) OVER (PARTITION BY l_suppkey) * 0.1) + 1 AS lo, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, round(avg(x), 4) AS trimmed FROM v WHERE i >= lo AND i <= n + 1 - lo GROUP BY 1""")
def trimmed_mean(t):
    return o.trimmed_mean(t.lineitem, "l_suppkey", "l_extendedprice", 0.1).withColumn("trimmed", r("trimmed", 4))


@query("G22", sql="SELECT round(2 * sum(CASE WHEN y > 0 THEN y * ln(y / 25.5) ELSE 0 END - (y - 25.5)), 3) AS deviance FROM (SELECT l_quantity - 1 AS y FROM lineitem)")
def poisson_deviance(t):
    return o.poisson_deviance(t.lineitem.select((F.col("l_quantity") - 1).alias("y"), F.lit(25.5).alias("mu")), "y", "mu").select(r("deviance", 3).alias("deviance"))


@query("P16", sql="""
WITH b AS (SELECT l_orderkey, max(CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END) AS bad, max(CASE WHEN l_tax < 0.005 THEN 1 ELSE 0 END) AS kept FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber FROM lineitem JOIN b USING (l_orderkey) WHERE bad = 0 OR kept = 1""")
def whole_batches(t):
    return o.whole_batches(t.lineitem, "l_orderkey", F.col("l_discount") > 0.09, F.col("l_tax") < 0.005).select("l_orderkey", "l_linenumber")


@query("B17", sql="SELECT 'l_tax' AS name, true AS present, true AS enough, true AS varies UNION ALL SELECT 'nothing', false, true, false")
def output_check(t):
    return o.output_check(t.lineitem, ["l_tax", "nothing"], 5)


@query("U3", "U6", "U8", sql="SELECT 'both' AS kind, l_partkey AS k FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_partkey FROM lineitem WHERE l_tax > 0.07) UNION ALL SELECT 'any', l_partkey FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 UNION SELECT l_partkey FROM lineitem WHERE l_tax > 0.07)")
def feature_sets(t):
    a, b = t.lineitem.where("l_quantity > 49").select("l_partkey"), t.lineitem.where("l_tax > 0.07").select("l_partkey")
    return a.intersect(b).select(F.lit("both").alias("kind"), F.col("l_partkey").alias("k")).unionByName(a.union(b).distinct().select(F.lit("any").alias("kind"), F.col("l_partkey").alias("k")))


PLATFORM = "(VALUES ('Darwin-23'), ('win32'), ('Windows'), ('Linux x'), ('beos'), (''), (' '), (NULL)) p(c)"


@query("P18", sql=f"""
SELECT c, CASE WHEN lower(trim(c)) LIKE '%darwin%' OR lower(trim(c)) LIKE '%mac%' THEN 'mac' WHEN lower(c) LIKE '%win%' THEN 'win' WHEN lower(c) LIKE '%linux%' THEN 'linux' ELSE 'other' END AS plain,
  CASE WHEN coalesce(trim(c), '') = '' THEN 'mac' WHEN lower(c) LIKE '%darwin%' THEN 'mac' WHEN lower(c) LIKE '%win%' THEN 'win' WHEN lower(c) LIKE '%linux%' THEN 'linux' ELSE 'other' END AS or_mac,
  CASE WHEN coalesce(trim(c), '') = '' THEN 'unknown' WHEN lower(c) LIKE '%darwin%' THEN 'mac' WHEN lower(c) LIKE '%win%' THEN 'win' WHEN lower(c) LIKE '%linux%' THEN 'linux' ELSE 'other' END AS or_unknown FROM {PLATFORM}""")
def platforms(t):
    c = F.col("c")
    got = t.spark.sql(f"SELECT c FROM {PLATFORM}")
    return got.select("c", sc.classify_platform(c).alias("plain"), sc.platform_or_mac(c).alias("or_mac"), sc.platform_or_unknown(c).alias("or_unknown"))


@query("P18", sql="""
WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' 1.5' END AS sec, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'patched' ELSE 'other' END AS variant, CASE p_size % 4 WHEN 0 THEN 'tiny' WHEN 1 THEN 'ood_large2' WHEN 2 THEN 'huge' ELSE 'medium' END AS tier,
  CASE p_size % 5 WHEN 0 THEN 'process exited -9' WHEN 1 THEN 'Killed by watchdog' WHEN 2 THEN ' ' WHEN 3 THEN 'std::bad_alloc' ELSE 'timeout' END AS note FROM part)
SELECT p_partkey, CASE WHEN trim(sec) <> '' AND variant IN ('baseline', 'patched') THEN 'measurement' WHEN trim(sec) = '' AND variant = '' AND tier <> 'huge' AND trim(note) <> '' THEN CASE WHEN note <> 'timeout' THEN 'oom' ELSE 'sentinel' END ELSE 'none' END AS kind FROM x""")
def row_kinds(t):
    e = lambda x: F.expr(x)
    sec, variant, tier = e("if(p_partkey % 2 = 0, '', ' 1.5')"), e("case p_partkey % 3 when 0 then '' when 1 then 'patched' else 'other' end"), e("case p_size % 4 when 0 then 'tiny' when 1 then 'ood_large2' when 2 then 'huge' else 'medium' end")
    note = e("case p_size % 5 when 0 then 'process exited -9' when 1 then 'Killed by watchdog' when 2 then ' ' when 3 then 'std::bad_alloc' else 'timeout' end")
    return t.part.select("p_partkey", sc.row_kind(sec, variant, tier, note).alias("kind"))


@query("P19", sql="SELECT p_partkey FROM part WHERE p_size >= 30 AND p_brand <> 'Brand#11' AND p_retailprice < 1500")
def label_filter(t):
    labels = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("price"), F.col("p_retailprice").cast("string"))
    return t.part.where(sc.label_filter("size >= 30, brand != Brand#11, price<1500", labels)).select("p_partkey")


@query("E4", sql="""
WITH x AS (SELECT p_partkey, 1e0 * p_size / 7 + 0.1 AS x FROM part) SELECT p_partkey, round(lgamma(x), 8) + 0.0 AS lg, round(exp(-x / 2), 9) AS chi2 FROM x""")
def special_functions(t):
    x = F.col("p_size") / 7 + 0.1
    return t.part.select("p_partkey", r(lgamma(x), 8).alias("lg"), r(chi2_tail(x, 2), 9).alias("chi2"))


@query("E4", sql="""
WITH x AS (SELECT p_partkey, p_size % 6 AS k, 10 + p_size % 7 AS m, 8 + p_size % 5 AS n, 60 AS b FROM part)
SELECT p_partkey, round(least(1, list_sum([exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(b - m + 1) - lgamma(n - i + 1) - lgamma(b - m - n + i + 1) - lgamma(b + 1) + lgamma(n + 1) + lgamma(b - n + 1)) FOR i IN range(k, least(m, n) + 1)])), 8) AS tail FROM x""")
def hypergeometric(t):
    c = lambda e: F.expr(f"cast({e} as long)")
    return t.part.select("p_partkey", r(hypergeometric_tail(c("p_size % 6"), c("10 + p_size % 7"), c("8 + p_size % 5"), c("60")), 8).alias("tail"))


@query("SNK1", sql="SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, sha256(p_brand || chr(31) || p_type) AS key FROM part")
def text_keys(t):
    return t.part.select("p_partkey", sc.slug(F.col("p_type")).alias("slug"), sc.content_key(F.col("p_brand"), F.col("p_type")).alias("key"))

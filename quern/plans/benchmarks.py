"""Queries of benchmark tables, on line items dressed up as timed runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import benchmarks as b
from quern.operators.tables import keep_first
from quern.plans.base import query, r

RUNS = """runs AS (SELECT 'task' || (l_suppkey % 8) AS task, CASE WHEN l_partkey % 11 = 0 THEN '—' ELSE 'ds' || (l_suppkey % 4) END AS dataset, CASE l_orderkey % 3 WHEN 0 THEN 'mac' WHEN 1 THEN 'win' ELSE 'linux' END AS platform,
  CASE WHEN l_linenumber % 2 = 0 THEN 'baseline' ELSE 'patched' END AS variant, CAST(CASE (l_orderkey // 3) % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 8 END AS INT) AS threads, 'b' || (l_partkey % 40) AS batch,
  l_quantity + CASE WHEN l_linenumber % 2 = 0 THEN 10 ELSE 0 END AS sec, l_extendedprice AS peak_mb, l_discount < 0.09 AS pass, l_shipdate AS ts FROM lineitem)"""


def _runs(t):
    return t.lineitem.select(
        F.concat(F.lit("task"), F.col("l_suppkey") % 8).alias("task"), F.when(F.col("l_partkey") % 11 == 0, "—").otherwise(F.concat(F.lit("ds"), F.col("l_suppkey") % 4)).alias("dataset"),
        F.expr("case l_orderkey % 3 when 0 then 'mac' when 1 then 'win' else 'linux' end").alias("platform"), F.expr("if(l_linenumber % 2 = 0, 'baseline', 'patched')").alias("variant"), F.expr("case (l_orderkey div 3) % 3 when 0 then 1 when 1 then 4 else 8 end").alias("threads"),
        F.concat(F.lit("b"), F.col("l_partkey") % 40).alias("batch"), F.expr("l_quantity + if(l_linenumber % 2 = 0, 10, 0)").alias("sec"), F.col("l_extendedprice").alias("peak_mb"), (F.col("l_discount") < 0.09).alias("pass"), F.col("l_shipdate").alias("ts"),
    )


@query("G28", "G30", "G43", sql=f"""
WITH {RUNS} SELECT task, threads, count(*) AS n, round(avg(sec), 6) AS mean, median(sec) AS median, min(sec) AS least, max(sec) AS most, round(coalesce(stddev_samp(sec), 0), 6) AS sd, CASE WHEN count(*) >= 3 THEN round(coalesce(stddev_samp(sec), 0) / avg(sec), 6) END AS cv FROM runs GROUP BY task, threads""")
def timing_summary(t):
    return b.timing_summary(_runs(t), ["task", "threads"]).withColumns({c: r(c) for c in ("mean", "sd", "cv")})


def _json(t):
    return t.lineitem.select(F.col("l_suppkey").alias("k"), F.format_string('{"wall": %d, "cpu": %d, "note": "x"}', F.col("l_quantity").cast("int"), F.col("l_linenumber") - 1).alias("j"))


@query("G29", sql="SELECT l_suppkey AS k, round(CASE WHEN count(q) >= 2 THEN median(q) END, 6) AS ratio FROM (SELECT l_suppkey, CASE WHEN l_linenumber > 1 THEN l_quantity / (l_linenumber - 1) END AS q FROM lineitem) GROUP BY 1")
def metric_ratio(t):
    return b.metric_ratio(_json(t), ["k"], "j", "wall", "cpu").withColumn("ratio", r("ratio"))


@query("G34", "SRC12", sql="SELECT l_suppkey AS k, 'wall' AS key, round(median(l_quantity), 6) AS median FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, 'cpu', round(median(l_linenumber - 1), 6) FROM lineitem GROUP BY 1")
def metric_medians(t):
    return b.metric_medians(_json(t), ["k"], "j")


@query("G31", sql="SELECT l_suppkey AS k, CASE WHEN l_linestatus = 'F' THEN 'lte' ELSE 'gte' END AS cmp, CASE WHEN l_linestatus = 'F' THEN max(l_discount) ELSE min(l_discount) END AS worst FROM lineitem GROUP BY l_suppkey, l_linestatus")
def worst_metric(t):
    return b.worst_metric(t.lineitem.select(F.col("l_suppkey").alias("k"), "l_discount", F.when(F.col("l_linestatus") == "F", "lte").otherwise("gte").alias("cmp")), ["k"], "l_discount", "cmp")


@query("G32", sql=f"WITH {RUNS} SELECT threads, round(exp(avg(ln(sec))), 6) AS geomean, count(*) AS n FROM runs GROUP BY GROUPING SETS ((threads), ())")
def geometric_means(t):
    return b.geometric_means(_runs(t), "threads", "sec").withColumn("geomean", r("geomean"))


@query("G33", "G35", "SNK1", sql=f"""
WITH {RUNS} SELECT task, dataset, platform, variant, threads, count(*) AS n_reps, round(avg(sec), 6) AS mean_sec, median(sec) AS median_sec, round(avg(CAST(pass AS INT)), 6) AS pass_rate, min(ts) AS first_ts, max(ts) AS last_ts,
  string_agg(CAST(CAST(sec AS INT) AS VARCHAR), ', ' ORDER BY ts, sec) AS reps FROM runs GROUP BY ALL""")
def finalize_cells(t):
    got = b.finalize_cells(_runs(t)).withColumn("reps", F.concat_ws(", ", F.col("reps").cast("array<int>").cast("array<string>")))
    return got.drop("last_batch").withColumns({"mean_sec": r("mean_sec"), "pass_rate": r("pass_rate")})


@query("G36", "G37", sql=f"""
WITH {RUNS} SELECT task, platform, round(avg(sec) FILTER (variant = 'baseline'), 6) AS baseline_sec, round(avg(sec) FILTER (variant = 'patched'), 6) AS patched_sec, max(peak_mb) FILTER (variant = 'baseline') AS baseline_peak, max(peak_mb) FILTER (variant = 'patched') AS patched_peak,
  bool_and(pass) FILTER (variant = 'patched') AS all_pass, round(avg(sec) FILTER (variant = 'baseline') / avg(sec) FILTER (variant = 'patched'), 6) AS speedup FROM runs GROUP BY ALL""")
def pair_summary(t):
    return b.pair_summary(_runs(t), ["task", "platform"]).withColumns({c: r(c) for c in ("baseline_sec", "patched_sec", "speedup")})


@query("G38", sql="""
WITH g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 60e6 AS gap FROM events)
SELECT user_id, round(coalesce(sum(gap) FILTER (gap <= 600), 0), 4) AS minutes, count(*) AS events FROM g GROUP BY 1""")
def active_minutes(t):
    return b.active_minutes(t.events, "user_id", "ts", 600).withColumn("minutes", r("minutes", 4))


@query("G39", "B19", sql="""
WITH o AS (SELECT user_id % 9 AS k, ts, event_id % 50 AS i, max(value) AS value, max(event_type) AS event_type FROM events GROUP BY ALL), p AS (SELECT k, event_type, count(*) AS n, sum(value) AS a FROM o GROUP BY ALL)
SELECT k, round(sum(a), 4) AS amount, arg_min(event_type, (-n, event_type)) AS dominant, round(sum(a * CASE event_type WHEN 'click' THEN 2.0 WHEN 'view' THEN 0.5 ELSE 0 END), 4) AS cost FROM p GROUP BY k""")
def usage_totals(t):
    prices = t.spark.sql("SELECT * FROM VALUES ('click', 2.0D), ('view', 0.5D) AS p(event_type, price)")
    events = t.events.withColumn("k", F.col("user_id") % 9).withColumn("i", F.col("event_id") % 50)
    return b.usage_totals(events, "k", ["ts", "i"], "event_type", "value", prices).select("k", r("amount", 4).alias("amount"), "dominant", r("cost", 4).alias("cost"))


@query("G40", sql="""
WITH e AS (SELECT user_id % 9 AS k, event_id AS stamp, value FROM events), z AS (SELECT max(stamp) AS m FROM e)
SELECT k, round(greatest(coalesce(arg_max(value, stamp) FILTER (stamp <= m * 0.8), 0) - coalesce(arg_max(value, stamp) FILTER (stamp < m * 0.2), 0), 0), 6) + 0.0 AS used FROM e, z GROUP BY k""")
def counter_difference(t):
    most = t.events.agg(F.max("event_id")).scalar()
    events = t.events.select((F.col("user_id") % 9).alias("k"), F.col("event_id").alias("at"), "value").withColumn("m", most)
    return b.counter_difference(events, "k", "at", "value", F.col("m") * 0.2, F.col("m") * 0.8).withColumn("used", r("used"))


@query("G41", "SRC14", sql="""
WITH i AS (SELECT p_brand AS s, p_partkey AS n, p_size AS z FROM part WHERE p_partkey % 3 <> 0), l AS (SELECT p_brand AS s, p_partkey AS n FROM part WHERE p_partkey % 4 <> 0)
SELECT coalesce(i.s, l.s) AS s, count(i.n) AS items, CAST(coalesce(sum(z), 0) AS DOUBLE) AS bytes, count(*) FILTER (l.n IS NULL) AS orphans, count(*) FILTER (i.n IS NULL) AS missing FROM i FULL JOIN l ON i.s = l.s AND i.n = l.n GROUP BY 1""")
def inventory(t):
    part = t.part.select(F.col("p_brand").alias("s"), F.col("p_partkey").alias("n"), F.col("p_size").alias("z"))
    return b.inventory(part.where("n % 3 <> 0"), part.where("n % 4 <> 0"), "s", "n", "z")


@query("G42", sql="SELECT o_orderstatus AS k, count(*) FILTER (o_custkey % 2 = 0 AND o_custkey % 12 >= 1 AND o_orderkey % 3 < 2) AS rounds, coalesce(max(o_custkey % 12) FILTER (o_custkey % 2 = 1), 0) + 1 AS next FROM orders GROUP BY 1")
def decision_rounds(t):
    label = F.expr("if(o_custkey % 2 = 0, cast(o_custkey % 12 as string), concat('7.', o_custkey % 12))")
    phase = F.expr("case o_orderkey % 3 when 0 then '' when 1 then 'optimize' else 'validate' end")
    return b.decision_rounds(t.orders.select(F.col("o_orderstatus").alias("k"), label.alias("label"), phase.alias("phase")), "k", "label", "phase")


#: Raw runs: blank and changed names, markers without seconds, reps that repeat.
RAW = """raw AS (SELECT 'task' || (l_suppkey % 3) AS task, CASE l_partkey % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' WHEN 2 THEN 'ood_large' ELSE 'ood_xlarge' END AS tier,
  CASE WHEN l_partkey % 11 = 0 THEN '—' WHEN l_partkey % 7 = 0 THEN 'ds' || (l_partkey % 4) || '_60k' ELSE 'ds' || (l_partkey % 4) END AS dataset, CASE l_orderkey % 3 WHEN 0 THEN 'mac' WHEN 1 THEN 'win' ELSE 'linux' END AS platform,
  'cpu' || (l_orderkey % 2) AS cpu, CASE WHEN l_linenumber % 2 = 0 THEN 'baseline' ELSE 'patched' END AS variant, CAST(CASE (l_orderkey // 3) % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 8 END AS INT) AS threads, l_linenumber AS rep,
  CASE WHEN l_tax < 75e-3 OR l_discount < 75e-3 THEN 1 + floor(l_quantity / 10) + CASE WHEN l_linenumber % 2 = 0 THEN 10 ELSE 0 END + CASE WHEN l_linenumber % 2 = 0 AND (l_orderkey // 3) % 3 = 2 AND l_partkey % 11 > 0 THEN 20 ELSE 0 END END AS sec, l_extendedprice AS peak_mb, l_discount < 0.09 AS pass, date_trunc('month', l_shipdate) AS ts,
  CASE WHEN l_tax < 75e-3 OR l_discount < 75e-3 THEN CASE WHEN l_partkey % 22 = 0 THEN 'migrated: old' ELSE '' END WHEN l_suppkey % 2 = 0 THEN 'OOM at fit' WHEN l_partkey % 5 = 0 THEN 'crash' ELSE 'na_applicable' END AS note FROM lineitem)"""


def _raw(t):
    fails = "not (l_tax < 75e-3 or l_discount < 75e-3)"
    return t.lineitem.selectExpr(
        "concat('task', l_suppkey % 3) as task", "element_at(array('small', 'medium', 'ood_large', 'ood_xlarge'), cast(l_partkey % 4 + 1 as int)) as tier",
        "case when l_partkey % 11 = 0 then '—' when l_partkey % 7 = 0 then concat('ds', l_partkey % 4, '_60k') else concat('ds', l_partkey % 4) end as dataset", "element_at(array('mac', 'win', 'linux'), cast(l_orderkey % 3 + 1 as int)) as platform",
        "concat('cpu', l_orderkey % 2) as cpu", "if(l_linenumber % 2 = 0, 'baseline', 'patched') as variant", "element_at(array(1, 4, 8), cast((l_orderkey div 3) % 3 + 1 as int)) as threads", "l_linenumber as rep",
        f"if({fails}, null, double(1 + floor(l_quantity / 10) + if(l_linenumber % 2 = 0, 10, 0) + if(l_linenumber % 2 = 0 and (l_orderkey div 3) % 3 = 2 and l_partkey % 11 > 0, 20, 0))) as sec", "l_extendedprice as peak_mb", "l_discount < 0.09 as pass", "date_trunc('month', l_shipdate) as ts",
        f"case when not ({fails}) then if(l_partkey % 22 = 0, 'migrated: old', '') when l_suppkey % 2 = 0 then 'OOM at fit' when l_partkey % 5 = 0 then 'crash' else 'na_applicable' end as note",
    )


def _listed(t):
    """Platforms and variants whose threads are reduced, and that are only labelled flat."""
    return t.spark.sql("SELECT * FROM VALUES ('mac', 'baseline'), ('win', 'baseline'), ('win', 'patched') AS x(platform, variant)"), t.spark.sql("SELECT 'linux' AS platform, 'patched' AS variant")


def _usable(source: str) -> str:
    return f"us AS (SELECT * FROM (SELECT *, sec IS NULL AND lower(note) LIKE '%oom%' AS oom, sec IS NULL AND lower(note) LIKE '%na_applicable%' AS na FROM {source}) WHERE sec IS NOT NULL OR oom OR na)"


def _rescued(source: str) -> str:
    return f"""md AS (SELECT task, tier, threads, platform, variant, median(sec) FILTER (dataset = '—') AS bl, median(sec) FILTER (dataset <> '—') AS re, min((ts, rep, cpu, dataset)) FILTER (dataset <> '—') AS f FROM {source} WHERE NOT oom AND NOT na GROUP BY ALL),
ft AS (SELECT task, tier, threads, platform, bool_and(abs(bl - re) <= 0.25 * re) AS fits, arg_min(f[4], variant) AS real FROM md WHERE bl IS NOT NULL AND re IS NOT NULL GROUP BY ALL),
rs AS (SELECT u.* REPLACE (CASE WHEN dataset = '—' AND fits THEN real ELSE dataset END AS dataset) FROM {source} u LEFT JOIN ft USING (task, tier, threads, platform))"""


def _pooled(source: str) -> str:
    return f"""mk AS (SELECT *, (platform, variant) IN (('mac', 'baseline'), ('win', 'baseline'), ('win', 'patched')) AS reduced FROM {source}),
tm AS (SELECT task, tier, platform, dataset, variant, threads, median(sec) AS m FROM mk WHERE reduced GROUP BY ALL),
vd AS (SELECT a.task, a.tier, a.platform, a.dataset, a.variant, a.threads, coalesce(abs(a.m / o.m - 1) <= 0.1, false) AS pooled FROM tm a JOIN tm o ON o.threads = 1 AND o.m > 0 AND a.threads <> 1 AND a.task = o.task AND a.tier = o.tier AND a.platform = o.platform AND a.dataset = o.dataset AND a.variant = o.variant),
po AS (SELECT * EXCLUDE (reduced, pooled) REPLACE (CAST(CASE WHEN pooled THEN 1 ELSE threads END AS INT) AS threads), CASE WHEN reduced OR platform = 'linux' AND variant = 'patched' THEN 'flat' ELSE 'scale' END AS thread_scaling FROM mk LEFT JOIN vd USING (task, tier, platform, dataset, variant, threads) WHERE coalesce(pooled, true)),
sa AS (SELECT task, tier, platform, dataset, threads, avg(sec) AS same FROM po WHERE variant = 'baseline' GROUP BY ALL),
al AS (SELECT task, tier, platform, dataset, median(sec) AS every, bool_or(thread_scaling = 'flat') AS is_flat, avg(sec) FILTER (threads = 1) AS one FROM po WHERE variant = 'baseline' GROUP BY ALL),
eb AS (SELECT *, CASE WHEN variant = 'patched' AND baseline > 0 THEN baseline / sec END AS speedup FROM (SELECT po.*, coalesce(CASE WHEN is_flat THEN every END, same, one) AS baseline FROM po LEFT JOIN sa USING (task, tier, platform, dataset, threads) LEFT JOIN al USING (task, tier, platform, dataset)))"""


@query("B2", sql=f"WITH {RAW}, {_usable('raw')}, {_rescued('us')} SELECT task, tier, threads, platform, dataset, count(*) AS n FROM rs GROUP BY ALL")
def rescue_names(t):
    return b.rescue_names(b.usable(_raw(t))).groupBy("task", "tier", "threads", "platform", "dataset").agg(F.count("*").alias("n"))


@query("B3", sql=f"WITH {RAW}, {_usable('raw')}, {_pooled('us')} SELECT task, tier, dataset, platform, variant, threads, thread_scaling, count(*) AS n FROM po GROUP BY ALL")
def pool_threads(t):
    return b.pool_threads(b.usable(_raw(t)), *_listed(t)).groupBy("task", "tier", "dataset", "platform", "variant", "threads", "thread_scaling").agg(F.count("*").alias("n"))


@query("B4", "J7", sql=f"WITH {RAW}, {_usable('raw')}, {_pooled('us')} SELECT task, tier, dataset, platform, threads, variant, count(*) AS n, round(min(baseline), 6) AS baseline, round(avg(speedup), 6) AS speedup FROM eb GROUP BY ALL")
def effective_baseline(t):
    got = b.effective_baseline(b.pool_threads(b.usable(_raw(t)), *_listed(t))).groupBy("task", "tier", "dataset", "platform", "threads", "variant").agg(F.count("*").alias("n"), F.min("baseline").alias("baseline"), F.avg("speedup").alias("speedup"))
    return got.withColumns({c: r(c) for c in ("baseline", "speedup")})


@query("B5", sql=f"WITH {RUNS} SELECT task, platform, dataset, count(*) AS n FROM runs r WHERE dataset <> '—' OR NOT EXISTS (SELECT 1 FROM runs x WHERE x.task = r.task AND x.platform = r.platform AND x.dataset <> '—') GROUP BY ALL")
def drop_nameless(t):
    return b.drop_nameless(_runs(t)).groupBy("task", "platform", "dataset").agg(F.count("*").alias("n"))


@query("B1", "SRC10", "U2", sql=f"""
WITH {RAW}, {_usable('raw')}, once AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY ts, task, tier, rep, variant, sec, peak_mb, platform, cpu, threads ORDER BY dataset, note) AS n FROM us) WHERE n = 1), {_rescued('once')}, {_pooled('rs')},
ce AS (SELECT task, tier, threads, platform, dataset, variant, CASE WHEN bool_and(na) THEN 'N/A' WHEN bool_and(oom) THEN 'OOM' WHEN bool_or(oom OR na) THEN 'partial' ELSE 'ok' END AS status, count(*) FILTER (NOT oom AND NOT na) AS n_reps, round(avg(sec), 6) AS sec_mean, median(sec) AS sec_median, round(avg(speedup), 6) AS speedup_mean, round(median(speedup), 6) AS speedup_median,
  round(avg(CAST(pass AS INT)) FILTER (variant = 'patched' AND NOT oom AND NOT na), 6) AS pass_rate, min(thread_scaling) AS thread_scaling FROM eb GROUP BY ALL)
SELECT * FROM ce c WHERE dataset <> '—' OR NOT EXISTS (SELECT 1 FROM ce x WHERE x.task = c.task AND x.tier = c.tier AND x.threads = c.threads AND x.platform = c.platform AND x.dataset <> '—')""")
def finalize(t):
    got = b.finalize(_raw(t), *_listed(t)).drop("mem_mean", "mem_median", "ts_first", "ts_last")
    return got.withColumns({c: r(c) for c in ("sec_mean", "speedup_mean", "speedup_median", "pass_rate")})


@query("U2", "U7", sql=f"WITH {RUNS} SELECT task, dataset, platform, variant, threads, min(batch) AS batch FROM runs GROUP BY ALL")
def keep_first_rows(t):
    return keep_first(_runs(t), ["task", "dataset", "platform", "variant", "threads"], [F.asc("batch"), F.asc("peak_mb")]).select("task", "dataset", "platform", "variant", "threads", "batch")


@query("B6", sql=f"""
WITH {RUNS}, m AS (SELECT batch, task, median(sec) AS b, median(peak_mb) AS p FROM runs WHERE variant = 'baseline' GROUP BY ALL)
SELECT batch, task, ts, sec, peak_mb, round(b / sec, 6) AS speedup_x, round((1 - sec / b) * 100, 5) + 0.0 AS saved_pct, round(peak_mb / p, 6) AS peak_x FROM runs LEFT JOIN m USING (batch, task) WHERE variant = 'patched'""")
def against_batch(t):
    return b.against_batch(_runs(t)).withColumns({"speedup_x": r("speedup_x"), "saved_pct": r("saved_pct", 5), "peak_x": r("peak_x")})


@query("B7", sql=f"""
WITH {RAW}, x AS (SELECT *, min(dataset) FILTER (dataset <> '—') OVER w AS lo, max(dataset) FILTER (dataset <> '—') OVER w AS hi, min((ends_with(dataset, '_60k'), dataset)) FILTER (dataset <> '—') OVER w AS fi FROM raw WINDOW w AS (PARTITION BY ts, tier, threads, task))
SELECT ts, tier, threads, task, dataset, count(*) AS n FROM (SELECT * REPLACE (CASE WHEN dataset <> '—' THEN dataset WHEN lo = hi THEN lo WHEN lo IS NOT NULL AND starts_with(note, 'migrated:') THEN fi[2] ELSE dataset END AS dataset) FROM x) GROUP BY ALL""")
def fill_dataset(t):
    return b.fill_dataset(_raw(t)).groupBy("ts", "tier", "threads", "task", "dataset").agg(F.count("*").alias("n"))


@query("B8", "W20", "P17", sql=f"""
WITH {RUNS}, x AS (SELECT *, first_value(batch) OVER (PARTITION BY platform, task ORDER BY ts DESC, batch DESC) AS nb FROM runs) SELECT platform, task, batch, count(*) AS n FROM x WHERE batch = nb AND platform IN ('mac', 'linux') AND threads <= 4 AND pass GROUP BY ALL""")
def publish_latest(t):
    return b.publishable(_runs(t), "latest", platforms=("mac", "linux"), max_threads=4, require_pass=True).groupBy("platform", "task", "batch").agg(F.count("*").alias("n"))


@query("B8", "W20", sql=f"WITH {RUNS} SELECT task, batch, count(*) AS n FROM runs WHERE batch = (SELECT batch FROM runs ORDER BY ts DESC, batch DESC LIMIT 1) GROUP BY ALL")
def publish_run(t):
    return b.publishable(_runs(t), "run").groupBy("task", "batch").agg(F.count("*").alias("n"))


@query("B8", "W20", sql=f"WITH {RUNS} SELECT ts, sec, peak_mb FROM runs ORDER BY ts DESC, sec DESC, peak_mb DESC LIMIT 10")
def publish_tail(t):
    return b.publishable(_runs(t), "tail", 10).select("ts", "sec", "peak_mb")


@query("B9", "W23", sql=f"""
WITH {RUNS}, c AS (SELECT task, platform, variant, threads, count(*) AS n, coalesce(stddev_samp(sec), 0) / avg(sec) AS cv, avg(CAST(pass AS INT)) AS rate FROM runs GROUP BY ALL)
SELECT task, platform, 'threads' AS rule, CAST(e AS VARCHAR) AS detail FROM (SELECT DISTINCT task, platform FROM runs) h, (VALUES (1), (4), (14)) x(e) WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.task = h.task AND r.platform = h.platform AND threads = e)
UNION ALL SELECT task, platform, 'reps', variant || '/' || threads FROM c WHERE n < 300 UNION ALL SELECT task, platform, 'cv', variant || '/' || threads FROM c WHERE n >= 3 AND cv > 0.5
UNION ALL SELECT task, platform, 'pass', variant || '/' || threads FROM c WHERE rate < 0.5
UNION ALL SELECT task, platform, 'drift', 'median' FROM (SELECT task, platform, batch, median(sec) AS m FROM runs GROUP BY ALL) GROUP BY task, platform HAVING max(m) >= 1.5 * min(m)""")
def coverage_issues(t):
    return b.coverage_issues(_runs(t), [1, 4, 14], 300, 0.5)


@query("B11", "K10", sql=f"""
WITH {RUNS}, c AS (SELECT task, variant, threads, count(*) AS n, avg(sec) AS sec, max(peak_mb) AS peak FROM runs GROUP BY ALL HAVING count(*) < 100000)
SELECT task, variant, threads, 100000 - n AS missing, round((100000 - n) * sec, 2) AS cost_sec, peak, row_number() OVER (ORDER BY peak DESC, sec DESC, task, threads, variant) AS place FROM c""")
def backfill_plan(t):
    return b.backfill_plan(_runs(t), 100000).withColumn("cost_sec", r("cost_sec", 2))


@query("B12", "B14", sql="""
WITH x AS (SELECT l_orderkey, l_linenumber, l_linestatus = 'F' AS lte, l_quantity / 50 AS v, CASE WHEN l_linestatus = 'F' THEN 5e-1 * (1 + 3 * l_tax) ELSE 5e-1 * (1 - 3 * l_tax) END AS h, l_discount AS cv, l_quantity - 25 AS d FROM lineitem),
m AS (SELECT *, CASE WHEN lte THEN h - v ELSE v - h END AS margin, greatest(CASE WHEN lte THEN abs(h) ELSE 1 - h END, 1e-6) AS room FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN margin < 0 THEN 'FAIL' WHEN margin / room < 5e-2 THEN 'BORDERLINE' ELSE 'PASS' END AS gate, cv > 0 AND abs(d) < 3 * cv * 100 AS near FROM m""")
def gates(t):
    cmp = F.when(F.col("l_linestatus") == "F", "lte").otherwise("gte")
    return t.lineitem.select("l_orderkey", "l_linenumber", b.gate(F.col("l_quantity") / 50, cmp, F.lit(0.5), F.col("l_tax")).alias("gate"), b.speed_borderline(F.col("l_quantity") - 25, F.col("l_discount")).alias("near"))


@query("B13", "J9", sql=f"""
WITH {RAW}, c AS (SELECT task, tier, threads, CASE WHEN tier = 'ood_xlarge' AND task = 'task1' THEN 0 ELSE median(sec) FILTER (variant = 'baseline') END AS baseline, CASE WHEN tier = 'ood_large' THEN 2 WHEN tier = 'ood_xlarge' AND threads = 8 THEN 12 ELSE 1 END * median(sec) FILTER (variant = 'patched') AS sec, tier = 'ood_large' AND threads = 4 AND task = 'task2' AS oom FROM raw WHERE NOT (threads = 4 AND tier IN ('small', 'medium')) GROUP BY task, tier, threads),
f AS (SELECT *, CASE WHEN baseline > 0 AND sec > 0 THEN baseline / sec END AS factor FROM c WHERE NOT oom), d AS (SELECT * FROM f WHERE NOT starts_with(tier, 'ood_') AND factor IS NOT NULL), g AS (SELECT threads, exp(avg(ln(factor))) AS geo FROM d GROUP BY 1), w AS (SELECT exp(avg(ln(factor))) AS overall FROM d),
x AS (SELECT task, tier, threads, factor, coalesce(geo, overall) AS ref, CASE WHEN geo IS NULL THEN 'fallback_global' ELSE 'thread_matched' END AS reference_kind FROM f LEFT JOIN g USING (threads), w WHERE starts_with(tier, 'ood_'))
SELECT task, tier, threads, round(ref / factor, 6) AS tax, CASE WHEN factor IS NULL THEN 'ZERO' WHEN ref / factor >= 5 THEN 'HARD' WHEN ref / factor >= CASE WHEN tier = 'ood_xlarge' THEN 2 ELSE 1.5 END THEN 'SOFT' ELSE 'PASS' END AS verdict, round(ref, 6) AS dev_reference, reference_kind FROM x""")
def scaling_tax(t):
    raw = _raw(t).where("not (threads = 4 and tier in ('small', 'medium'))").groupBy("task", "tier", "threads").agg(F.expr("median(if(variant = 'baseline', sec, null))").alias("baseline"), F.expr("median(if(variant = 'patched', sec, null))").alias("sec"))
    cells = raw.selectExpr("task", "tier", "threads", "if(tier = 'ood_xlarge' and task = 'task1', 0D, baseline) as baseline", "case when tier = 'ood_large' then 2 when tier = 'ood_xlarge' and threads = 8 then 12 else 1 end * sec as sec", "tier = 'ood_large' and threads = 4 and task = 'task2' as oom")
    return b.scaling_tax(cells).select("task", "tier", "threads", F.when(F.col("tax") < float("inf"), r("tax")).alias("tax"), "verdict", r("dev_reference").alias("dev_reference"), "reference_kind")


@query("B15", "W22", sql="SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey = max(o_orderkey) FILTER (o_orderstatus = 'O') OVER (PARTITION BY o_custkey) THEN 'done' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_last(t):
    return b.update_last(t.orders, "o_custkey", "o_orderkey", "o_orderstatus", "O", "done").select("o_orderkey", "o_orderstatus")


@query("B16", "SRC11", "SNK2", sql="SELECT n_name, 1 AS thread, n_nationkey, 'optimize' AS phase FROM nation")
def migrate_columns(t):
    return b.migrate_columns(t.nation, ["n_name", "thread", "n_nationkey", "phase"], {"thread": 1, "phase": "optimize"})


@query("W21", sql="""
WITH x AS (SELECT o_custkey AS k, o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'keep' ELSE 'crash' END WHEN 1 THEN 'discard' WHEN 2 THEN 'rollback' WHEN 3 THEN 'rerun' ELSE 'oom' END AS status, CASE o_orderkey % 7 WHEN 0 THEN 'validate' WHEN 1 THEN '' ELSE 'optimize' END AS phase, (o_custkey % 10) * 10 + o_orderkey % 11 AS pct FROM orders),
o AS (SELECT * FROM x WHERE phase <> 'validate'), k AS (SELECT k, max(pct) AS best FROM o WHERE status = 'keep' GROUP BY 1), d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o_orderkey DESC) AS n FROM o WHERE status <> 'rerun'),
t AS (SELECT k, coalesce(min(n - 1) FILTER (status = 'keep'), count(*)) AS tail, CASE WHEN count(*) >= 10 THEN max(pct) FILTER (n <= 10) - max(pct) FILTER (n > 10) END AS gain FROM d GROUP BY k)
SELECT k, CAST(best AS DOUBLE) AS best_keep, CASE WHEN best >= 95 THEN 'late_plateau' WHEN best < 50 THEN 'early_stuck' ELSE 'middle' END AS regime, tail, CAST(gain AS DOUBLE) AS gain, CASE WHEN best < 50 THEN CASE WHEN tail >= 10 THEN 'escalate' END WHEN tail >= 10 OR coalesce(gain < 2, false) THEN CASE WHEN best < 90 THEN 'decide' ELSE 'terminate' END END AS band FROM k JOIN t USING (k)""")
def progress(t):
    status = "case o_orderkey % 5 when 0 then if(o_orderkey % 3 = 0, 'keep', 'crash') when 1 then 'discard' when 2 then 'rollback' when 3 then 'rerun' else 'oom' end as status"
    rows = t.orders.selectExpr("o_custkey as k", "o_orderkey", "cast(o_orderkey as string) as round", status, "case o_orderkey % 7 when 0 then 'validate' when 1 then '' else 'optimize' end as phase", "double((o_custkey % 10) * 10 + o_orderkey % 11) as speedup_pct")
    return b.progress(rows, "k", "o_orderkey")


@query("B20", sql="SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%economy%' THEN 'metal' WHEN lower(p_type) LIKE '%promo%' OR lower(p_type) LIKE '%small%' THEN 'alloy' ELSE 'other' END AS category FROM part")
def categories(t):
    return t.part.select("p_partkey", b.categorize(F.col("p_type"), [("metal", "economy"), ("alloy", "promo|small")]).alias("category"))


@query("B20", sql="""
WITH x AS (SELECT p_partkey AS k, p_partkey % 9 > 0 AS a, p_partkey % 9 > 0 AND p_size % 5 >= 3 AND p_size % 2 = 0 AS b, p_size % 3 >= 1 AND p_partkey % 4 > 0 AS c, p_size % 7 > 3 AND p_partkey % 6 >= 1 AS d, p_partkey % 10 = 3 AS e FROM part)
SELECT k, CASE WHEN e THEN 'package' WHEN d THEN 'scaling' WHEN c THEN 'iterate' WHEN b THEN 'init' WHEN a THEN 'scaffold' ELSE 'unknown' END AS phase,
  concat_ws(',', CASE WHEN NOT a AND (b OR c OR d OR e) THEN 'scaffold' END, CASE WHEN NOT b AND (c OR d OR e) THEN 'init' END, CASE WHEN NOT c AND (d OR e) THEN 'iterate' END, CASE WHEN NOT d AND e THEN 'scaling' END) AS gaps FROM x""")
def lifecycle(t):
    found = t.part.selectExpr("p_partkey as k", "p_partkey % 9 > 0 as configured", "p_size % 5 as datasets", "p_size % 2 = 0 as references", "true as pipeline", "true as evaluation", "p_size % 3 as rounds", "p_partkey % 4 > 0 as best", "true as round_kept", "greatest(p_size % 7 - 3, 0) as ood_tiers", "p_partkey % 6 as verified", "p_partkey % 10 = 3 as patched")
    return b.lifecycle(found, "k")


@query("K9", sql="SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%ring%' THEN 1 ELSE 0 END + CASE WHEN lower(p_type) LIKE '%economy%' THEN 3 ELSE 0 END + CASE WHEN lower(p_name) LIKE '%economy%' THEN 1 ELSE 0 END + CASE WHEN lower(p_type) LIKE '%ring%' THEN 3 ELSE 0 END AS score FROM part WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 15")
def registry_search(t):
    return b.search(t.part, ["ring", "economy"], {"p_name": 1, "p_type": 3}, "p_partkey", 15).select("p_partkey", "score")

"""Mixing sources to target weights by Pareto order sampling. DataFrame operations only.

A source's target is its share of all words by weight, at most `most` times its own words; what exceeds that is shared
again among the others until none is above. Within a source a document is expected to be held in proportion to its measure, the
number of binary digits of its size (a text of 200 words 8, one of a single word 1), and `most` times at most; one factor by
source makes the expected words its target. The whole part of the expectation is certain copies, the fraction is the inclusion
probability p, which so differs by document, of one copy more: documents are ranked by u / (1 - u) over p / (1 - p), u a keyed
hash of the id, and taken in this order as long as their words stay within what is left of the target.

The document at this cut leaves a gap of less than its size. The documents whose sizes come nearest to what is left of it, FILLS
of them at most and each only if it brings the source nearer to its target, are taken once more, so that a few long documents
cannot keep a source off its target.

The cut is found from two histograms of the odds ratio (BINS bins each, mapped to 0 to 1) by source and an exact ranking of the
one bin left, and the factor from sums by source and measure, so no task ever ranks a source.

Null or blank texts have size 0 and take nothing, whatever their copies. A null source is a source of its own, the last. Rows that
repeat a doc_id with a text of the same size are taken or left together. An empty table gives an empty one. Columns of the input
named like one of the outputs (size, source_size, target, copies, taken) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import bounded, materialize, release, word_count

BINS, FILLS = 4096, 3
OUTPUTS = ("size", "source_size", "target", "copies", "taken")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1), fixed by seed and id: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def measure(size: Column) -> Column:
    """Binary digits of a size: what inclusion is in proportion to."""
    return F.length(F.bin(size)).cast("long")


def allocate(totals: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """totals (source, source_size) with weight, cap and target. One row per source; ranks them in one small task."""
    ranked = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("long"))
    every = W.partitionBy()
    ranked = ranked.withColumn("cap", F.col("source_size") * most).withColumn("total", F.sum("source_size").over(every))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    ranked = ranked.withColumn("before", F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("cap"))
    ranked = ranked.withColumn("left", F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    ranked = ranked.withColumn("capped", F.col("cap") * F.col("left") <= F.col("weight") * (F.col("total") - F.col("before")))
    ranked = ranked.withColumn("kept", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every))
    ranked = ranked.withColumn("open", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * (F.col("total") - F.col("kept")) / F.col("open"))
    return ranked.select("source", "source_size", target.alias("target"))


def expectations(classes: DataFrame, most: int) -> DataFrame:
    """classes (source, measure, words, source_size, target) with whole copies, inclusion probability p, and the source's rest: the
    words that are left to draw. A few dozen rows by source; each source's meet in one task."""
    of = W.partitionBy("source")
    falling = of.orderBy(F.desc("measure")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rising = of.orderBy("measure").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = classes.withColumn("before", most * F.sum("words").over(falling) - most * F.col("words")).withColumn("left", F.sum(F.col("words") * F.col("measure")).over(rising))
    sums = sums.withColumn("capped", most * F.col("left") <= F.col("measure") * (F.col("target") - F.col("before")))
    sums = sums.withColumn("certain", F.coalesce(F.sum(F.when(F.col("capped"), most * F.col("words"))).over(of), F.lit(0))).withColumn("open", F.sum(F.when(~F.col("capped"), F.col("words") * F.col("measure"))).over(of))
    held = F.when(F.col("source_size") == 0, 0.0).when(F.col("capped"), float(most)).otherwise((F.col("target") - F.col("certain")) / F.col("open") * F.col("measure"))
    sums = sums.withColumn("held", F.least(held, F.lit(float(most)))).withColumn("whole", F.floor("held").cast("long")).withColumn("p", F.col("held") - F.col("whole"))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(of)
    return sums.select("source", "measure", "source_size", "target", "whole", "p", rest.alias("rest"))


def pareto_rank(u: Column, p: Column) -> Column:
    """The odds of u over the odds of p, as q / (1 + q) in (0, 1]: the smallest are sampled. 1 where p is 0."""
    return u * (1 - p) / (u * (1 - p) + (1 - u) * p)


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size, source_size, target, copies (times the mix holds the document, 0 included) and taken (words).

    weights go to the sources by code point, repeating. most: copies of a document, and words of a target by words of
    its source, at most.
    """
    sized = materialize(docs.select(F.col(source_col).alias("source"), uniform(F.col(id_col), seed).alias("u"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    sized = sized.withColumn("measure", measure(F.col("size")))
    classes = materialize(sized.groupBy("source", "measure").agg(F.sum("size").alias("words")), "mix-classes")
    targets = allocate(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    plan = expectations(classes.alias("c").join(targets.alias("t"), same("c", "t")).select("c.*", "source_size", "target"), most)
    plan = materialize(plan, "mix-plan")

    named = bounded(plan).select(F.col("source").alias("of"), F.col("measure").alias("by"), "whole", "p", "rest")
    ranked = sized.join(named, F.col("source").eqNullSafe(F.col("of")) & (F.col("measure") == F.col("by"))).withColumn("v", pareto_rank(F.col("u"), F.col("p"))).select("source", "u", "v", "size", "whole", "p", "rest")

    # Two histograms narrow the cut to one bin of 1 / BINS**2: the one in which the words exceed the rest, if they ever do.
    bounds = plan.groupBy("source").agg(F.first("rest").alias("rest")).select(F.col("source").alias("of"), F.col("rest").alias("most"), F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("before"))
    bounds = materialize(bounds, "mix-bins")
    width, drawable = 1, ranked.where("p > 0").select("source", "u", "v", "size")
    for _ in range(2):
        inside = drawable.join(bounded(bounds), F.col("source").eqNullSafe(F.col("of")) & ((F.col("v") * width).cast("long") == F.col("bin")))
        width *= BINS
        counted = inside.groupBy("of", "most", "before", (F.col("v") * width).cast("long").alias("fine")).agg(F.sum("size").alias("words"))
        cells = counted.withColumn("upto", F.col("before") + F.sum("words").over(W.partitionBy("of").orderBy("fine").rowsBetween(W.unboundedPreceding, W.currentRow)))
        narrowed = cells.where((F.col("upto") > F.col("most")) & (F.col("upto") - F.col("words") <= F.col("most")))
        bounds = materialize(narrowed.select("of", "most", F.col("fine").alias("bin"), (F.col("upto") - F.col("words")).alias("before")), "mix-bins")
    edge = drawable.join(bounded(bounds), F.col("source").eqNullSafe(F.col("of")) & ((F.col("v") * width).cast("long") == F.col("bin")))
    reached = edge.withColumn("reached", F.col("before") + F.sum("size").over(W.partitionBy("of").orderBy("v")))
    cuts = reached.groupBy("of", "bin").agg(F.max(F.when(F.col("reached") <= F.col("most"), F.col("v"))).alias("cut"))
    cuts = materialize(cuts.select("of", (F.col("bin") / width).alias("low"), F.coalesce("cut", F.lit(-1.0)).alias("cut")), "mix-cuts")
    # Sources whose words never exceed the rest have no cut: all are drawn.
    within = (F.col("p") > 0) & (F.col("cut").isNull() | (F.col("v") < F.col("low")) | (F.col("v") <= F.col("cut")))
    marked = ranked.join(bounded(cuts), F.col("source").eqNullSafe(F.col("of")), "left").withColumn("drawn", within).drop("of")

    # The gap, and the documents that come nearest to what is left of it.
    gaps = marked.groupBy("source").agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("drawn"), F.col("size"))), F.lit(0))).alias("gap"))
    gaps = materialize(gaps.select(F.col("source").alias("of"), "gap", F.array().cast("array<struct<u:double,size:bigint>>").alias("extra")), "mix-gaps-0")
    free = marked.where(~F.col("drawn") & (F.col("whole") < most) & (F.col("size") > 0)).select("source", "u", "v", "size")
    for turn in range(FILLS):
        fits = free.join(bounded(gaps), F.col("source").eqNullSafe(F.col("of")) & (F.col("size") < 2 * F.col("gap")) & ~F.array_contains("extra", F.struct("u", "size")))
        best = fits.groupBy(F.col("source").alias("by")).agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "v", "u", "size")).alias("b"))
        more = gaps.join(best, F.col("of").eqNullSafe(F.col("by")), "left")
        filled = F.when(F.col("b").isNull(), F.col("extra")).otherwise(F.concat("extra", F.array(F.struct(F.col("b.u").alias("u"), F.col("b.size").alias("size")))))
        last, gaps = gaps, materialize(more.select("of", (F.col("gap") - F.coalesce("b.size", F.lit(0))).alias("gap"), filled.alias("extra")), f"mix-gaps-{turn + 1}")
        release(last)

    # One small table by source and measure says all that a document needs.
    final = plan.alias("p").join(cuts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.of")), "left").join(gaps.alias("g"), F.col("p.source").eqNullSafe(F.col("g.of")), "left")
    final = materialize(final.select(*[F.col(f"p.{c}").alias(f"__mix_{c}") for c in ("source", "measure", "source_size", "target", "whole", "p")], F.col("low").alias("__mix_low"), F.col("cut").alias("__mix_cut"), F.col("extra").alias("__mix_extra")), "mix-final")
    kept = docs.select(*[c for c in docs.columns if c not in OUTPUTS or c in (id_col, text_col, source_col)])
    size = kept.withColumn("size", word_count(F.col(text_col))).withColumn("__mix_u", uniform(F.col(id_col), seed))
    out = size.join(bounded(final), F.col(source_col).eqNullSafe(F.col("__mix_source")) & (measure(F.col("size")) == F.col("__mix_measure")))
    v = pareto_rank(F.col("__mix_u"), F.col("__mix_p"))
    drawn = (F.col("__mix_p") > 0) & (F.col("__mix_cut").isNull() | (v < F.col("__mix_low")) | (v <= F.col("__mix_cut")))
    extra = F.array_contains("__mix_extra", F.struct(F.col("__mix_u").alias("u"), F.col("size")))
    copies = F.least(F.col("__mix_whole") + (drawn | extra).cast("long"), F.lit(most).cast("long")).alias("copies")
    out = out.select(*kept.columns, "size", F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), copies)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def op1_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


#: The same draw in plain SQL: it ranks every source whole, in one window.
OP1_SQL = r"""
WITH sized AS (
  SELECT *, length(bin(size)) AS m FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents)),
classes AS (SELECT source, m, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY source, m),
totals AS (SELECT source, CAST(sum(words) AS BIGINT) AS source_size FROM classes GROUP BY source),
ranked AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap,
    CAST(sum(source_size) OVER () AS BIGINT) AS total FROM totals),
ordered AS (
  SELECT *, CAST(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) - cap AS before,
    CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open_weight FROM ranked),
capped AS (SELECT *, cap * open_weight <= weight * (total - before) AS is_capped FROM ordered),
targets AS (
  SELECT source, source_size, CASE WHEN is_capped THEN CAST(cap AS DOUBLE) ELSE
    CAST(weight * (total - CAST(coalesce(sum(cap) FILTER (is_capped) OVER (), 0) AS BIGINT)) AS DOUBLE) / CAST(sum(weight) FILTER (NOT is_capped) OVER () AS DOUBLE) END AS target
  FROM capped),
sums AS (
  SELECT c.*, source_size, target, CAST(3 * sum(words) OVER (PARTITION BY c.source ORDER BY m DESC) AS BIGINT) - 3 * words AS before,
    CAST(sum(words * m) OVER (PARTITION BY c.source ORDER BY m) AS BIGINT) AS under
  FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
full_classes AS (SELECT *, 3 * under <= m * (target - before) AS is_full FROM sums),
factors AS (SELECT *, CAST(coalesce(sum(3 * words) FILTER (is_full) OVER (PARTITION BY source), 0) AS DOUBLE) AS certain, CAST(sum(words * m) FILTER (NOT is_full) OVER (PARTITION BY source) AS DOUBLE) AS open FROM full_classes),
helds AS (SELECT *, least(CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN is_full THEN 3.0::DOUBLE ELSE (target - certain) / open * m END, 3.0::DOUBLE) AS held FROM factors),
wholes AS (SELECT *, CAST(floor(held) AS BIGINT) AS whole, held - floor(held) AS p FROM helds),
rests AS (SELECT *, target - CAST(sum(whole * words) OVER (PARTITION BY source) AS BIGINT) AS rest FROM wholes),
odds AS (
  SELECT s.*, source_size, target, whole, p, rest, u * (1 - p) / (u * (1 - p) + (1 - u) * p) AS v
  FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source AND s.m = r.m),
drawn AS (SELECT *, p > 0 AND sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY v) <= rest AS d0 FROM odds),
g0 AS (SELECT *, rest - coalesce(sum(size) FILTER (d0) OVER (PARTITION BY source), 0) AS gap FROM drawn),
d1 AS (SELECT *, d0 OR fits AND row_number() OVER (PARTITION BY source, fits ORDER BY abs(gap - size), v, u) = 1 AS d1 FROM (SELECT *, NOT d0 AND whole < 3 AND size > 0 AND size < 2 * gap AS fits FROM g0)),
g1 AS (SELECT * EXCLUDE (gap, fits), rest - coalesce(sum(size) FILTER (d1) OVER (PARTITION BY source), 0) AS gap FROM d1),
d2 AS (SELECT *, d1 OR fits AND row_number() OVER (PARTITION BY source, fits ORDER BY abs(gap - size), v, u) = 1 AS d2 FROM (SELECT *, NOT d1 AND whole < 3 AND size > 0 AND size < 2 * gap AS fits FROM g1)),
g2 AS (SELECT * EXCLUDE (gap, fits), rest - coalesce(sum(size) FILTER (d2) OVER (PARTITION BY source), 0) AS gap FROM d2),
d3 AS (SELECT *, d2 OR fits AND row_number() OVER (PARTITION BY source, fits ORDER BY abs(gap - size), v, u) = 1 AS d3 FROM (SELECT *, NOT d2 AND whole < 3 AND size > 0 AND size < 2 * gap AS fits FROM g2))
SELECT doc_id, size, source_size, target, least(whole + CAST(d3 AS BIGINT), 3) * size AS taken, least(whole + CAST(d3 AS BIGINT), 3) AS copies FROM d3
"""

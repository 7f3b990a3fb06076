"""Benchmark tables: repetitions of timed runs to finalized cells, gates, audits and costs.

Runs are (task, dataset, platform, variant, threads, batch, sec, peak_mb, pass, ts); variant is baseline or patched. Raw runs, as
finalize() takes them, have (task, tier, dataset, platform, cpu, variant, threads, rep, sec, peak_mb, pass, ts, note) as well; rows
without sec are markers, by their note, of runs that ran out of memory or do not apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.tables import keep_first
from quern.registry import operator
from quern.scratch import bounded, materialize

CELL = ["task", "dataset", "platform", "variant", "threads"]
NONE = "—"
#: The ten columns that make a measurement the same one, and notes of rows without seconds.
SIGNATURE = ["ts", "task", "tier", "rep", "variant", "sec", "peak_mb", "platform", "cpu", "threads"]
OOM_NOTE, NA_NOTE = "oom", "na_applicable"
SETUP = ["task", "tier", "platform", "dataset"]
#: Limits of the scaling tax, of the progress bands, and zones around thresholds.
SOFT, SOFT_XLARGE, HARD = 1.5, 2.0, 5.0
STUCK_BELOW, PLATEAU_FROM, TERMINATE_FROM, NO_KEEP, LEAST_GAIN = 50.0, 95.0, 90.0, 10, 2.0
DECISIONS = ("keep", "discard", "crash", "rollback", "oom")
METRIC_ZONE, SPEED_ZONE = 0.05, 3.0
PHASES = ("scaffold", "init", "iterate", "scaling", "package")


@operator("G28", "G30", "G43", group="benchmarks")
def timing_summary(runs: DataFrame, by: list[str], value: str = "sec") -> DataFrame:
    """n, mean, median, least, most, sd (0 for one run) and cv (from three runs on) by group."""
    n, sd = F.count(value), F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return runs.groupBy(*by).agg(n.alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), sd.alias("sd"), F.when(n >= 3, sd / F.avg(value)).alias("cv"))


@operator("G29", group="benchmarks")
def metric_ratio(df: DataFrame, by: list[str], json: str, above: str, below: str) -> DataFrame:
    """The median ratio of two numbers of a JSON column, from two rows on."""
    ratio = F.get_json_object(json, f"$.{above}").try_cast("double") / F.nullif(F.get_json_object(json, f"$.{below}").try_cast("double"), F.lit(0.0))
    got = df.withColumn("__r", ratio).groupBy(*by).agg(F.count("__r").alias("n"), F.median("__r").alias("ratio"))
    return got.select(*by, F.when(F.col("n") >= 2, F.col("ratio")).alias("ratio"))


@operator("G31", group="benchmarks")
def worst_metric(df: DataFrame, by: list[str], value: str, comparator: str) -> DataFrame:
    """The worst value of each group: the largest where smaller is better (lte), else the smallest."""
    return df.groupBy(*by, comparator).agg(F.when(F.col(comparator) == "lte", F.max(value)).otherwise(F.min(value)).alias("worst"))


@operator("G32", group="benchmarks")
def geometric_means(df: DataFrame, by: str, value: str) -> DataFrame:
    """Geometric means by group, and over all rows with a null group."""
    return df.where(F.col(value) > 0).groupingSets([[by], []], by).agg(F.exp(F.avg(F.ln(value))).alias("geomean"), F.count("*").alias("n"))


@operator("G33", "G35", group="benchmarks")
def finalize_cells(runs: DataFrame) -> DataFrame:
    """One row for each cell: runs, their times in order, mean, median, pass rate, first and last time, the version last seen."""
    reps = F.transform(F.array_sort(F.collect_list(F.struct("ts", "sec"))), lambda x: x["sec"])
    return runs.groupBy(*CELL).agg(F.count("*").alias("n_reps"), reps.alias("reps"), F.avg("sec").alias("mean_sec"), F.median("sec").alias("median_sec"), F.avg(F.col("pass").cast("double")).alias("pass_rate"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by("batch", F.when(F.col("batch").isNotNull(), F.struct("ts", "batch"))).alias("last_batch"))


@operator("G34", group="benchmarks")
def metric_medians(df: DataFrame, by: list[str], json: str) -> DataFrame:
    """By group and key of a JSON map: the median of its finite numbers, rounded to 6."""
    long = df.select(*by, F.explode(F.from_json(json, "map<string,string>")).alias("key", "raw")).withColumn("x", F.col("raw").try_cast("double"))
    return long.where("x is not null and not isnan(x) and abs(x) < double('infinity')").groupBy(*by, "key").agg(F.round(F.median("x"), 6).alias("median"))


@operator("G36", "G37", group="benchmarks")
def pair_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Baseline beside patched: mean seconds, highest peak, speed-up, and whether all patched runs passed (null if none ran)."""
    of = lambda v, c: F.when(F.col("variant") == v, F.col(c))
    got = runs.groupBy(*by).agg(F.avg(of("baseline", "sec")).alias("baseline_sec"), F.avg(of("patched", "sec")).alias("patched_sec"), F.max(of("baseline", "peak_mb")).alias("baseline_peak"), F.max(of("patched", "peak_mb")).alias("patched_peak"), F.bool_and(of("patched", "pass")).alias("all_pass"))
    return got.withColumn("speedup", F.col("baseline_sec") / F.col("patched_sec"))


@operator("G38", group="benchmarks")
def active_minutes(events: DataFrame, by: str, ts: str, most_gap: float) -> DataFrame:
    """By group: the minutes between events no further apart than most_gap minutes, and the number of events."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = (micros - F.lag(micros).over(W.partitionBy(by).orderBy(ts))) / 60e6
    return events.withColumn("__g", gap).groupBy(by).agg(F.coalesce(F.sum(F.when(F.col("__g") <= most_gap, F.col("__g"))), F.lit(0.0)).alias("minutes"), F.count("*").alias("events"))


@operator("G39", "B19", group="benchmarks")
def usage_totals(events: DataFrame, by: str, keys: list[str], model: str, amount: str, prices: DataFrame | None = None) -> DataFrame:
    """By group, after one row for each key: the amounts, the model with most rows (the smallest name of equals), and the cost
    by the models' prices (model, price)."""
    once = events.groupBy(by, *keys).agg(F.max(amount).alias(amount), F.max(model).alias(model))
    per = once.groupBy(by, model).agg(F.count("*").alias("__k"), F.sum(amount).alias("__a"))
    per = per.join(F.broadcast(prices), model, "left") if prices is not None else per.withColumn("price", F.lit(None).cast("double"))
    return per.groupBy(by).agg(F.sum("__a").alias("amount"), F.min_by(model, F.struct(-F.col("__k"), F.col(model))).alias("dominant"), F.sum(F.col("__a") * F.coalesce("price", F.lit(0.0))).alias("cost"))


@operator("G40", group="benchmarks")
def counter_difference(events: DataFrame, by: str, ts: str, value: str, low: Column, high: Column) -> DataFrame:
    """By group, of a running counter: its last value up to high less its last before low, 0 at least."""
    last = lambda cond: F.max_by(F.when(cond, F.col(value)), F.when(cond, F.col(ts)))
    return events.groupBy(by).agg(F.greatest(F.coalesce(last(F.col(ts) <= high), F.lit(0.0)) - F.coalesce(last(F.col(ts) < low), F.lit(0.0)), F.lit(0.0)).alias("used"))


@operator("G41", group="benchmarks")
def inventory(items: DataFrame, listed: DataFrame, scope: str, name: str, size: str) -> DataFrame:
    """By scope: items and bytes, those not listed (orphans), and those listed but not there (missing). listed: (scope, name)."""
    both = items.select(scope, name, size, F.lit(1).alias("here")).join(listed.select(scope, name).distinct().withColumn("known", F.lit(1)), [scope, name], "full")
    return both.groupBy(scope).agg(F.count("here").alias("items"), F.coalesce(F.sum(size), F.lit(0)).cast("double").alias("bytes"), F.count_if(F.col("known").isNull()).alias("orphans"), F.count_if(F.col("here").isNull()).alias("missing"))


@operator("G42", group="benchmarks")
def decision_rounds(rows: DataFrame, by: str, label: str, phase: str | None = None, wanted: str = "optimize") -> DataFrame:
    """By group: rows whose label is a whole number from 1 on, of the phase wanted (blank: optimize; wanted `all`: any); and for
    the parent label of the labels `parent.k`, one more than the largest k of the group."""
    number = F.col(label).try_cast("int")
    tail = F.element_at(F.split(label, r"\."), -1).try_cast("int")
    own = F.coalesce(F.nullif(F.trim(phase), F.lit("")), F.lit("optimize")) if phase else F.lit("optimize")
    counted = (number >= 1) & (F.lit(wanted == "all") | (own == wanted))
    return rows.groupBy(by).agg(F.count_if(counted).alias("rounds"), (F.coalesce(F.max(F.when(F.col(label).contains("."), tail)), F.lit(0)) + 1).alias("next"))


def usable(raw: DataFrame) -> DataFrame:
    """Rows with a variant and seconds, or a marker's note; with oom and na."""
    note, unmeasured = F.lower(F.coalesce("note", F.lit(""))), F.col("sec").isNull()
    marked = raw.withColumn("oom", unmeasured & note.contains(OOM_NOTE)).withColumn("na", unmeasured & note.contains(NA_NOTE))
    return marked.where("variant is not null and (sec is not null or oom or na)")


@operator("B2", group="benchmarks")
def rescue_names(rows: DataFrame, within: float = 0.25) -> DataFrame:
    """Rows of usable() where those without a dataset take the first real name of their task, tier, threads and platform, if for
    every variant that has both the medians differ by no more than `within` of the named one. Markers are not measured."""
    cell = ["task", "tier", "threads", "platform"]
    blank = F.col("dataset") == NONE
    name = F.min(F.when(~blank, F.struct("ts", "rep", "cpu", "dataset")))
    meds = rows.where("not oom and not na").groupBy(*cell, "variant").agg(F.median(F.when(blank, F.col("sec"))).alias("b"), F.median(F.when(~blank, F.col("sec"))).alias("r"), name.alias("first"))
    both = meds.where("b is not null and r is not null")
    fits = both.groupBy(*cell).agg(F.bool_and(F.abs(F.col("b") - F.col("r")) <= within * F.col("r")).alias("fits"), F.min_by("first.dataset", "variant").alias("real"))
    real = materialize(fits.where("fits").select(*[F.col(c).alias(f"__{c}") for c in cell], "real"), "names")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cell]
    out = rows.join(bounded(real), same, "left").withColumn("dataset", F.when(blank, F.coalesce("real", "dataset")).otherwise(F.col("dataset")))
    return out.drop("real", *[f"__{c}" for c in cell])


@operator("B3", group="benchmarks")
def pool_threads(rows: DataFrame, reduced: DataFrame, flat: DataFrame | None = None, within: float = 0.10) -> DataFrame:
    """Rows with thread_scaling: `flat` where platform and variant are in reduced or flat (platform, variant), else `scale`. Of the
    reduced, by task, tier, dataset, platform and variant, runs of more threads whose median lies within 10 % of the one-thread
    median count as one-thread runs, and the others are dropped; without one-thread seconds nothing changes. What is only
    flat is not touched."""
    cell = [*SETUP, "variant"]
    listed = reduced.select("platform", "variant", F.lit(True).alias("__reduced"))
    named = listed if flat is None else listed.unionByName(flat.select("platform", "variant", F.lit(False).alias("__reduced")))
    marked = rows.join(named.groupBy("platform", "variant").agg(F.max("__reduced").alias("__reduced")), ["platform", "variant"], "left")
    meds = marked.where("__reduced").groupBy(*cell, "threads").agg(F.median("sec").alias("__m"))
    one = meds.where("threads = 1 and __m > 0").select(*cell, F.col("__m").alias("__one"))
    verdict = meds.where("threads <> 1").join(one, cell).select(*cell, "threads", F.coalesce(F.abs(F.col("__m") / F.col("__one") - 1) <= within, F.lit(False)).alias("__pooled"))
    got = marked.join(verdict, [*cell, "threads"], "left").where("__pooled is null or __pooled")
    got = got.withColumn("threads", F.when(F.col("__pooled"), 1).otherwise(F.col("threads"))).withColumn("thread_scaling", F.when(F.col("__reduced").isNotNull(), "flat").otherwise("scale"))
    return got.drop("__reduced", "__pooled")


@operator("B4", "J7", group="benchmarks")
def effective_baseline(rows: DataFrame) -> DataFrame:
    """Rows of pool_threads() with baseline, and for patched ones speedup. The baseline is the median over all baseline runs of task,
    tier, platform and dataset if any of them is flat; else the mean at the same threads, else the mean at one thread."""
    base = rows.where("variant = 'baseline'")
    same = base.groupBy(*SETUP, "threads").agg(F.avg("sec").alias("same"))
    pooled = base.groupBy(*SETUP).agg(F.median("sec").alias("pooled"), F.max(F.col("thread_scaling") == "flat").alias("flat"), F.avg(F.when(F.col("threads") == 1, F.col("sec"))).alias("one"))
    got = rows.join(same, [*SETUP, "threads"], "left").join(pooled, SETUP, "left")
    got = got.withColumn("baseline", F.coalesce(F.when(F.col("flat"), F.col("pooled")), "same", "one")).drop("same", "pooled", "flat", "one")
    return got.withColumn("speedup", F.when((F.col("variant") == "patched") & (F.col("baseline") > 0), F.try_divide("baseline", "sec")))


@operator("B5", group="benchmarks")
def drop_nameless(cells: DataFrame, by: tuple[str, ...] = ("task", "platform")) -> DataFrame:
    """Without rows of no dataset where the same `by` has a real one."""
    named = F.max((F.col("dataset") != NONE).cast("int")).over(W.partitionBy(*by))
    return cells.withColumn("__n", named).where((F.col("dataset") != NONE) | (F.col("__n") == 0)).drop("__n")


@operator("B1", "SRC10", group="benchmarks")
def finalize(raw: DataFrame, reduced: DataFrame, flat: DataFrame | None = None) -> DataFrame:
    """The finalized table: usable rows, the first of each signature, names rescued, threads pooled, baselines found; by task, tier,
    threads, platform, dataset and variant the status (N/A, OOM, partial, ok), runs, times, speed-ups and pass rate; rows of no
    dataset dropped where the same task, tier, threads and platform has a real one. Speed-ups and pass rate are of patched
    cells only. What the rules read several times is written once."""
    once = keep_first(usable(raw), SIGNATURE, [F.asc("dataset"), F.asc("note")])
    rows = materialize(rescue_names(materialize(once, "runs")), "named")
    rows = effective_baseline(materialize(pool_threads(rows, reduced, flat), "pooled"))
    ok, patched = ~F.col("oom") & ~F.col("na"), F.col("variant") == "patched"
    of = lambda c: F.when(ok, F.col(c))
    status = F.when(F.bool_and("na"), "N/A").when(F.bool_and("oom"), "OOM").when(F.bool_or(~ok), "partial").otherwise("ok")
    cells = rows.groupBy("task", "tier", "threads", "platform", "dataset", "variant").agg(
        status.alias("status"), F.count_if(ok).alias("n_reps"), F.avg(of("sec")).alias("sec_mean"), F.median(of("sec")).alias("sec_median"), F.avg(of("peak_mb")).alias("mem_mean"), F.median(of("peak_mb")).alias("mem_median"),
        F.avg(of("speedup")).alias("speedup_mean"), F.median(of("speedup")).alias("speedup_median"), F.avg(F.when(ok & patched, F.coalesce("pass", F.lit(False)).cast("double"))).alias("pass_rate"),
        F.min("ts").alias("ts_first"), F.max("ts").alias("ts_last"), F.min("thread_scaling").alias("thread_scaling"),
    )
    return drop_nameless(cells, ("task", "tier", "threads", "platform"))


@operator("B6", group="benchmarks")
def against_batch(runs: DataFrame) -> DataFrame:
    """Each patched run beside the median baseline of its batch and task: speed-up, percent saved, change of the peak."""
    base = runs.where("variant = 'baseline'").groupBy("batch", "task").agg(F.median("sec").alias("b"), F.median("peak_mb").alias("p"))
    got = runs.where("variant = 'patched'").join(base, ["batch", "task"], "left")
    return got.select("batch", "task", "ts", "sec", "peak_mb", (F.col("b") / F.col("sec")).alias("speedup_x"), ((1 - F.col("sec") / F.col("b")) * 100).alias("saved_pct"), (F.col("peak_mb") / F.col("p")).alias("peak_x"))


@operator("B7", group="benchmarks")
def fill_dataset(rows: DataFrame, shunned: str = "_60k") -> DataFrame:
    """Rows without a dataset take one of their batch (time, tier, threads, task): its only name; where it has several, rows whose note
    begins `migrated:` take the smallest, those that end in `shunned` last, and others none."""
    batch = W.partitionBy("ts", "tier", "threads", "task")
    real = F.col("dataset") != NONE
    named = F.when(real, F.struct(F.col("dataset").endswith(shunned).alias("s"), F.col("dataset").alias("d")))
    got = rows.withColumn("__b", F.min(named).over(batch)).withColumn("__low", F.min(F.when(real, F.col("dataset"))).over(batch)).withColumn("__high", F.max(F.when(real, F.col("dataset"))).over(batch))
    take = F.when(F.col("__low") == F.col("__high"), F.col("__low")).when(F.trim("note").startswith("migrated:"), F.col("__b.d"))
    return got.withColumn("dataset", F.when(real, F.col("dataset")).otherwise(F.coalesce(take, "dataset"))).drop("__b", "__low", "__high")


@operator("B8", "P17", "W20", group="benchmarks")
def publishable(runs: DataFrame, mode: str = "full", last: int = 10, platforms: tuple[str, ...] | None = None, max_threads: int | None = None, require_pass: bool = False) -> DataFrame:
    """Runs to publish: all, those of the latest batch by platform and task (latest), of the latest batch (run), or the last
    so many by time (tail); then gates, where unknown threads pass."""
    if mode == "latest":
        newest = W.partitionBy("platform", "task").orderBy(F.desc("ts"), F.desc("batch"))
        runs = runs.withColumn("__b", F.first("batch").over(newest)).where("batch = __b").drop("__b")
    elif mode == "run":
        runs = runs.where(F.col("batch") == runs.agg(F.max_by("batch", F.struct("ts", "batch"))).scalar())
    elif mode == "tail":
        runs = runs.orderBy(F.desc("ts"), F.desc("sec"), F.desc("peak_mb")).limit(last)
    if platforms:
        runs = runs.where(F.col("platform").isin(*platforms))
    if max_threads is not None:
        runs = runs.where(F.coalesce(F.col("threads") <= max_threads, F.lit(True)))
    return runs.where("pass") if require_pass else runs


@operator("B9", "W23", group="benchmarks")
def coverage_issues(runs: DataFrame, expected_threads: list[int], least_reps: int = 3, most_cv: float = 0.25) -> DataFrame:
    """(task, platform, rule, detail): thread counts not run, cells of too few runs, unsteady cells, patched without baseline,
    failing cells, and batches whose medians drift by half or more."""
    by = ["task", "platform"]
    have = runs.groupBy(*by).agg(F.collect_set("threads").alias("have"))
    gaps = have.select(*by, F.lit("threads").alias("rule"), F.explode(F.array_except(F.array(*map(F.lit, expected_threads)).cast("array<int>"), F.col("have").cast("array<int>")).cast("array<string>")).alias("detail"))
    cells = timing_summary(runs, [*by, "variant", "threads"])
    cell = F.concat_ws("/", "variant", F.col("threads").cast("string"))
    few = cells.where(F.col("n") < least_reps).select(*by, F.lit("reps").alias("rule"), cell.alias("detail"))
    unsteady = cells.where(F.col("cv") > most_cv).select(*by, F.lit("cv").alias("rule"), cell.alias("detail"))
    sides = runs.groupBy(*by).agg(F.count_if(F.col("variant") == "baseline").alias("b"), F.count_if(F.col("variant") == "patched").alias("p"))
    lone = sides.where("b = 0 and p > 0").select(*by, F.lit("baseline").alias("rule"), F.lit("none").alias("detail"))
    failing = runs.groupBy(*by, "variant", "threads").agg(F.avg(F.col("pass").cast("double")).alias("rate")).where("rate < 0.5").select(*by, F.lit("pass").alias("rule"), cell.alias("detail"))
    eras = runs.groupBy(*by, "batch").agg(F.median("sec").alias("m")).groupBy(*by).agg(F.min("m").alias("low"), F.max("m").alias("high"))
    drift = eras.where("high >= 1.5 * low").select(*by, F.lit("drift").alias("rule"), F.lit("median").alias("detail"))
    return gaps.union(few).union(unsteady).union(lone).union(failing).union(drift)


@operator("B11", "K10", group="benchmarks")
def backfill_plan(runs: DataFrame, wanted: int = 3) -> DataFrame:
    """Cells with too few runs: how many are missing, the seconds and memory they will take, in order of work: memory first."""
    got = runs.groupBy("task", "variant", "threads").agg(F.count("*").alias("have"), F.avg("sec").alias("sec"), F.max("peak_mb").alias("peak")).withColumn("missing", wanted - F.col("have")).where("missing > 0")
    order = W.orderBy(F.desc("peak"), F.desc("sec"), "task", "threads", "variant")
    return got.select("task", "variant", "threads", "missing", (F.col("missing") * F.col("sec")).alias("cost_sec"), "peak", F.row_number().over(order).alias("place"))


@operator("B12", "B14", group="benchmarks")
def gate(value: Column, comparator: Column, threshold: Column, noise: Column | None = None) -> Column:
    """PASS, FAIL, or BORDERLINE: a pass within 5 % of the threshold, of the room 1 - threshold for gte and of the threshold for lte;
    there is none where that room is nothing. With noise, the threshold is first loosened by three times it."""
    loose = threshold if noise is None else F.when(comparator == "lte", threshold * (1 + 3 * noise)).otherwise(threshold * (1 - 3 * noise))
    room = F.greatest(F.when(comparator == "lte", F.abs(loose)).otherwise(1 - loose), F.lit(1e-6))
    margin = F.when(comparator == "lte", loose - value).otherwise(value - loose)
    return F.when(value.isNull() | (margin < 0), "FAIL").when((room > 1e-5) & (margin / room < METRIC_ZONE), "BORDERLINE").otherwise("PASS")


@operator("B14", group="benchmarks")
def speed_borderline(change_pct: Column, cv: Column, times: float = SPEED_ZONE) -> Column:
    """Whether a change in percent is within so many times the calibrated coefficient of variation; not without one."""
    return F.coalesce((cv > 0) & (F.abs(change_pct) < times * cv * 100), F.lit(False))


@operator("B13", "J9", group="benchmarks")
def scaling_tax(cells: DataFrame) -> DataFrame:
    """Cells of tiers ood_* of (tier, threads, baseline, sec, oom) beside the geometric mean factor (baseline / sec) of the other tiers
    at the same threads, or of all threads where there is none: tax = that mean over the cell's factor. PASS below 1.5 (2 for
    ood_xlarge), SOFT below 5, HARD from 5 on, ZERO without a factor. Cells out of memory are left out; no factors of other
    tiers, no rows."""
    factor = F.when((F.col("baseline") > 0) & (F.col("sec") > 0), F.col("baseline") / F.col("sec"))
    measured = cells.where("not coalesce(oom, false)").withColumn("factor", factor)
    dev = measured.where(~F.col("tier").startswith("ood_") & F.col("factor").isNotNull())
    geo = dev.groupingSets([["threads"], []], "threads").agg(F.exp(F.avg(F.ln("factor"))).alias("geo"), F.grouping("threads").alias("every"))
    whole = geo.where("every = 1 and geo is not null").select(F.col("geo").alias("overall"))
    got = measured.where(F.col("tier").startswith("ood_")).join(geo.where("every = 0").select("threads", "geo"), "threads", "left").crossJoin(F.broadcast(whole))
    got = got.withColumn("dev_reference", F.coalesce("geo", "overall")).withColumn("reference_kind", F.when(F.col("geo").isNull(), "fallback_global").otherwise("thread_matched"))
    got = got.withColumn("tax", F.coalesce(F.col("dev_reference") / F.col("factor"), F.lit(float("inf"))))
    soft = F.when(F.col("tier") == "ood_xlarge", SOFT_XLARGE).otherwise(SOFT)
    verdict = F.when(F.col("factor").isNull(), "ZERO").when(F.col("tax") >= HARD, "HARD").when(F.col("tax") >= soft, "SOFT").otherwise("PASS")
    return got.select(*cells.columns, "factor", "tax", verdict.alias("verdict"), "dev_reference", "reference_kind")


@operator("B15", "W22", group="benchmarks")
def update_last(rows: DataFrame, by: str, place: str, status: str, pending: str, value: str) -> DataFrame:
    """The most recent pending row of each group gets another status."""
    last = F.max(F.when(F.col(status) == pending, F.col(place))).over(W.partitionBy(by))
    return rows.withColumn(status, F.when(F.coalesce(F.col(place) == last, F.lit(False)) & (F.col(status) == pending), F.lit(value)).otherwise(F.col(status)))


@operator("B16", group="benchmarks")
def migrate_columns(df: DataFrame, target: list[str], defaults: dict) -> DataFrame:
    """The target columns in order; those missing get their default."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(defaults.get(c)).alias(c) for c in target])


@operator("W21", group="benchmarks")
def progress(rows: DataFrame, by: str, place: str) -> DataFrame:
    """By group of (round, status, phase, speedup_pct): best_keep (of kept rows; groups without are left out), regime
    (late_plateau from 95, early_stuck below 50, else middle), tail (decisions since the last kept one), gain (best of the last ten
    decisions less the best before, from ten on) and band: escalate below 50 after ten decisions without a keep; decide below 90,
    else terminate, after ten without or where the gain is below 2. Only the phase optimize counts (blank: optimize); decisions
    have a status of DECISIONS and a round from 1 on."""
    own = rows.where(F.coalesce(F.nullif(F.trim("phase"), F.lit("")), F.lit("optimize")) == "optimize")
    kept = own.where("status = 'keep'").groupBy(by).agg(F.max("speedup_pct").alias("best_keep")).where("best_keep is not null")
    made = own.where(F.col("status").isin(*DECISIONS) & (F.col("round").try_cast("double").cast("int") > 0)).withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(F.desc(place))))
    pct = lambda when: F.max(F.when(when, F.col("speedup_pct")))
    tails = made.groupBy(by).agg(F.coalesce(F.min(F.when(F.col("status") == "keep", F.col("__n") - 1)), F.count("*")).alias("tail"), F.count("*").alias("n"), (pct(F.col("__n") <= NO_KEEP) - pct(F.col("__n") > NO_KEEP)).alias("gain"))
    got = kept.join(tails.withColumn("gain", F.when(F.col("n") >= NO_KEEP, F.col("gain"))).drop("n"), by)
    regime = F.when(F.col("best_keep") >= PLATEAU_FROM, "late_plateau").when(F.col("best_keep") < STUCK_BELOW, "early_stuck").otherwise("middle")
    dry = F.col("tail") >= NO_KEEP
    small = dry | F.coalesce(F.col("gain") < LEAST_GAIN, F.lit(False))
    band = F.when(F.col("best_keep") < STUCK_BELOW, F.when(dry, "escalate")).when(F.col("best_keep") < TERMINATE_FROM, F.when(small, "decide")).otherwise(F.when(small, "terminate"))
    return got.select(by, "best_keep", regime.alias("regime"), "tail", "gain", band.alias("band"))


@operator("B20", group="benchmarks")
def lifecycle(tasks: DataFrame, by: str) -> DataFrame:
    """By task, from what was found of it: the last phase of PHASES that is done (`unknown` if none) and the earlier ones that are not.

    tasks: (configured, datasets, references, pipeline, evaluation, rounds, best, round_kept, ood_tiers, verified, patched): flags, and
    numbers of datasets, decision rounds, ood tiers and verified rows.
    """
    done = F.array(
        F.col("configured"),
        F.col("configured") & (F.col("datasets") >= 3) & F.col("references") & F.col("pipeline") & F.col("evaluation"),
        (F.col("rounds") >= 1) & F.col("best") & F.col("round_kept"),
        (F.col("ood_tiers") > 0) & (F.col("verified") >= 1),
        F.col("patched"),
    )
    last = F.array_max(F.transform(done, lambda d, i: F.when(d, i + 1).otherwise(0)))
    names = F.array(*map(F.lit, PHASES))
    gaps = F.filter(F.transform(done, lambda d, i: F.when(~d & (i + 1 < F.col("__last")), F.element_at(names, i + 1))), lambda x: x.isNotNull())
    got = tasks.withColumn("__last", last)
    return got.select(by, F.when(F.col("__last") > 0, F.try_element_at(names, F.col("__last"))).otherwise("unknown").alias("phase"), F.array_join(gaps, ",").alias("gaps"))


@operator("B20", group="benchmarks")
def categorize(text: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """The first category whose pattern occurs in the text, case aside."""
    out = F
    for name, pattern in rules:
        out = out.when(F.lower(text).rlike(pattern), F.lit(name))
    return out.otherwise(F.lit(default))


@operator("K9", group="benchmarks")
def search(df: DataFrame, terms: list[str], fields: dict[str, int], key: str, n: int) -> DataFrame:
    """The n rows of the highest additive score: a field's weight for each term it holds."""
    score = sum((F.when(F.lower(F.col(f)).contains(t.lower()), w).otherwise(0) for t in terms for f, w in fields.items()), F.lit(0))
    return df.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), key).limit(n)

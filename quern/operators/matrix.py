"""Sparse matrices: sums, normalisation, moments, scaling, variable features.

A matrix is (row_id, col_id, value) without rows for zeros; obs (row_id[, grp]) names all rows, also empty ones. Zeros
are accounted for from counts, never made. One shuffle by the grouping key, with partial aggregation before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.registry import operator

SQUARE = lambda c: F.col(c) * F.col(c)


def n_rows(obs: DataFrame) -> Column:
    """The number of rows, as a scalar subquery."""
    return obs.agg(F.count("*")).scalar()


def sample_variance(total: Column, squares: Column, n: Column) -> Column:
    """Null for a single row."""
    return F.when(n > 1, F.greatest(squares - total * total / n, F.lit(0.0)) / (n - 1))


@operator("G1", group="matrix")
def row_sums(cells: DataFrame) -> DataFrame:
    """(row_id, total) of rows that are not empty."""
    return cells.groupBy("row_id").agg(F.sum("value").alias("total"))


@operator("M1", group="matrix")
def normalize_total(cells: DataFrame, target: float | None = None) -> DataFrame:
    """Rows scaled to one sum: target, or else the median of the positive row sums. Empty rows stay empty."""
    sums = row_sums(cells)
    goal = F.lit(float(target)) if target is not None else F.coalesce(sums.where("total > 0").agg(F.median("total")).scalar(), F.lit(1e4))
    joined = cells.join(sums.where("total > 0"), "row_id", "left")
    return joined.select("row_id", "col_id", F.coalesce(F.col("value") * goal / F.col("total"), F.col("value")).alias("value"))


@operator("M2", group="matrix")
def log1p(cells: DataFrame) -> DataFrame:
    """ln(1 + value) of the stored values; zero stays zero."""
    return cells.withColumn("value", F.log1p("value"))


@operator("M3", group="matrix")
def log_normalize(cells: DataFrame, scale: float = 1e4) -> DataFrame:
    """Rows scaled to a sum of `scale`, then ln(1 + value)."""
    return log1p(normalize_total(cells, scale))


@operator("M13", group="matrix")
def log2_plus_one(cells: DataFrame) -> DataFrame:
    return cells.withColumn("value", F.log2(F.col("value") + 1))


@operator("M13", group="matrix")
def power_of_two(cells: DataFrame) -> DataFrame:
    """2 ** value; log2_plus_one's inverse but for the one, as its users expect."""
    return cells.withColumn("value", F.pow(F.lit(2.0), "value"))


@operator("M14", group="matrix")
def normalize_depth(cells: DataFrame, obs: DataFrame) -> DataFrame:
    """Rows scaled to the median of all row sums, empty rows included."""
    sums = row_sums(cells)
    goal = obs.join(sums, "row_id", "left").agg(F.median(F.coalesce("total", F.lit(0.0)))).scalar()
    return cells.join(sums, "row_id").select("row_id", "col_id", (F.col("value") * goal / F.col("total")).alias("value"))


@operator("G2", "G9", group="matrix")
def column_stats(cells: DataFrame, obs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """By column, over all rows: total, mean, var (n - 1), nnz, detected (above threshold; zeros too if it is negative)."""
    n = n_rows(obs)
    got = cells.groupBy("col_id").agg(F.sum("value").alias("total"), F.sum(SQUARE("value")).alias("ss"), F.count_if(F.col("value") != 0).alias("nnz"), F.count_if(F.col("value") > threshold).alias("above"))
    detected = F.col("above") + (n - F.col("nnz") if threshold < 0 else F.lit(0))
    return got.withColumn("n", n).select("col_id", "total", (F.col("total") / F.col("n")).alias("mean"), sample_variance(F.col("total"), F.col("ss"), F.col("n")).alias("var"), "nnz", detected.cast("long").alias("detected"))


@operator("G3", "G5", group="matrix")
def group_summary(cells: DataFrame, obs: DataFrame, threshold: float = 0.0, dense: bool = False) -> DataFrame:
    """By column and group: total, mean over the group's rows, detected, size. Rows without a group count nowhere.

    dense: also the pairs of a column and a group that hold nothing.
    """
    grouped = obs.where("grp is not null")
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("size"))
    got = cells.join(grouped, "row_id").groupBy("col_id", "grp").agg(F.sum("value").alias("total"), F.count_if(F.col("value") > threshold).alias("detected"))
    if dense:
        grid = cells.select("col_id").distinct().join(F.broadcast(sizes))
        got = grid.join(got, ["col_id", "grp"], "left").na.fill(0, ["total", "detected"])
    else:
        got = got.join(F.broadcast(sizes), "grp")
    return got.select("col_id", "grp", "total", (F.col("total") / F.col("size")).alias("mean"), F.col("detected").cast("long").alias("detected"), F.col("size").cast("long").alias("size"))


@operator("G4", group="matrix")
def dense_group_summary(values: DataFrame, na_rm: bool = False) -> DataFrame:
    """Of a dense table (col_id, grp, value with nulls): total, mean, detected by column and group.

    A null poisons its cell, or with na_rm is left out, of the count as well.
    """
    got = values.groupBy("col_id", "grp").agg(F.sum("value").alias("t"), F.count("value").alias("n"), F.count("*").alias("size"), F.count_if(F.col("value") > 0).cast("long").alias("d"))
    whole = F.lit(True) if na_rm else F.col("n") == F.col("size")
    by = F.col("n") if na_rm else F.col("size")
    return got.select("col_id", "grp", F.when(whole, F.coalesce("t", F.lit(0.0))).alias("total"), F.when(whole & (by > 0), F.col("t") / by).alias("mean"), F.when(whole, F.col("d")).alias("detected"))


@operator("G10", group="matrix")
def group_expm1(cells: DataFrame, obs: DataFrame) -> DataFrame:
    """By column and group: nnz, and the sum of exp(value) - 1."""
    return cells.join(obs.where("grp is not null"), "row_id").groupBy("col_id", "grp").agg(F.count_if(F.col("value") > 0).cast("long").alias("nnz"), F.sum(F.expm1("value")).alias("total"))


@operator("G7", group="matrix")
def batch_moments(cells: DataFrame, obs: DataFrame) -> DataFrame:
    """Mean and variance by batch and column, and by column over all (batch null), in one pass of grouping sets."""
    sizes = obs.groupBy("grp").agg(F.count("*").alias("n")).union(obs.select(F.lit(None).cast("string"), F.count("*").over(W.partitionBy())).limit(1))
    sets = cells.join(obs, "row_id").groupingSets([["grp", "col_id"], ["col_id"]], "grp", "col_id").agg(F.sum("value").alias("s"), F.sum(SQUARE("value")).alias("ss"))
    joined = sets.alias("a").join(F.broadcast(sizes).alias("b"), F.col("a.grp").eqNullSafe(F.col("b.grp")))
    return joined.select("a.grp", "col_id", (F.col("s") / F.col("n")).alias("mean"), sample_variance(F.col("s"), F.col("ss"), F.col("n")).alias("var"))


@operator("G8", group="matrix")
def clipped_sums(cells: DataFrame, obs: DataFrame, clip: DataFrame) -> DataFrame:
    """By batch and column: sums of min(value, clip) and of its square. clip: (grp, col_id, clip)."""
    low = F.least("value", "clip")
    return cells.join(obs, "row_id").join(clip, ["grp", "col_id"]).groupBy("grp", "col_id").agg(F.sum(low).alias("total"), F.sum(low * low).alias("squares"))


@operator("G9", group="matrix")
def standardized_variance(cells: DataFrame, obs: DataFrame, fitted: DataFrame, clip: float | None = None) -> DataFrame:
    """By column: the variance of (value - mean) / sd, from above clipped at `clip` (square root of the rows), zeros included.

    fitted: (col_id, mean, sd).
    """
    n = n_rows(obs)
    most = F.lit(clip) if clip is not None else F.sqrt(n)
    z = F.least((F.col("value") - F.col("mean")) / F.col("sd"), F.col("most"))
    got = cells.join(fitted.where("sd > 0"), "col_id").withColumn("most", most).groupBy("col_id", "mean", "sd").agg(F.sum(z * z).alias("ss"), F.count("*").alias("nnz"))
    return got.withColumn("n", n).select("col_id", ((F.col("ss") + (F.col("n") - F.col("nnz")) * F.pow(F.col("mean") / F.col("sd"), 2)) / (F.col("n") - 1)).alias("variance_standardized"))


@operator("G11", group="matrix")
def group_trimean(cells: DataFrame, obs: DataFrame) -> DataFrame:
    """(Q1 + 2 Q2 + Q3) / 4 by column and group over all rows of the group, zeros included.

    Only the few stored values next to each quartile count: their ranks follow from the number of zeros.
    """
    sizes = obs.where("grp is not null").groupBy("grp").agg(F.count("*").alias("n"))
    ranked = cells.where("value <> 0").join(obs, "row_id").join(F.broadcast(sizes), "grp")
    own = W.partitionBy("col_id", "grp")
    zeros = F.col("n") - F.count("*").over(own)
    at = F.row_number().over(own.orderBy("value")) - 1 + F.when(F.col("value") > 0, zeros).otherwise(0)
    placed = ranked.withColumn("at", at)
    parts = []
    for share, weight in ((0.25, 0.25), (0.5, 0.5), (0.75, 0.25)):
        place = (F.col("n") - 1) * share
        low = F.floor(place)
        rest = place - low
        parts.append(F.when(F.col("at") == low, F.col("value") * (1 - rest)).when((F.col("at") == low + 1), F.col("value") * rest).otherwise(0) * weight)
    return placed.groupBy("col_id", "grp").agg(F.sum(parts[0] + parts[1] + parts[2]).alias("trimean"))


def densify(cells: DataFrame, obs: DataFrame, columns: DataFrame) -> DataFrame:
    """All cells of obs x columns, zeros as rows. For operators whose result is dense."""
    return obs.select("row_id").join(F.broadcast(columns.select("col_id"))).join(cells, ["row_id", "col_id"], "left").na.fill(0.0, ["value"])


@operator("M4", "M5", group="matrix")
def scale(cells: DataFrame, obs: DataFrame, most: float | None = None, both_sides: bool = True) -> DataFrame:
    """(value - mean) / sd by column, clipped at `most`, from below as well or not; dense. A constant column has sd 1."""
    stats = column_stats(cells, obs).select("col_id", "mean", F.when(F.col("var") > 0, F.sqrt("var")).otherwise(1.0).alias("sd"))
    z = (F.col("value") - F.col("mean")) / F.col("sd")
    if most is not None:
        z = F.least(z, F.lit(most))
        z = F.greatest(z, F.lit(-most)) if both_sides else z
    return densify(cells, obs, stats).join(F.broadcast(stats), "col_id").select("row_id", "col_id", z.alias("value"))


@operator("G6", "W8", group="matrix")
def dispersions(cells: DataFrame, obs: DataFrame, bins: int = 20) -> DataFrame:
    """By column of ln(1 + x) values: log mean, log dispersion of x, and the dispersion's z-score within bins of the log mean."""
    n = n_rows(obs)
    x = F.expm1("value")
    got = cells.groupBy("col_id").agg(F.sum(x).alias("s"), F.sum(x * x).alias("ss")).withColumn("n", n)
    mean = F.when(F.col("s") == 0, 1e-12).otherwise(F.col("s") / F.col("n"))
    got = got.withColumn("m", mean).withColumn("v", F.greatest(F.col("ss") - F.col("n") * SQUARE("m"), F.lit(0.0)) / (F.col("n") - 1))
    got = got.select("col_id", F.log1p("m").alias("means"), F.when(F.col("v") > 0, F.ln(F.col("v") / F.col("m"))).alias("dispersions"))
    edges = got.agg(F.min("means").alias("low"), F.max("means").alias("high"))
    width = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / bins).otherwise(1.0)
    got = got.join(F.broadcast(edges)).withColumn("bin", F.least(F.greatest(F.floor((F.col("means") - F.col("low")) / width), F.lit(0)), F.lit(bins - 1)).cast("int"))
    # At most `bins` rows: aggregated before the shuffle, broadcast to the columns.
    by = got.groupBy("bin").agg(F.avg("dispersions").alias("avg"), F.stddev_samp("dispersions").alias("sd"), F.count("dispersions").alias("k"))
    by = by.select("bin", F.when(F.col("k") == 1, 0.0).otherwise(F.col("avg")).alias("avg"), F.when(F.col("k") == 1, F.col("avg")).otherwise(F.col("sd")).alias("sd"), F.col("avg").alias("plain"))
    sd = F.when(F.col("sd") == 0, F.when(F.col("plain") == 0, 1.0).otherwise(F.col("plain"))).otherwise(F.col("sd"))
    return got.join(F.broadcast(by), "bin").select("col_id", "means", "dispersions", "bin", ((F.col("dispersions") - F.col("avg")) / sd).alias("dispersions_norm"))


@operator("M6", "M9", "P14", "K3", group="matrix")
def variable_features(cells: DataFrame, obs: DataFrame, top: int | None = None, bins: int = 20, min_mean: float = 0.0125, max_mean: float = 3.0, min_disp: float = 0.5, max_disp: float = float("inf")) -> DataFrame:
    """dispersions() with `highly_variable`: the top ones by normalised dispersion, ties at the cut included, or those within limits."""
    got = dispersions(cells, obs, bins)
    if top is not None:
        # The cut is one value: found by a top-k over all columns, without a global sort.
        least = got.where("dispersions_norm is not null").orderBy(F.desc("dispersions_norm")).limit(top).agg(F.min("dispersions_norm")).scalar()
        chosen = F.col("dispersions_norm") >= least
    else:
        d = F.coalesce("dispersions_norm", F.lit(0.0))
        chosen = (F.col("means") > min_mean) & (F.col("means") < max_mean) & (d > min_disp) & (d < max_disp)
    return got.withColumn("highly_variable", F.coalesce(chosen, F.lit(False)))


@operator("P8", group="matrix")
def columns_by_mean(cells: DataFrame, obs: DataFrame, cutoff: float) -> DataFrame:
    """The cells of columns whose mean over all rows is at least cutoff."""
    kept = cells.groupBy("col_id").agg(F.sum("value").alias("s")).where(F.col("s") / n_rows(obs) >= cutoff).select("col_id")
    return cells.join(kept, "col_id", "left_semi")


@operator("P9", group="matrix")
def columns_by_count(cells: DataFrame, least: int) -> DataFrame:
    """The cells of columns with values above zero in at least so many rows."""
    kept = cells.groupBy("col_id").agg(F.count_if(F.col("value") > 0).alias("k")).where(F.col("k") >= least).select("col_id")
    return cells.join(kept, "col_id", "left_semi")


@operator("P10", group="matrix")
def mean_implies_count(least_value: float, most_value: float, cutoff: float, rows: int, least: int) -> bool:
    """Whether a column mean of at least cutoff implies values above zero in `least` rows, so columns_by_count can be left out."""
    return least_value >= 0 and most_value * (least - 1) < cutoff * rows


@operator("P11", group="matrix")
def good_columns(values: DataFrame) -> DataFrame:
    """Of a dense table with nulls: whether each column has no null and varies."""
    return values.groupBy("col_id").agg((F.count_if(F.col("value").isNull()) == 0).alias("complete"), F.coalesce(F.var_samp("value") > 0, F.lit(False)).alias("varies"))


@operator("P12", "P13", group="matrix")
def value_checks(cells: DataFrame) -> DataFrame:
    """One row: whether all values are finite, and whether any is no count (negative or fractional)."""
    v = F.col("value")
    return cells.agg(F.coalesce(F.bool_and(~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(True)).alias("finite"), F.coalesce(F.bool_or((v < 0) | (v != F.floor(v))), F.lit(False)).alias("not_counts"))


@operator("M15", group="matrix")
def subtract_reference(values: DataFrame, references: DataFrame, bounds: bool = True, inverse_log: bool = False) -> DataFrame:
    """A dense table less the reference rows' level by column: outside the range of the reference groups' means by what
    exceeds it and zero inside, or without bounds less the mean of the means. references: (row_id, grp)."""
    x = F.pow(F.lit(2.0), "value") - 1 if inverse_log else F.col("value")
    means = values.join(F.broadcast(references), "row_id").groupBy("col_id", "grp").agg(F.avg(x).alias("m"))
    means = means.withColumn("m", F.log2(F.col("m") + 1)) if inverse_log else means
    level = means.groupBy("col_id").agg(F.min("m").alias("low"), F.max("m").alias("high"), F.avg("m").alias("mid"))
    less = F.least(F.greatest(F.col("value"), F.col("low")), F.col("high")) if bounds else F.col("mid")
    return values.join(level, "col_id").select("row_id", "col_id", (F.col("value") - less).alias("value"))


@operator("M16", group="matrix")
def center_rows(values: DataFrame, by: str = "median") -> DataFrame:
    """A dense table less its rows' medians or means."""
    level = values.groupBy("row_id").agg((F.median if by == "median" else F.avg)("value").alias("level"))
    return values.join(level, "row_id").select("row_id", "col_id", (F.col("value") - F.col("level")).alias("value"))


@operator("M17", group="matrix")
def clamp(values: DataFrame, most: float) -> DataFrame:
    return values.withColumn("value", F.least(F.greatest("value", F.lit(-most)), F.lit(most)))


@operator("W15", "W16", group="matrix")
def smooth(values: DataFrame, order: DataFrame, window: int = 101) -> DataFrame:
    """Triangular moving average of each row along the columns of a block, with weights cut at the ends and renormalised.

    order: (col_id, block, place), places whole numbers; the result has the cells of values. A window below 2 changes nothing.
    """
    placed = values.join(F.broadcast(order), "col_id")
    if window < 2:
        return placed.select("row_id", "col_id", "value")
    tail = (window - 1) // 2
    own = W.partitionBy("row_id", "block").orderBy("place")
    left, right = own.rangeBetween(-tail, 0), own.rangeBetween(1, tail)
    i = F.col("place")

    def weighted(x: Column) -> Column:
        """The sum of x by weight tail + 1 - distance, from plain and place-weighted sums on either side: one sort, one pass."""
        side = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0.0))
        return (tail + 1 - i) * side(x, left) + side(x * i, left) + (tail + 1 + i) * side(x, right) - side(x * i, right)

    return placed.select("row_id", "col_id", (weighted(F.col("value")) / weighted(F.lit(1.0))).alias("value"))


@operator("M18", group="matrix")
def copy_number_smoothing(cells: DataFrame, obs: DataFrame, references: DataFrame, order: DataFrame, cutoff: float = 0.1, least: int = 3, window: int = 101, most: float = 3.0) -> DataFrame:
    """Filters, depth normalisation, logs, reference subtraction, smoothing, centring, subtraction again, and back from logs."""
    kept = columns_by_count(columns_by_mean(cells, obs, cutoff), least)
    logged = log2_plus_one(normalize_depth(kept, obs))
    grid = densify(logged, obs, kept.select("col_id").distinct())
    places = order.join(kept.select("col_id").distinct(), "col_id", "left_semi").withColumn("place", F.row_number().over(W.partitionBy("block").orderBy("place")))
    flat = clamp(subtract_reference(grid, references), most)
    return power_of_two(subtract_reference(center_rows(smooth(flat, places, window)), references))


@operator("M19", "M20", group="matrix")
def pearson_residuals(cells: DataFrame, rows: DataFrame, model: DataFrame, clip: float, center: bool = False) -> DataFrame:
    """Residuals of a negative binomial model on the dense grid: mu = exp(b0) * base, var = mu + mu**2 / theta, clipped.

    rows: (row_id, base); model: (col_id, b0, theta).
    """
    grid = rows.join(F.broadcast(model)).join(cells, ["row_id", "col_id"], "left").na.fill(0.0, ["value"])
    mu = F.exp("b0") * F.col("base")
    got = grid.withColumn("mu", mu).withColumn("sd", F.sqrt(F.greatest(F.col("mu") + SQUARE("mu") / F.col("theta"), F.lit(1e-12))))
    got = got.select("row_id", "col_id", F.least(F.greatest((F.col("value") - F.col("mu")) / F.col("sd"), F.lit(-clip)), F.lit(clip)).alias("value"))
    if center:
        level = got.groupBy("col_id").agg(F.avg("value").alias("level"))
        got = got.join(F.broadcast(level), "col_id").select("row_id", "col_id", (F.col("value") - F.col("level")).alias("value"))
    return got


@operator("M11", "M12", group="matrix")
def prepare(cells: DataFrame) -> DataFrame:
    """The canonical types; zeros dropped, repeated cells added. Orientation is the caller's choice of names."""
    typed = cells.select(F.col("row_id").cast("long"), F.col("col_id").cast("long"), F.col("value").cast("double"))
    return typed.groupBy("row_id", "col_id").agg(F.sum("value").alias("value")).where("value <> 0")


@operator("E28", group="matrix")
def times_vector(cells: DataFrame, vectors: DataFrame) -> DataFrame:
    """The product with one or several vectors (col_id, k, x): (row_id, k, y)."""
    return cells.join(vectors, "col_id").groupBy("row_id", "k").agg(F.sum(F.col("value") * F.col("x")).alias("y"))


@operator("G26", group="matrix")
def gram(cells: DataFrame) -> DataFrame:
    """The product of the transpose and the matrix, upper half: (a, b, value). Work grows with the square of a row's values."""
    left = cells.select("row_id", F.col("col_id").alias("a"), F.col("value").alias("x"))
    right = cells.select("row_id", F.col("col_id").alias("b"), F.col("value").alias("y"))
    return left.join(right, "row_id").where("a <= b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


@operator("M22", group="matrix")
def native_counts(cells: DataFrame, theta: DataFrame, phi: DataFrame, eta: DataFrame) -> DataFrame:
    """Counts times the chance of being native: theta phi / (theta phi + (1 - theta) eta). theta: (row_id, z, theta);
    phi, eta: (z, col_id, phi / eta)."""
    joined = cells.join(theta, "row_id").join(phi, ["z", "col_id"]).join(eta, ["z", "col_id"])
    own, other = F.col("theta") * F.col("phi"), (1 - F.col("theta")) * F.col("eta")
    return joined.select("row_id", "col_id", (F.col("value") * own / (own + other)).alias("value"))

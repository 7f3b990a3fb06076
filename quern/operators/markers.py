"""Rank tests and marker tables over sparse matrices, p-value adjustment, ranked selections.

Ranks come from counts by distinct value: rows are aggregated by (column, value, group) before the shuffle, the running
count goes over distinct values of a column, and zeros take part through their number alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.special import two_sided
from quern.operators.matrix import n_rows
from quern.registry import operator


@operator("W1", "W2", group="markers")
def rank_sums(cells: DataFrame, obs: DataFrame) -> DataFrame:
    """By column and group: size, nnz, rank_sum (ties share their mean rank, zeros as well), n, and the column's tie sums.

    ties: sum of t**3 - t over all runs of equal values, zeros included; ties_but_last leaves out the run of the largest
    value. Every group has a row for every column that holds anything. Values are above zero.
    """
    sizes = obs.where("grp is not null").groupBy("grp").agg(F.count("*").alias("size"))
    counted = cells.join(obs, "row_id").groupBy("col_id", "value", "grp").agg(F.count("*").alias("k"))
    runs = counted.groupBy("col_id", "value").agg(F.sum("k").alias("t"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("grp", F.lit("\0")), "k"))).alias("by"))
    up = W.partitionBy("col_id").orderBy("value")
    whole = W.partitionBy("col_id")
    runs = runs.withColumn("n", n_rows(obs)).withColumn("zeros", F.col("n") - F.sum("t").over(whole))
    runs = runs.withColumn("rank", F.col("zeros") + F.sum("t").over(up.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("t") + (F.col("t") + 1) / 2).withColumn("last", F.row_number().over(whole.orderBy(F.desc("value"))) == 1)
    cube = lambda c: F.pow(F.col(c).cast("double"), 3) - F.col(c)
    per = runs.groupBy("col_id").agg(F.any_value("n").alias("n"), F.any_value("zeros").alias("zeros"), F.sum(cube("t")).alias("t_all"), F.sum(F.when(F.col("last"), 0).otherwise(cube("t"))).alias("t_part"))
    zero_ties = F.when(F.col("zeros") > 0, cube("zeros")).otherwise(0)
    per = per.select("col_id", "n", "zeros", (F.col("t_all") + zero_ties).alias("ties"), (F.col("t_part") + zero_ties).alias("ties_but_last"))
    held = runs.select("col_id", "rank", F.explode("by").alias("grp", "k")).groupBy("col_id", "grp").agg(F.sum(F.col("k") * F.col("rank")).alias("held"), F.sum("k").alias("nnz"))
    full = per.join(F.broadcast(sizes)).join(held, ["col_id", "grp"], "left").na.fill(0, ["held", "nnz"])
    return full.select("col_id", "grp", "size", "nnz", (F.col("held") + (F.col("size") - F.col("nnz")) * (F.col("zeros") + 1) / 2).alias("rank_sum"), "n", "ties", "ties_but_last")


@operator("W3", "W4", "W5", group="markers")
def wilcoxon(ranks: DataFrame, flavor: str = "plain") -> DataFrame:
    """rank_sums() with z and p of each group against the rest.

    plain: no correction. partial_ties: continuity 0.5 towards zero, ties but the last run. all_ties: all ties, continuity
    by sign. floored: all ties, continuity floored at zero, no variance gives p = 1.
    """
    n1, n, rank = F.col("size").cast("double"), F.col("n").cast("double"), F.col("rank_sum")
    n2 = n - n1
    if flavor == "plain":
        z = (rank - n1 * (n + 1) / 2) / F.sqrt(n1 * n2 * (n + 1) / 12)
    else:
        ties = F.col("ties_but_last" if flavor == "partial_ties" else "ties")
        sigma = F.sqrt(F.greatest(n1 * n2 * ((n * n * n - n) - ties) / (12 * (n * n - n)), F.lit(0.0)))
        off = rank - n1 * (n1 + 1) / 2 - n1 * n2 / 2
        if flavor == "floored":
            off = F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0))
        else:
            off = off - F.signum(off) * 0.5
        z = F.when(sigma > 0, off / sigma)
    got = ranks.withColumn("z", F.coalesce(F.when(~F.isnan(z), z), F.lit(0.0)) + F.lit(0.0))
    return got.withColumn("p", two_sided(F.col("z")))


@operator("W6", group="markers")
def adjust_bh(tests: DataFrame, by: list[str], p: str = "p", out: str = "p_adj") -> DataFrame:
    """Benjamini and Hochberg's adjustment within groups: the running least of p n / rank from the largest p down, 1 at most."""
    own = W.partitionBy(*by)
    ranked = tests.withColumn("__n", F.count(p).over(own)).withColumn("__r", F.row_number().over(own.orderBy(F.asc_nulls_last(p))))
    low = F.min(F.col(p) * F.col("__n") / F.col("__r")).over(own.orderBy(F.desc("__r")).rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.least(low, F.lit(1.0)))).drop("__n", "__r")


@operator("W7", group="markers")
def adjust_bonferroni(p: Column, n: Column) -> Column:
    return F.least(p * n, F.lit(1.0))


@operator("K1", "K4", "K5", "K7", group="markers")
def top_by_group(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group. The order must end in a key: ties are not left to chance. Spark keeps n rows of
    each group before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


@operator("E1", group="markers")
def rank_genes_groups(logged: DataFrame, obs: DataFrame, n_genes: int | None = 100, correction: str = "bh", by_abs: bool = False, groups: list[str] | None = None) -> DataFrame:
    """Marker table of each group against all other rows: z, p, p_adj, log2 fold change, share of rows above zero.

    logged holds ln(1 + x). The rest of a group is always all other rows, also if only some groups are asked for.
    """
    tests = wilcoxon(rank_sums(logged, obs))
    sums = logged.join(obs.where("grp is not null"), "row_id").groupBy("col_id", "grp").agg(F.sum("value").alias("s"))
    totals = logged.groupBy("col_id").agg(F.sum("value").alias("total"), F.count("*").alias("above"))
    got = tests.join(sums, ["col_id", "grp"], "left").join(totals, "col_id").na.fill(0, ["s"])
    rest = F.col("n") - F.col("size")
    change = F.log2((F.expm1(F.col("s") / F.col("size")) + 1e-9) / (F.expm1((F.col("total") - F.col("s")) / rest) + 1e-9))
    got = got.withColumns({"log2fc": change, "pts": F.col("nnz") / F.col("size"), "pts_rest": (F.col("above") - F.col("nnz")) / rest})
    if groups is not None:
        got = got.where(F.col("grp").isin(groups))
    got = adjust_bh(got, ["grp"]) if correction == "bh" else got.withColumn("p_adj", F.least(F.col("p") * F.count("*").over(W.partitionBy("grp")), F.lit(1.0)))
    got = got.select("grp", "col_id", "z", "p", "p_adj", "log2fc", "pts", "pts_rest")
    key = F.abs("z") if by_abs else F.col("z")
    return got if n_genes is None else top_by_group(got, ["grp"], [key.desc(), F.col("col_id").asc()], n_genes)


@operator("E2", "E3", "P15", "K6", group="markers")
def find_markers(logged: DataFrame, obs: DataFrame, flavor: str = "partial_ties", logfc: float = 0.1, min_pct: float = 0.01, only_pos: bool = False, min_rows: int = 3, return_p: float | None = 0.01) -> DataFrame:
    """Markers of every group by rounded shares and fold changes of sums, tested by Wilcoxon, Bonferroni over all columns.

    Groups of fewer than min_rows rows are left out. return_p None keeps all that pass the gates.
    """
    ranks = rank_sums(logged, obs).where(F.col("size") >= min_rows)
    x = F.expm1("value")
    sums = logged.join(obs.where("grp is not null"), "row_id").groupBy("col_id", "grp").agg(F.sum(x).alias("s"))
    totals = logged.groupBy("col_id").agg(F.sum(x).alias("total"), F.count("*").alias("above"))
    columns = totals.agg(F.count("*")).scalar()
    got = ranks.join(sums, ["col_id", "grp"], "left").join(totals, "col_id").na.fill(0, ["s"])
    n2 = F.col("n") - F.col("size")
    got = got.withColumns({"avg_log2fc": F.log2((F.col("s") + 1) / F.col("size")) - F.log2((F.col("total") - F.col("s") + 1) / n2), "pct_1": F.round(F.col("nnz") / F.col("size"), 3), "pct_2": F.round((F.col("above") - F.col("nnz")) / n2, 3)})
    strong = F.col("avg_log2fc") >= logfc if only_pos else F.abs("avg_log2fc") >= logfc
    tests = wilcoxon(got.where((F.greatest("pct_1", "pct_2") >= min_pct) & strong), flavor)
    tests = tests.withColumn("p_adj", F.least(F.col("p") * columns, F.lit(1.0)))
    if return_p is not None:
        tests = tests.where(F.col("p") < return_p)
    return tests.select("grp", "col_id", "z", "p", "avg_log2fc", "pct_1", "pct_2", "p_adj")

"""Tables of variants and annotations, pivots, first-row dedupes, ranked lookups and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.registry import operator

#: The columns a variant table must have, and the classes that change a protein.
VARIANT_COLUMNS = ("Hugo_Symbol", "Chromosome", "Start_Position", "End_Position", "Reference_Allele", "Tumor_Seq_Allele2", "Variant_Classification", "Variant_Type", "Tumor_Sample_Barcode")
NON_SILENT = ("Frame_Shift_Del", "Frame_Shift_Ins", "Splice_Site", "Translation_Start_Site", "Nonsense_Mutation", "Nonstop_Mutation", "In_Frame_Del", "In_Frame_Ins", "Missense_Mutation")


@operator("P1", group="tables")
def canonical_columns(df: DataFrame, wanted: tuple[str, ...] = VARIANT_COLUMNS) -> DataFrame:
    """Columns renamed to the wanted spelling, whatever their case; an error names the first that is missing."""
    have: dict[str, str] = {}
    for c in df.columns:
        have.setdefault(c.lower(), c)
    for c in wanted:
        if c.lower() not in have:
            raise ValueError(f"missing column {c}")
    return df.withColumnsRenamed({have[c.lower()]: c for c in wanted})


@operator("P2", group="tables")
def blank_to(c: Column, value: str = "Unknown") -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(value))


@operator("U1", "U2", "U7", group="tables")
def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which stands for the order in the file."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


@operator("P3", "P4", "P5", group="tables")
def clean_variants(df: DataFrame, order: list[Column], barcodes: bool = False, drop_genes: tuple[str, ...] = (), non_silent: tuple[str, ...] = NON_SILENT, remove_duplicates: bool = True) -> DataFrame:
    """Variants with canonical names, no blank genes, typed positions, first of duplicates, flagged genes dropped, and `silent`:
    whatever is not in the list of non-silent classes."""
    got = canonical_columns(df).withColumn("Hugo_Symbol", blank_to(F.col("Hugo_Symbol")))
    if barcodes:
        got = got.withColumn("Tumor_Sample_Barcode", F.substring("Tumor_Sample_Barcode", 1, 12))
    got = got.withColumns({c: F.col(c).try_cast("long") for c in ("Start_Position", "End_Position")})
    if remove_duplicates:
        got = keep_first(got, ["Chromosome", "Start_Position", "Tumor_Sample_Barcode", "Reference_Allele", "Tumor_Seq_Allele2"], order)
    if drop_genes:
        got = got.where(~F.col("Hugo_Symbol").isin(*drop_genes))
    return got.withColumn("silent", ~F.coalesce(F.col("Variant_Classification").isin(*non_silent), F.lit(False)))


@operator("G18", group="tables")
def pivot_all(df: DataFrame, row: str, column: str, levels: list, rows: DataFrame | None = None) -> DataFrame:
    """Counts of every row by every level, 0 where there are none; rows adds rows without any."""
    got = df.groupBy(row).pivot(column, levels).count()
    if rows is not None:
        got = rows.select(row).distinct().join(got, row, "left")
    return got.na.fill(0)


@operator("G16", "G17", "G19", "J2", "J3", group="tables")
def gene_summary(variants: DataFrame, classes: list[str], copy_types: tuple[str, ...] = ("Amp", "Del")) -> DataFrame:
    """By gene: counts of each class without copy-number types, total, CNV_total, MutatedSamples (no copy-number types) and
    AlteredSamples (all)."""
    cnv = F.col("Variant_Type").isin(*copy_types)
    counts = [F.count_if((F.col("Variant_Classification") == c) & ~cnv).alias(c) for c in classes]
    sample = F.col("Tumor_Sample_Barcode")
    return variants.groupBy("Hugo_Symbol").agg(*counts, F.count_if(~cnv).alias("total"), F.count_if(cnv).alias("CNV_total"), F.countDistinct(F.when(~cnv, sample)).alias("MutatedSamples"), F.countDistinct(sample).alias("AlteredSamples"))


@operator("G17", "G18", group="tables")
def sample_summary(variants: DataFrame, classes: list[str]) -> DataFrame:
    """By sample: counts of each class and their total; samples without variants do not appear."""
    counts = [F.count_if(F.col("Variant_Classification") == c).alias(c) for c in classes]
    return variants.groupBy("Tumor_Sample_Barcode").agg(*counts, F.count("*").alias("total"))


@operator("G20", group="tables")
def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: mean and median, rounded to 3, and sum."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "name", "value")
    return long.groupBy("name").agg(F.round(F.avg("value"), 3).alias("mean"), F.round(F.median("value"), 3).alias("median"), F.sum("value").alias("total"))


@operator("G21", group="tables")
def distinct_joined(df: DataFrame, column: str, order: str, sep: str = ";") -> DataFrame:
    """One row: the distinct values in the order in which they first occur, joined."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("at"))
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(column).cast("string").alias("v")))), lambda x: x["v"]), sep).alias("values"))


@operator("J4", group="tables")
def annotate(samples: DataFrame, notes: DataFrame, key: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The first note of each sample that occurs, and the samples without one."""
    first = keep_first(notes, [key], order)
    return first.join(samples.select(key).distinct(), key, "left_semi"), samples.select(key).distinct().join(first, key, "left_anti")


@operator("J8", group="tables")
def ranked_lookup(asked: DataFrame, base: DataFrame, key: str, exact: str, place: str) -> DataFrame:
    """For each row asked (key, exact): the base row of the key with the same `exact`, else the first by place."""
    joined = asked.join(base.select(key, F.col(exact).alias("__have"), *[c for c in base.columns if c not in (key, exact)]), key, "left")
    best = F.row_number().over(W.partitionBy(key, exact).orderBy((F.col("__have") == F.col(exact)).desc_nulls_last(), F.col(place).asc_nulls_last()))
    return joined.withColumn("__n", best).where("__n = 1").drop("__n", "__have")


@operator("J17", "B18", group="tables")
def upsert(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """old and new, one row to a key: the later by `at`, of equal ones the new, of equal ones of one table the smallest by its
    other columns in their order."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    ties = [F.asc(c) for c in both.columns if c not in (*keys, at, "__new")]
    return both.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), F.desc("__new"), *ties))).where("__n = 1").drop("__n", "__new")


@operator("J16", group="tables")
def compare(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """By key: both values, their difference, and whether it appeared, disappeared or is common."""
    left, right = a.select(key, F.col(value).alias("before")), b.select(key, F.col(value).alias("after"))
    change = F.when(F.col("before").isNull(), "appeared").when(F.col("after").isNull(), "disappeared").otherwise("common")
    return left.join(right, key, "full").select(key, "before", "after", (F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))).alias("change"), change.alias("status"))


@operator("J1", group="tables")
def mean_by_translation(values: DataFrame, names: DataFrame, key: str, to: str, value: str) -> DataFrame:
    """Values under the ids that names translate theirs to; the mean where several meet."""
    return values.join(names.select(key, to), key).groupBy(to).agg(F.avg(value).alias(value))


@operator("P6", group="tables")
def both_known(pairs: DataFrame, a: str, b: str, *known: DataFrame) -> DataFrame:
    """The pairs whose both ids are in one of the lists (of one column each)."""
    ids = known[0].toDF("id")
    for k in known[1:]:
        ids = ids.union(k.toDF("id"))
    ids = ids.distinct()
    return pairs.join(ids.withColumnRenamed("id", a), a, "left_semi").join(ids.withColumnRenamed("id", b), b, "left_semi")


@operator("P7", group="tables")
def pair_name(is_complex_a: Column, name_a: Column, gene_a: Column, is_complex_b: Column, name_b: Column, gene_b: Column) -> Column:
    return F.concat_ws("_", F.when(is_complex_a, name_a).otherwise(gene_a), F.when(is_complex_b, name_b).otherwise(gene_b))


@operator("G14", group="tables")
def row_mode(df: DataFrame, key: str, state: str) -> DataFrame:
    """The most frequent state of each key, the smallest of equals; nulls do not count."""
    counted = df.where(F.col(state).isNotNull()).groupBy(key, state).agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.max_by(state, F.struct("n", -F.col(state))).alias(state))


@operator("G15", group="tables")
def state_shares(df: DataFrame, key: str, state: str, states: list) -> DataFrame:
    """The share of each state among a key's states that are known; null where none is."""
    n = F.count(state)
    return df.groupBy(key).agg(*[F.when(n > 0, F.count_if(F.col(state) == s) / n).alias(f"p_{s}") for s in states])


@operator("G13", group="tables")
def trimmed_mean(df: DataFrame, key: str, value: str, trim: float) -> DataFrame:
    """The mean of each key's values without the share `trim` at either end."""
    own = W.partitionBy(key)
    placed = df.withColumn("__i", F.row_number().over(own.orderBy(value))).withColumn("__n", F.count("*").over(own)).withColumn("__low", F.floor(F.col("__n") * trim) + 1)
    return placed.where((F.col("__i") >= F.col("__low")) & (F.col("__i") <= F.col("__n") + 1 - F.col("__low"))).groupBy(key).agg(F.avg(value).alias("trimmed"))


@operator("G22", group="tables")
def poisson_deviance(df: DataFrame, y: str, mu: str) -> DataFrame:
    """2 sum(y ln(y / mu) - (y - mu)), the first term 0 where y is."""
    term = F.when(F.col(y) > 0, F.col(y) * F.ln(F.col(y) / F.col(mu))).otherwise(0.0) - (F.col(y) - F.col(mu))
    return df.agg((2 * F.sum(term)).alias("deviance"))


@operator("P16", group="tables")
def whole_batches(df: DataFrame, batch: str, failed: Column, sentinel: Column) -> DataFrame:
    """Rows of batches in which nothing failed, and of batches that hold a sentinel."""
    own = W.partitionBy(batch)
    return df.withColumn("__bad", F.max(failed.cast("int")).over(own)).withColumn("__keep", F.max(sentinel.cast("int")).over(own)).where("__bad = 0 or __keep = 1").drop("__bad", "__keep")


@operator("B17", group="tables")
def output_check(df: DataFrame, columns: list[str], least_rows: int = 1) -> DataFrame:
    """One row for each column: whether it is there, holds enough rows, and more than one value."""
    have = [c for c in columns if c in df.columns]
    got = df.agg(F.count("*").alias("rows"), *[F.countDistinct(c).alias(f"d_{c}") for c in have])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(c in have).alias("present"), (F.col("rows") >= least_rows).alias("enough"), (F.col(f"d_{c}") > 1 if c in have else F.lit(False)).alias("varies")) for c in columns]))
    return got.select(rows.alias("x")).select("x.*")

"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, release, seen


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest among its neighbours and itself."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them. edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node in edges (a, b): the component is its smallest node.

    edges may hold loops, repeats, either direction; nulls link nothing. Each round is written to the shared folder; the
    number of rounds grows with the logarithm of the component size squared at most. Ends when a round changes nothing.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    now, turn = materialize(clean, f"{name}-0", mark=mark), 0
    while seen(now)["rows"]:
        turn += 1
        stars = materialize(_large_star(now), f"{name}-{turn}l")
        after = materialize(_small_star(stars), f"{name}-{turn}s", mark=mark)
        same = (seen(now)["rows"], seen(now)["mark"]) == (seen(after)["rows"], seen(after)["mark"])
        release(stars)
        release(now)
        now = after
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

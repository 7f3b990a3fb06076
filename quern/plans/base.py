"""The decorator for queries, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.workers import ship


class Tables:
    """The tables of a folder by attribute, and the shapes that several queries start from."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def cells(self) -> DataFrame:
        """Orders by parts: the quantity, absent where zero."""
        return self.lineitem.groupBy(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("col_id")).agg(F.sum("l_quantity").alias("value"))

    def obs(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("grp"))

    def panel(self) -> DataFrame:
        """Suppliers by the 50 part sizes: the quantity of all lines, for operators on dense grids."""
        lines = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        return lines.groupBy(F.col("l_suppkey").alias("row_id"), F.col("p_size").cast("long").alias("col_id")).agg(F.sum("l_quantity").alias("value"))

    def panel_obs(self) -> DataFrame:
        """Every supplier with the region of its nation."""
        nation = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        return self.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("row_id"), F.col("r_name").alias("grp"))


#: The same shapes for the SQL of queries, put before it as common tables where it names them.
SQL_SHAPES = {
    "cells": "SELECT l_orderkey AS row_id, l_partkey AS col_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL",
    "obs": "SELECT o_orderkey AS row_id, o_orderpriority AS grp FROM orders",
    "panel": "SELECT l_suppkey AS row_id, CAST(p_size AS BIGINT) AS col_id, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "panel_obs": "SELECT s_suppkey AS row_id, r_name AS grp FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
}


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    ids: tuple[str, ...]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(*ids: str, sql: str | None = None) -> Callable:
    """Register fn(t: Tables) under its name. ids: its numbers in the operator inventory."""

    def put(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        text = sql
        if text is not None:
            names = [n for n in SQL_SHAPES if f"@{n}" in text]
            for n in sorted(names, key=len, reverse=True):
                text = text.replace(f"@{n}", n)
            shapes = ", ".join(f"{n} AS MATERIALIZED ({SQL_SHAPES[n]})" for n in names)
            text = text.strip()
            if names:
                text = f"WITH {shapes}, {text[5:]}" if text[:5].upper() == "WITH " else f"WITH {shapes} {text}"
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(Tables(spark, folder))

        QUERIES[fn.__name__] = Query(fn.__name__, run, ids, text)
        return fn

    return put


def r(c, digits: int = 6):
    """Rounded for comparison across engines; no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)

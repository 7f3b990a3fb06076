"""Writers: tab-separated tables, appends in the target's column order, JSON lines, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.registry import operator


@operator("SNK1", group="sinks")
def write_tsv(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    """Tab-separated with a header; nulls are empty, arrays are joined by ', '. by: one folder for each value."""
    flat = df.select(*[F.concat_ws(", ", F.col(c).cast("array<string>")).alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes])
    out = flat.write.mode(mode).option("header", "true").option("sep", "\t").option("nullValue", "").option("emptyValue", "").option("quote", "")
    (out.partitionBy(*by) if by else out).csv(path)


@operator("SNK2", group="sinks")
def append_rows(df: DataFrame, path: str, columns: list[str], defaults: dict | None = None) -> None:
    """Appended to a parquet table in its column order; columns that df lacks take their default."""
    df.select(*[F.col(c) if c in df.columns else F.lit((defaults or {}).get(c)).alias(c) for c in columns]).write.mode("append").parquet(path)


@operator("SNK3", group="sinks")
def write_columns(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    out = df.write.mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)


@operator("SNK4", group="sinks")
def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


@operator("SNK4", group="sinks")
def markdown(df: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a report's rows, at most so many: for reports, not for data."""
    rows = [["" if v is None else str(v).replace("|", "\\|") for v in r] for r in df.limit(most).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])

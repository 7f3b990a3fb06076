"""Have Python workers find this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once in an application, unless their path leads to it already: by PYTHONPATH, or by the
    working folder of a local session."""
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    sc._quern_shipped = True
    named = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if ROOT in named or sc.master.startswith("local[") and Path.cwd() == ROOT:
        return
    archive = Path(tempfile.mkdtemp(prefix="quern-")) / "quern.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted((ROOT / "quern").rglob("*.py")):
            out.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(archive))

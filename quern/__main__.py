"""python -m quern list [GROUP] | inspect OPERATOR | queries | run QUERY FOLDER [ROWS]"""

from __future__ import annotations

import json
import sys
from importlib import import_module

OPERATORS = ("operators.matrix", "operators.markers", "operators.sets", "operators.tables", "operators.benchmarks", "operators.sequences", "operators.geometry", "operators.models", "operators.fits", "sources.readers", "sources.writers", "streaming.sessions")


def main(args: list[str]) -> int:
    from quern.plans import all_queries
    from quern.registry import REGISTRY

    for name in OPERATORS:
        import_module(f"quern.{name}")
    match args:
        case ["list", *group]:
            for g, names in REGISTRY.groups().items():
                if not group or g in group:
                    print(f"{g}: {', '.join(names)}")
        case ["inspect", name]:
            print(json.dumps(REGISTRY.inspect(name), indent=1))
        case ["queries"]:
            for name, q in all_queries().items():
                print(name, ",".join(q.ids), "" if q.sql else "(no SQL)")
        case ["run", name, folder, *rows]:
            from pyspark.sql import SparkSession

            all_queries()[name].run(SparkSession.builder.getOrCreate(), folder).show(int(rows[0]) if rows else 20, truncate=False)
        case _:
            print(__doc__)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

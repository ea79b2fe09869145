"""Commands: ``python -m scholion COMMAND …``. Exit code 0, or 2 for anything unmet, partial or wrong.

query-check PLAN           diagnostics of a plan; 2 if it can't be used
coverage-plan PLAN N       the plan with N additional records a source, as JSON
queries                    names of the registered queries
run QUERY FOLDER [OUT]     a registered query over a folder of tables; rows as JSON lines, or Parquet under OUT
diagnose FOLDER            states of the records of a folder of tables
"""

from __future__ import annotations

import json
import sys


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("scholion").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _plan(path: str) -> dict:
    with open(path, encoding="utf-8-sig") as file:
        return json.load(file)


def main(arguments: list[str]) -> int:
    from scholion.plans import query_plan

    command, rest = (arguments or [""])[0], arguments[1:]
    try:
        if command == "query-check":
            checks = query_plan.validate(_plan(*rest))["checks"]
            print(json.dumps(checks))
            return 0 if all(c["status"] != "error" for c in checks) else 2
        if command == "coverage-plan":
            print(json.dumps(query_plan.add_coverage(_plan(rest[0]), int(rest[1])), ensure_ascii=False))
            return 0
        from scholion import catalogue

        if command == "queries":
            print("\n".join(sorted(catalogue.QUERIES)))
            return 0
        if command in ("run", "diagnose"):
            name, folder = (rest[0], rest[1]) if command == "run" else ("run_check", rest[0])
            rows = catalogue.QUERIES[name](_session(), folder)
            if command == "run" and len(rest) > 2:
                rows.write.mode("errorifexists").parquet(rest[2])
            else:
                for line in rows.toJSON().toLocalIterator():
                    print(line)
            return 0
    except (query_plan.PlanError, OSError, KeyError, IndexError, TypeError, ValueError) as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 2
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Command line: list the queries, run one, or give the schema of its result.

    python -m quire list
    python -m quire run QUERY FOLDER OUT [--format parquet|json|csv]
    python -m quire schema QUERY FOLDER

Exit codes: 0 done, 1 failed, 3 no such query.
"""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quire", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    for name in ("run", "schema"):
        s = sub.add_parser(name)
        s.add_argument("query"), s.add_argument("folder")
        if name == "run":
            s.add_argument("out"), s.add_argument("--format", default="parquet", choices=["parquet", "json", "csv", "orc"])
    a = p.parse_args(args)
    from quire.plans.queries import queries

    known = queries()
    if a.what == "list":
        print("\n".join(sorted(known)))
        return 0
    if a.query not in known:
        print(f"no query {a.query}", file=sys.stderr)
        return 3
    from pyspark.sql import SparkSession

    from quire.sources.sinks import json_schema

    spark = SparkSession.builder.appName("quire").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        df = known[a.query](spark, a.folder)
        if a.what == "schema":
            print(json_schema(df.schema, a.query))
        else:
            df.write.mode("overwrite").format(a.format).save(a.out)
        return 0
    except Exception as e:  # the command line reports and goes on to its exit code
        print(f"failed: {str(e)[:300]}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

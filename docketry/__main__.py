"""``python -m docketry list`` or ``python -m docketry QUERY TABLES OUT [jsonl|csv|parquet|json]``: run a named query as a job."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .operators import queries as multivalue
from .plans import catalogue
from .sources.files import write


def main(args: list[str]) -> int:
    known = catalogue.queries() | multivalue.queries()
    if args[:1] == ["list"]:
        print(*sorted(known), sep="\n")
        return 0
    if len(args) not in (3, 4) or args[0] not in known:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName(f"docketry {args[0]}").getOrCreate()
    write(known[args[0]](spark, args[1]), args[2], args[3] if len(args) == 4 else "parquet")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

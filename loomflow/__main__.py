"""python -m loomflow [--local] [--counters] [--group-splits] [--split-bytes N] list | explain NAME DATA | run NAME DATA [OUT]

--local runs on this machine's cores; --counters prints the rows of the result; --group-splits cuts the input in
groups of 50 MB to 1 GB for the slots there are, --split-bytes in splits of N bytes.
"""

from __future__ import annotations

import sys

from pyarrow import fs

from loomflow import catalog
from loomflow.metrics import observed
from loomflow.runtime import files_of, session
from loomflow.sources import splits
from loomflow.sources.sinks import write_new


def main(args: list[str]) -> int:
    found, args, given = catalog.queries(), list(args), {}
    for option in ("--local", "--counters", "--group-splits", "--split-bytes"):
        if option in args:
            at = args.index(option)
            given[option] = args[at + 1 : at + 2] if option == "--split-bytes" else True
            del args[at : at + (2 if option == "--split-bytes" else 1)]
    if args[:1] == ["list"]:
        print("\n".join(found))
        return 0
    if len(args) < 3 or args[0] not in ("explain", "run") or args[1] not in found or not all(x is True or (x and x[0].isdigit()) for x in given.values()):
        print(__doc__, file=sys.stderr)
        return 2
    spark = session(f"loomflow-{args[1]}", "local[*]" if "--local" in given else None)
    if "--split-bytes" in given:
        spark.conf.set("spark.sql.files.maxPartitionBytes", given["--split-bytes"][0])
    elif "--group-splits" in given:
        files, at = files_of(spark, args[2])
        splits.configure(spark, sum(f.size for f in files.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file))
    df, seen = found[args[1]](spark, args[2]), None
    if "--counters" in given and args[0] == "run":
        df, seen = observed(df, "result")
    if args[0] == "explain":
        df.explain("formatted")
    elif len(args) > 3:
        write_new(df, args[3])
    elif seen:
        df.write.format("noop").mode("overwrite").save()
    else:
        df.show(50, truncate=False)
    if seen:
        print(f"rows: {seen.get['n_rows']}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Operations by hand: python -m tracewright.admin ROOT scan-once|build-once|recover|verify N|rebuild N [--archives TABLE --files ROOT --profiles TABLE]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.log_index import LogIndex
from .sources.files import Archive


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if something was done, 1 if there was nothing to do."""
    p = argparse.ArgumentParser(prog="tracewright.admin")
    p.add_argument("root")
    p.add_argument("action", choices=["scan-once", "build-once", "recover", "verify", "rebuild"])
    p.add_argument("number", type=int, nargs="?")
    p.add_argument("--archives", help="Parquet table of archives")
    p.add_argument("--files", help="root of the archived files")
    p.add_argument("--profiles", help="Parquet table of parser profiles")
    a = p.parse_args(args)
    needs = {"scan-once": ("archives", "files", "profiles"), "build-once": ("files",), "verify": ("number",), "rebuild": ("number",)}.get(a.action, ())
    if missing := [n for n in needs if getattr(a, n) is None]:
        p.error(f"{a.action} needs {', '.join(missing)}")
    spark = spark or SparkSession.builder.getOrCreate()
    index = LogIndex(spark, a.root)
    if a.action == "scan-once":
        done = index.scan_once(spark.read.parquet(a.archives), Archive(spark, a.files), spark.read.parquet(a.profiles))
        print(done)
        return int(done["batch_id"] is None)
    if a.action == "build-once":
        done = index.build_next(Archive(spark, a.files))
        print(done)
        return int(done is None)
    if a.action == "recover":
        index.recover()
        return 0
    return int(not (index.verify(a.number) if a.action == "verify" else index.rebuild(a.number)))


if __name__ == "__main__":
    raise SystemExit(main())

"""python -m lakeloom.cli VERB ...: run registered queries, and keep table versions."""

from __future__ import annotations

import argparse
import json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakeloom")
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list")
    run = verbs.add_parser("run")
    run.add_argument("query")
    run.add_argument("--data", required=True)
    run.add_argument("--out", required=True)
    for name, more in {"import": ["source", "path"], "compact": ["path", "to"], "mirror": ["path", "to"], "digest": ["path"]}.items():
        v = verbs.add_parser(name)
        for m in more:
            v.add_argument(m)
        v.add_argument("--files", type=int, default=8)
    clean = verbs.add_parser("cleanup")
    clean.add_argument("folder")
    clean.add_argument("--keep", nargs="*", default=[])
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from lakeloom.operators.aggregates import content_digest
    from lakeloom.plans import registry
    from lakeloom.sources import files, sinks

    if a.verb == "list":
        print("\n".join(registry.queries()))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.verb == "run":
        registry.queries()[a.query](spark, a.data).write.mode("errorifexists").parquet(a.out)
    elif a.verb == "import":
        print(json.dumps(sinks.import_jsonl(spark, a.source, a.path, files.RECORD_SCHEMA)))
    elif a.verb == "compact":
        print(json.dumps(sinks.compact(spark, a.path, a.to, a.files)))
    elif a.verb == "mirror":
        print(json.dumps({"written": sinks.mirror(spark, a.path, a.to)}))
    elif a.verb == "digest":
        rows = spark.read.parquet(a.path)
        print(json.dumps([str(x) for x in content_digest(rows, rows.columns).first()]))
    else:
        print(json.dumps({"deleted": sinks.cleanup(spark, a.folder, set(a.keep))}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

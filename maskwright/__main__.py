"""Command line: run, restore, inspect, list-detectors, init-key, version. Errors end with the exit code of their kind."""

from __future__ import annotations

import argparse
import sys

from . import __version__
from .functions import detectors, keys

COMMANDS = ("run", "restore", "inspect", "list-detectors", "init-key", "version")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="maskwright", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="pseudonymise files into a folder")
    run.add_argument("paths", nargs="+")
    run.add_argument("--output", required=True)
    run.add_argument("--denylist")
    run.add_argument("--region", default="DE", choices=sorted(detectors.REGIONS))
    run.add_argument("--format", default="auto")
    run.add_argument("--sequential", action="store_true")
    run.add_argument("--dry-run", action="store_true")
    back = sub.add_parser("restore", help="bring the originals back into a folder that run wrote")
    back.add_argument("folder")
    back.add_argument("--output", required=True)
    look = sub.add_parser("inspect", help="list the mapping of a folder that run wrote, or of a mapping file")
    look.add_argument("mapping")
    new = sub.add_parser("init-key", help="write a new key file")
    new.add_argument("path")
    for s in (run, back, look):
        s.add_argument("--key-file")
    sub.add_parser("list-detectors")
    sub.add_parser("version")
    return p


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv and not argv[0].startswith("-") and argv[0] not in COMMANDS:
        argv = ["run", *argv]  # files alone mean run
    args = parser().parse_args(argv)
    try:
        return _work(args)
    except keys.MaskError as e:
        print(f"maskwright: {e}", file=sys.stderr)
        return e.exit_code


def _work(args: argparse.Namespace) -> int:
    if args.command == "version":
        print(__version__)
        return 0
    if args.command == "list-detectors":
        for d in detectors.build_detectors(["term"]):
            print(f"{d.name}\t{d.entity_type}\t{d.priority}")
        return 0
    if args.command == "init-key":
        print(keys.init_key(args.path))
        return 0

    from pyspark.sql import SparkSession

    from .operators import mapping as M
    from .operators.pseudonymize import restore
    from .sources import files, sidecar

    spark = SparkSession.builder.appName("maskwright").getOrCreate()
    if args.command == "run":
        secret = keys.load_key(args.key_file)
        options = files.RunOptions(args.output, args.dry_run, args.sequential, args.denylist, args.region, args.format)
        result = files.run(spark, args.paths, secret, options)
        for r in files.report(result.documents, "path").orderBy("path").toLocalIterator():
            print(f"{r.path} -> {args.output} ({r.n_replaced} replacements)")
    elif args.command == "restore":
        docs = spark.read.parquet(f"{args.folder}/documents")
        restore(docs, spark.read.parquet(f"{args.folder}/mapping"), order="path").write.parquet(args.output)
    else:
        table = sidecar.load_mapping(spark, args.mapping, keys.load_key(args.key_file)) if args.mapping.endswith(sidecar.SUFFIX) else spark.read.parquet(f"{args.mapping}/mapping")
        for r in M.inspect(table).toLocalIterator():
            print(f"{r.token}\t{r.entity_type}\t{r.original}")
    return 0


if __name__ == "__main__":
    sys.exit(main())

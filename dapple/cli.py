"""``python -m dapple.cli COMMAND``: the commands that need no injected model."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from dapple.operators.gates import GateError
from dapple.plans import pipelines
from dapple.sources import files, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="dapple")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text, *options in (
        ("build", "scan, deduplicate and split into manifests", "config", "out"),
        ("validate", "run the manifest gates", "manifests"),
        ("eda", "print the manifest report", "manifests"),
        ("identify", "rank individuals for probes (Parquet: id, identity, embedding)", "gallery", "probes", "out"),
        ("match", "best gallery photos by constellation (Parquet: id, spots)", "gallery", "probes", "out"),
        ("embed-pack", "list the files of a training pack with their sha256", "folder", "out"),
    ):
        command = sub.add_parser(name, help=text)
        for option in options:
            command.add_argument(option)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("dapple").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "build":
        pipelines.build(spark, files.load_config(args.config), args.out).show(truncate=False)
    elif args.command in ("validate", "eda"):
        target, external = (spark.read.parquet(f"{args.manifests}/{n}") for n in ("target", "external"))
        if args.command == "eda":
            print(pipelines.eda(target, external))
            return 0
        try:
            for name, n in pipelines.validate(target, external):
                print(f"warning: {name}: {n}")
        except GateError as e:
            print(f"failed: {e}", file=sys.stderr)
            return 1
    elif args.command == "identify":
        ranked, verdicts = pipelines.identify(spark.read.parquet(args.probes), spark.read.parquet(args.gallery))
        ranked.join(verdicts.select("pid", "verdict"), "pid").write.mode("overwrite").parquet(args.out)
    elif args.command == "match":
        pipelines.match(spark.read.parquet(args.probes), spark.read.parquet(args.gallery)).write.mode("overwrite").parquet(args.out)
    else:
        sinks.write_manifest(pipelines.embed_pack(spark, args.folder), args.out, ("path",))
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""python -m shardwright.cli ROOT COMMAND ...: ingest-folder, ingest-tar, list, cat, put, delete, rename, vacuum, checkpoint, profile."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import catalog
from .operators.sets import pair_sidecars
from .plans.engine import SHARD_TARGET, Engine
from .sources.files import class_folder
from .sources.tar import read_tars


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shardwright", description=__doc__)
    p.add_argument("root")
    c = p.add_subparsers(dest="command", required=True)
    for name in ("ingest-folder", "ingest-tar"):
        s = c.add_parser(name)
        s.add_argument("source")
        s.add_argument("--target-bytes", type=int, default=SHARD_TARGET)
    c.add_parser("list")
    c.add_parser("profile")
    c.add_parser("checkpoint")
    for name, args in (("cat", ("path",)), ("put", ("path", "file")), ("delete", ("path",)), ("rename", ("path", "target"))):
        s = c.add_parser(name)
        for a in args:
            s.add_argument(a)
    s = c.add_parser("vacuum")
    s.add_argument("--dry-run", action="store_true")
    s.add_argument("--max-shard-size", type=int, default=SHARD_TARGET)
    s.add_argument("--threshold", type=float, default=0.0, help="only from this fragmentation on")
    return p


def folder_samples(spark: SparkSession, source: str):
    from .functions.scalar import canonical_key

    return class_folder(spark, source).select(canonical_key(F.col("path")).alias("path"), F.col("content").alias("payload"), "object_metadata")


def tar_samples(spark: SparkSession, source: str):
    return pair_sidecars(read_tars(spark, source)).select(F.col("name").alias("path"), "payload", "object_metadata")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("shardwright").getOrCreate()
    e = Engine(spark, a.root)
    if a.command == "ingest-folder":
        e.ingest(folder_samples(spark, a.source), target=a.target_bytes)
    elif a.command == "ingest-tar":
        e.ingest(tar_samples(spark, a.source), target=a.target_bytes)
    elif a.command == "list":
        print("\n".join(e.list()))
    elif a.command == "profile":
        print(catalog.profile(*e.state()).first().asDict())
    elif a.command == "checkpoint":
        print(e.checkpoint())
    elif a.command == "cat":
        sys.stdout.buffer.write(e.read(a.path))
    elif a.command == "put":
        with open(a.file, "rb") as f:
            e.put(a.path, f.read())
    elif a.command == "delete":
        e.delete(a.path)
    elif a.command == "rename":
        e.rename(a.path, a.target)
    elif e.fragmentation() >= a.threshold:
        print(e.vacuum(a.max_shard_size, a.dry_run))
    return 0


if __name__ == "__main__":
    sys.exit(main())

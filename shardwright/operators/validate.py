"""Checks of a data set: catalog invariants, payload headers, completeness and disjointness of an epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..functions.scalar import shard_number
from ..sources.tar import tar_header_errors

INLINE = 1 << 20


def catalog_problems(objects: DataFrame, shards: DataFrame, files: DataFrame) -> DataFrame:
    """(subject, problem). files: name, length. A shard needs its file, a size above 0 and no more than the file has; shard -1 may be empty and absent.
    Live objects need a known shard and a range within it."""
    f = files.select(shard_number(F.col("name")).alias("__n"), "length")
    s = shards.where("number <> -1").join(f, F.col("number") == F.col("__n"), "left")
    kinds = F.array_compact(F.array(F.when(F.col("length").isNull(), "no file"), F.when(F.col("total_size") <= 0, "empty"), F.when(F.col("length") < F.col("total_size"), "short file")))
    out = s.select(F.concat(F.lit("shard_"), F.col("number").cast("string")).alias("subject"), F.explode(kinds).alias("problem"))
    live = catalog.live(objects)
    lost = catalog.orphans(live, shards).select(F.col("path").alias("subject"), F.lit("unknown shard").alias("problem"))
    beyond = live.join(shards, F.col("shard_id") == F.col("number")).where((F.col("offset") < 512) | (F.col("offset") + F.col("size") > F.col("total_size"))).select(F.col("path").alias("subject"), F.lit("beyond the shard").alias("problem"))
    return out.unionByName(lost).unionByName(beyond)


def payload_problems(root: str, objects: DataFrame, include_deleted: bool = False) -> DataFrame:
    """(path, error) of objects whose tar header doesn't fit the catalog: 512 bytes are read for each object, in order of shard and offset."""
    own = (objects if include_deleted else catalog.live(objects)).select("path", "shard_id", "offset", "size")
    ordered = own.repartitionByRange("shard_id", "offset").sortWithinPartitions("shard_id", "offset")
    return ordered.mapInArrow(tar_header_errors(root), "path string, error string")


def errors_by_shard(problems: DataFrame, objects: DataFrame) -> DataFrame:
    return problems.join(objects.select("path", "shard_id"), "path").groupBy("shard_id").count()


def partition_problems(plan: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, problem): objects that no reader, or more than one, has. plan: path, rank, worker."""
    got = plan.groupBy("path").agg(F.countDistinct("rank", "worker").alias("readers"), F.count(F.lit(1)).alias("n"))
    both = expected.select("path").distinct().withColumn("__e", F.lit(True)).join(got, "path", "full_outer")
    kinds = F.array_compact(F.array(F.when(F.col("n").isNull(), "missing"), F.when(F.col("__e").isNull(), "leaked"), F.when(F.col("readers") > 1, "shared"), F.when(F.col("n") > F.col("readers"), "repeated")))
    return both.select("path", F.explode(kinds).alias("problem"))


def preflight(settings: dict, required: tuple[str, ...], budget: int | None, shards: DataFrame | None = None) -> list[tuple[str, bool, str]]:
    """(check, passed, detail): settings that are there, bytes within the budget. Addresses are left to the file system that serves them."""
    out = [(f"setting {k}", bool(settings.get(k)), str(settings.get(k, ""))) for k in required]
    if shards is not None:
        total = shards.agg(F.coalesce(F.sum("total_size"), F.lit(0))).first()[0]
        out.append(("bytes", budget is None or total <= budget, str(total)))
    return out

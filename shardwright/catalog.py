"""The catalog: objects and shards as two tables, and the one-row manifest for interchange.

objects: path, shard_id, offset, size, deleted, object_metadata (JSON bytes). shards: number, type ('base' or 'delta'), total_size.
Both stay normalised Parquet inside the engine, so filters and columns reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBJECTS = T.StructType(
    [
        T.StructField("path", T.StringType(), False), T.StructField("shard_id", T.IntegerType(), False), T.StructField("offset", T.LongType(), False),
        T.StructField("size", T.LongType(), False), T.StructField("deleted", T.BooleanType(), False), T.StructField("object_metadata", T.BinaryType(), True),
    ]
)
SHARDS = T.StructType([T.StructField("number", T.IntegerType(), False), T.StructField("type", T.StringType(), False), T.StructField("total_size", T.LongType(), False)])
MANIFEST = T.StructType([T.StructField("version", T.StringType(), False), T.StructField("shards_meta", T.ArrayType(SHARDS, False), False), T.StructField("files", T.ArrayType(OBJECTS, False), False)])
VERSION = "1"


class EmptyManifest(ValueError):
    pass


def read_manifest(spark: SparkSession, path: str, trusted: bool = True) -> tuple[DataFrame, DataFrame]:
    """(objects, shards) of a one-row manifest. Without trust later entries of a path win and only the first row counts."""
    whole = spark.read.schema(MANIFEST).parquet(path).limit(1)
    if whole.isEmpty():
        raise EmptyManifest(path)
    shards = whole.select(F.inline("shards_meta"))
    if trusted:
        return whole.select(F.inline("files")), shards
    placed = whole.select(F.posexplode("files").alias("at", "f"))
    objects = placed.groupBy(F.col("f.path").alias("path")).agg(F.max_by("f", "at").alias("f")).select("f.*")
    return objects, shards


def write_manifest(objects: DataFrame, shards: DataFrame, path: str) -> None:
    """One row, lists in order of number and path; metadata null becomes empty bytes. Written aside, then renamed."""
    spark = objects.sparkSession
    own = objects.select("path", "shard_id", "offset", "size", "deleted", F.coalesce("object_metadata", F.lit(b"")).alias("object_metadata"))
    files = own.agg(F.sort_array(F.collect_list(F.struct(*own.columns))).alias("files"))
    metas = shards.agg(F.sort_array(F.collect_list(F.struct("number", "type", "total_size"))).alias("shards_meta"))
    row = metas.crossJoin(files).select(F.lit(VERSION).alias("version"), "shards_meta", "files")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}.tmp")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop(path), True)
    fs.rename(hadoop(f"{path}.tmp"), hadoop(path))


def metadata(objects: DataFrame) -> DataFrame:
    """objects with `meta`, a variant of its JSON bytes; null for empty or broken ones."""
    return objects.withColumn("meta", F.try_parse_json(F.nullif(F.decode("object_metadata", "UTF-8"), F.lit(""))))


def live(objects: DataFrame) -> DataFrame:
    return objects.where(~F.col("deleted"))


def index(objects: DataFrame, shards: DataFrame) -> DataFrame:
    """Objects with their shard; null shard columns mark orphans. Spark broadcasts shards where their size allows."""
    return objects.join(shards.withColumnRenamed("number", "shard_id"), "shard_id", "left")


def orphans(objects: DataFrame, shards: DataFrame) -> DataFrame:
    return objects.join(shards, F.col("shard_id") == F.col("number"), "left_anti")


def served_shards(objects: DataFrame, shards: DataFrame) -> DataFrame:
    """Shards of a session with n_live and cover_size: base shards, even empty ones, and delta shards with a live object.

    A delta's size is where its last live object ends."""
    per = live(objects).groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_live"), F.max(F.col("offset") + F.col("size")).alias("reach"))
    joined = shards.join(per, F.col("number") == F.col("shard_id"), "left").withColumn("n_live", F.coalesce("n_live", F.lit(0)))
    size = F.when(F.col("type") == "delta", F.coalesce("reach", F.lit(0))).otherwise(F.col("total_size"))
    return joined.where("type <> 'delta' or n_live > 0").select("number", "type", "n_live", size.alias("cover_size"))


def profile(objects: DataFrame, shards: DataFrame) -> DataFrame:
    """One row: live objects, their bytes, mean and largest; all shards, mean and largest."""
    o = live(objects).agg(F.count(F.lit(1)).alias("n_live"), F.coalesce(F.sum("size"), F.lit(0)).alias("live_bytes"), F.avg("size").alias("avg_object"), F.max("size").alias("max_object"))
    s = shards.agg(F.count(F.lit(1)).alias("n_shards"), F.avg("total_size").alias("avg_shard"), F.max("total_size").alias("max_shard"))
    return o.crossJoin(s)


def fragmentation(objects: DataFrame, shards: DataFrame) -> DataFrame:
    """Tombstoned bytes over physical bytes, 0 for none; true_dead counts everything that no live object holds."""
    o = objects.agg(F.coalesce(F.sum(F.when(F.col("deleted"), F.col("size"))), F.lit(0)).alias("dead_bytes"), F.coalesce(F.sum(F.when(~F.col("deleted"), F.expr("512 + size + pmod(-size, 512)"))), F.lit(0)).alias("__live"))
    s = shards.agg(F.coalesce(F.sum("total_size"), F.lit(0)).alias("physical_bytes"))
    both = o.crossJoin(s)
    ratio = F.when(F.col("physical_bytes") > 0, F.col("dead_bytes") / F.col("physical_bytes")).otherwise(F.lit(0.0))
    true = F.when(F.col("physical_bytes") > 0, F.greatest(F.lit(0.0), 1 - F.col("__live") / F.col("physical_bytes"))).otherwise(F.lit(0.0))
    return both.select("dead_bytes", "physical_bytes", ratio.alias("fragmentation"), true.alias("true_dead"))


def base_shard_order(shards: DataFrame) -> DataFrame:
    """Base shards in the order in which they are fetched."""
    return shards.where("number >= 0").orderBy("number")


def inventory(files: DataFrame, suffix: str, size: str) -> DataFrame:
    """Files and bytes by suffix, '<none>' where empty."""
    return files.groupBy(F.coalesce(F.nullif(F.col(suffix), F.lit("")), F.lit("<none>")).alias("suffix")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(size).alias("bytes"))

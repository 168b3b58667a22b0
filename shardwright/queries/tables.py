"""The engine's entities derived from the benchmark tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import record_size
from ..storage import scan

SHARDS = 16


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as objects in 16 shards, records in order of doc_id; toxic ones are deleted. No text leaves the scan but its length."""
    docs = scan(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("size"))
    labels = scan(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    from pyspark.sql import Window

    shard = F.pmod("doc_id", F.lit(SHARDS)).cast("int")
    before = Window.partitionBy("shard_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        docs.join(labels, "doc_id", "left")
        .withColumn("shard_id", shard)
        .withColumn("path", F.concat(F.lit("doc"), F.lpad(F.col("doc_id").cast("string"), 9, "0")))
        .withColumn("offset", F.coalesce(F.sum(record_size(F.col("size"))).over(before), F.lit(0)) + 512)
        .withColumn("deleted", F.coalesce(F.col("toxic") == 1, F.lit(False)))
        .withColumn("object_metadata", F.encode(F.to_json(F.struct(F.col("lang").alias("label"), "source", "quality")), "UTF-8"))
        .select("path", "shard_id", "offset", "size", "deleted", "object_metadata", "doc_id", "lang", "source")
    )


def shards(objs: DataFrame) -> DataFrame:
    return objs.groupBy(F.col("shard_id").alias("number")).agg(F.max(F.col("offset") + F.expr("size + pmod(-size, 512)")).alias("total_size")).select("number", F.when(F.col("number") % 4 == 3, "delta").otherwise("base").alias("type"), "total_size")


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an ordered log: puts, deletes, renames, no-ops."""
    e = scan(spark, sf_dir, "events")
    op = F.when(F.col("event_type").isin("click", "purchase"), "put").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "rename").otherwise("noop")
    user = lambda c: F.concat(F.lit("u"), c.cast("string"))
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), user(F.col("user_id")).alias("path"), F.when(op == "rename", user(F.col("user_id") + 1)).alias("target"), F.floor(F.col("value") * 100).cast("bigint").alias("size")).where("op <> 'noop'")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as time series: series, t in seconds, value, counter (running sum)."""
    from pyspark.sql import Window

    e = scan(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first = e.agg(F.min(micros).alias("__t0"))
    out = e.withColumn("__m", micros).crossJoin(F.broadcast(first)).select("event_id", F.col("event_type").alias("series"), ((F.col("__m") - F.col("__t0")) / 1e6).alias("t"), F.round("value", 2).alias("value"))
    w = Window.partitionBy("series").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("counter", F.sum(F.round(F.col("value") * 100).cast("bigint")).over(w))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("loader"), F.when(F.col("l_linestatus") == "F", "True").otherwise("False").alias("warmup"), F.col("l_linenumber").alias("seed"),
        F.col("l_quantity").alias("throughput"), F.when(F.col("l_quantity") % 2 == 0, F.col("l_quantity") + 1).alias("steady"), F.col("l_discount").alias("wait"), F.col("l_tax").alias("fb"), (F.col("l_discount") / 2).alias("opt"),
        F.col("l_extendedprice").alias("price"), F.col("l_orderkey").alias("run"),
    )


OBJECTS_SQL = f"""
objects AS (
  SELECT 'doc' || lpad(d.doc_id::VARCHAR, 9, '0') AS path, d.doc_id, lang, source, (d.doc_id % {SHARDS})::INT AS shard_id, strlen(text) AS size, coalesce(toxic = 1, false) AS deleted, quality,
         (coalesce(sum(512 + strlen(text) + (512 - strlen(text) % 512) % 512) OVER (PARTITION BY d.doc_id % {SHARDS} ORDER BY d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 512)::BIGINT AS "offset"
  FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)
), shards AS (
  SELECT shard_id AS number, CASE WHEN shard_id % 4 = 3 THEN 'delta' ELSE 'base' END AS type, max("offset" + size + (512 - size % 512) % 512)::BIGINT AS total_size FROM objects GROUP BY shard_id
)"""
MUTATIONS_SQL = """
mutations AS (
  SELECT event_id AS seq, CASE WHEN event_type IN ('click', 'purchase') THEN 'put' WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'signup' THEN 'rename' ELSE 'noop' END AS op,
         'u' || user_id AS path, CASE WHEN event_type = 'signup' THEN 'u' || (user_id + 1) END AS target, floor(value * 100)::BIGINT AS size
  FROM events WHERE event_type <> 'view'
)"""
SERIES_SQL = """
series AS (
  SELECT event_id, event_type AS series, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 AS t, round(value, 2) AS value,
         sum(round(round(value, 2) * 100)::BIGINT) OVER (PARTITION BY event_type ORDER BY event_id)::BIGINT AS counter FROM events
)"""
RUNS_SQL = """
runs AS (
  SELECT l_returnflag AS loader, CASE WHEN l_linestatus = 'F' THEN 'True' ELSE 'False' END AS warmup, l_linenumber AS seed, l_quantity AS throughput,
         CASE WHEN l_quantity % 2 = 0 THEN l_quantity + 1 END AS steady, l_discount AS wait, l_tax AS fb, l_discount / 2 AS opt, l_extendedprice AS price, l_orderkey AS run FROM lineitem
)"""

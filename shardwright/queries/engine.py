"""Queries of log, loading, source, payload and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..functions import payload as P
from ..operators import packing
from ..plans import loader
from ..sources import files, sinks, tar
from ..storage import scan, scratch_path
from ..streaming import log
from . import tables as T

QUERIES, ORACLES = {}, {}
MU = f"WITH {T.MUTATIONS_SQL}"
O = f"WITH {T.OBJECTS_SQL}"  # noqa: E741


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# the log in order, one state of all paths after each operation
EVENTS_SQL = f"""WITH RECURSIVE {T.MUTATIONS_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn FROM mutations),
st AS (
  SELECT 0::BIGINT AS rn, MAP([]::VARCHAR[], []::BIGINT[]) AS m
  UNION ALL
  SELECT o.rn, CASE WHEN op = 'put' THEN map_concat(m, MAP([path], [size::BIGINT])) WHEN op = 'delete' THEN map_concat(m, MAP([path], [-1::BIGINT])) WHEN coalesce(m[path], -1) >= 0 THEN map_concat(m, MAP([path, target], [-1::BIGINT, m[path]])) ELSE m END
  FROM st JOIN o ON o.rn = st.rn + 1
), ev AS (
  SELECT seq, path, op = 'put' AS live, CASE WHEN op = 'put' THEN size END AS size FROM o WHERE op <> 'rename'
  UNION ALL
  SELECT seq, u.p, u.v >= 0, nullif(u.v, -1) FROM (SELECT seq, unnest([{{'p': path, 'v': -1::BIGINT}}, {{'p': target, 'v': m[path]}}]) AS u FROM o JOIN st ON st.rn = o.rn - 1 WHERE op = 'rename' AND coalesce(m[path], -1) >= 0)
)"""


@query(f"{EVENTS_SQL} SELECT seq, path, live, coalesce(size, -1) AS size FROM ev")
def rename_replay(spark, sf_dir):
    return log.rename_records(T.mutations(spark, sf_dir)).select("seq", "path", "live", F.coalesce("size", F.lit(-1)).alias("size"))


@query(f"""{EVENTS_SQL} SELECT path, size FROM (SELECT path, arg_max(live, (seq, live)) AS live, arg_max(coalesce(size, -1), (seq, live)) AS size FROM ev WHERE seq <= 5000 GROUP BY path) WHERE live""")
def snapshot_as_of(spark, sf_dir):
    return log.snapshot_as_of(log.rename_records(T.mutations(spark, sf_dir)), 5000)


def _records(spark, sf_dir):
    m = T.mutations(spark, sf_dir).where("op <> 'rename'")
    add = F.when(F.col("op") == "put", F.struct(F.col("path"), F.lit(-1).alias("shard_id"), (F.col("seq") * 1024 + 512).alias("offset"), F.col("size"), F.lit(False).alias("deleted"), F.lit(None).cast("binary").alias("object_metadata")))
    return m.select("seq", F.lit("t").alias("txn_id"), F.lit(0).cast("long").alias("ts"), F.when(F.col("op") == "put", "add").otherwise("delete").alias("op"), add.alias("add"), F.when(F.col("op") == "delete", F.col("path")).alias("delete"), F.lit(None).cast(log.SHARD).alias("shard"))


@query(f"""{MU}, l AS (SELECT path, arg_max(op, seq) AS op, arg_max(size, seq) AS size, max(seq) AS seq FROM mutations WHERE op <> 'rename' GROUP BY path)
SELECT path, size, seq * 1024 + 512 AS "offset" FROM l WHERE op = 'put'""")
def log_replay(spark, sf_dir):
    none = spark.createDataFrame([], catalog.OBJECTS), spark.createDataFrame([], catalog.SHARDS)
    return catalog.live(log.replay(*none, _records(spark, sf_dir))[0]).select("path", "size", "offset")


@query(f"""{MU}, e AS (SELECT seq, path, op = 'put' AS live, coalesce(lag(op = 'put') OVER (PARTITION BY path ORDER BY seq), false) AS was FROM mutations WHERE op <> 'rename')
SELECT seq, sum(CASE WHEN live OR was THEN 1 ELSE 0 END) OVER (ORDER BY seq)::BIGINT AS generation FROM e""")
def log_generations(spark, sf_dir):
    return log.generations(_records(spark, sf_dir), spark.createDataFrame([], catalog.OBJECTS))


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS bytes FROM events GROUP BY 1, 2""")
def log_windowed_rates(spark, sf_dir):
    e = scan(spark, sf_dir, "events").select("ts", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("size"))
    return log.windowed_rates(e, "ts", "event_type", "size", width="1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "bytes")


@query(f"""{MU} SELECT path, max(seq) AS seq, arg_max(op, seq) = 'put' AS live, CASE WHEN arg_max(op, seq) = 'put' THEN arg_max(coalesce(size, -1), seq) END AS size FROM mutations WHERE op <> 'rename' GROUP BY path""")
def log_stream_fold(spark, sf_dir):
    """The log as a stream of commit files; the last event of each path."""
    path, out = scratch_path(spark, "log-stream"), scratch_path(spark, "log-state")
    _records(spark, sf_dir).repartition(8).write.json(path)

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(out)

    stream = log.live_paths_stream(log.read_log_stream(spark, path))
    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch_path(spark, "log-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query(f"""{O}, r AS (SELECT shard_id, (dense_rank() OVER (ORDER BY shard_id) - 1) % 8 AS reader FROM (SELECT DISTINCT shard_id FROM objects))
SELECT path, (reader // 2)::BIGINT AS rank, (reader % 2)::BIGINT AS worker FROM objects JOIN r USING (shard_id) WHERE NOT deleted""")
def epoch_plan(spark, sf_dir):
    o = T.objects(spark, sf_dir)
    plan = loader.epoch_plan(o, T.shards(o), loader.LoaderSpec(workers=2, world=4, seed=3), all_ranks=True)
    return plan.select("path", F.col("rank").cast("long").alias("rank"), F.col("worker").cast("long").alias("worker"))


def _packed_shards(spark, sf_dir):
    """documents written as tar shards; (root, path of the catalog table, objects)."""
    root = scratch_path(spark, "shards")
    docs = scan(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.encode("text", "UTF-8").alias("payload"))
    placed = packing.pack_ranges(docs.select("path", F.octet_length("payload").cast("long").alias("size")), ["path"], "path", "size", "vacuum", 1 << 20).withColumn("shard_id", F.col("shard").cast("int"))
    sinks.write_shards(docs.join(placed, "path"), f"{root}/data")
    tar.write_catalog(placed.select("path", "shard_id", "offset", "size", F.lit(False).alias("deleted"), F.lit(None).cast("binary").alias("object_metadata")), f"{root}/objects")
    return f"{root}/data", f"{root}/objects"


@query("SELECT 'doc' || lpad(doc_id::VARCHAR, 9, '0') AS path, strlen(text) AS size, sha1(text) AS digest FROM documents")
def payload_scan_tar(spark, sf_dir):
    root, objects = _packed_shards(spark, sf_dir)
    return tar.read_shards(spark, root, objects).select("path", "size", F.sha1("payload").alias("digest"))


@query("SELECT lang AS label, sha1(text) AS digest FROM documents WHERE lang IS NOT NULL")
def record_file_round_trip(spark, sf_dir):
    path = scratch_path(spark, "records")
    sinks.write_record_files(scan(spark, sf_dir, "documents").where("lang is not null").select(F.encode("text", "UTF-8").alias("payload"), F.col("lang").alias("label")), path)
    return files.record_files(spark, path).select("label", F.sha1("image").alias("digest"))


@query("SELECT lpad(page_id::VARCHAR, 8, '0') || '.html' AS name, sha1(html) AS digest FROM pages UNION ALL SELECT lpad(page_id::VARCHAR, 8, '0') || '.cls', sha1((page_id % 7)::VARCHAR) FROM pages")
def webdataset_round_trip(spark, sf_dir):
    path = scratch_path(spark, "webdataset")
    pages = scan(spark, sf_dir, "pages").select(F.pmod("page_id", F.lit(5)).alias("shard"), F.col("page_id").alias("ordinal"), F.lit(".html").alias("ext"), F.encode("html", "UTF-8").alias("payload"), F.pmod("page_id", F.lit(7)).alias("label"))
    sinks.write_webdataset(pages, path)
    return tar.read_tars(spark, path).select("name", F.sha1("payload").alias("digest"))


@query("""WITH b AS (SELECT doc_id, unnest(string_split(rtrim(regexp_replace(hex(encode(text)[1:8192]), '(..)', '\\1 ', 'g')), ' ')) AS x FROM documents), c AS (SELECT doc_id, x, count(*) AS n FROM b WHERE x <> '' GROUP BY ALL),
d AS (SELECT doc_id, n, ('0x' || x)::INT AS v FROM c)
SELECT doc_id, (CASE WHEN v BETWEEN 65 AND 90 THEN v + 32 ELSE v END % 128)::INT AS bin, sum(n)::BIGINT AS bytes FROM d GROUP BY ALL""")
def byte_histogram(spark, sf_dir):
    """The first 8192 bytes in 128 bins, as bytes: a share times the bytes that it is of."""
    raw = F.encode("text", "UTF-8")
    h = scan(spark, sf_dir, "documents").select("doc_id", F.least(F.octet_length(raw), F.lit(8192)).alias("n"), P.byte_shares_udf(8192, 128, lower=True)(raw).alias("h"))
    return h.select("doc_id", "n", F.posexplode("h").alias("bin", "share")).where("share > 0").select("doc_id", "bin", F.round(F.col("share") * F.col("n")).cast("long").alias("bytes"))


@query()
def text_byte_shares(spark, sf_dir):
    return scan(spark, sf_dir, "documents").select("doc_id", P.text_bytes_udf(F.encode("text", "UTF-8")).alias("features"))


@query()
def audio_features(spark, sf_dir):
    """Tones made from embeddings, decoded to 33 features."""

    write = P.write_wave

    def tones(batches):
        import numpy as np
        import pyarrow as pa

        for batch in tar.pieces(batches, 256):
            out = [write(np.repeat(np.array(e, np.float32) * 0.2, 25), 16_000) for e in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "payload"])

    waves = scan(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(tones, "vec_id long, payload binary")
    return waves.select("vec_id", P.audio_features_udf("payload").alias("features"), F.size(P.log_mel_udf("payload")).alias("n_mel"))


@query("SELECT id, id % 256 AS slot, ((id % 256) % 10)::INT AS label FROM range(0, 1000) t(id)")
def synthetic_source(spark, sf_dir):
    return files.synthetic(spark, 1000, 64).select("id", "slot", "label")


@query(f"""{O}, p AS (SELECT number, total_size, sum(total_size) OVER (ORDER BY number) AS cum FROM shards) SELECT path, o.shard_id FROM objects o JOIN p ON number = o.shard_id WHERE NOT deleted AND (cum <= 500000 OR number = 0)""")
def subset_staging(spark, sf_dir):
    o = T.objects(spark, sf_dir)
    return sinks.subset(o, T.shards(o), 500_000)[0].select("path", "shard_id")


@query(f"""{O} SELECT number, type, total_size, path, size, deleted FROM objects JOIN shards ON shard_id = number""")
def manifest_round_trip(spark, sf_dir):
    o = T.objects(spark, sf_dir)
    path = scratch_path(spark, "manifest")
    catalog.write_manifest(o, T.shards(o), path)
    objects, shards = catalog.read_manifest(spark, path)
    return objects.join(shards, F.col("shard_id") == F.col("number")).select("number", "type", "total_size", "path", "size", "deleted")



"""Queries of path and payload functions, sources and writers, the engine as a whole, checks with planted faults, workloads and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..functions import payload as P
from ..functions import scalar as X
from ..operators import metrics as M
from ..operators import ordered, packing, report, sets, validate, workload
from ..plans import loader
from ..plans.engine import Delete, Engine, Put, Rename
from ..sources import binary_log, files, sinks, tar
from ..storage import scan, scratch_path
from ..streaming import log
from . import tables as T
from .engine import _packed_shards, _records

QUERIES, ORACLES = {}, {}
O, MU, RU = (f"WITH {x}" for x in (T.OBJECTS_SQL, T.MUTATIONS_SQL, T.RUNS_SQL))  # noqa: E741
PAD = "(512 + {0} + (512 - {0} % 512) % 512)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def pick(column, *values):
    """values[column modulo their number]."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(column, F.lit(len(values))) + 1).cast("int"))


# functions


@query("SELECT p_partkey, p_partkey % 10 IN (0, 3, 5, 6, 8) AS good FROM part")
def path_validation(spark, sf_dir):
    path = pick(F.col("p_partkey"), "a/b", "/abs", "../x", "a/../b", "a/../../b", "./a", "a//b", "", "a.b/..c", "..")
    return scan(spark, sf_dir, "part").select("p_partkey", X.valid_logical_path(path).alias("good"))


@query("SELECT page_id, url LIKE 'http://%' OR url LIKE 'https://%' AS remote, sha256(url) || '.tar' AS cache FROM pages")
def url_functions(spark, sf_dir):
    return scan(spark, sf_dir, "pages").select("page_id", X.is_remote(F.col("url")).alias("remote"), X.cache_key(F.col("url")).alias("cache"))


@query("""WITH n AS (SELECT p_partkey, p_size::BIGINT * (1::BIGINT << (p_partkey % 5 * 10)::INT) * 2 AS n FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN n || ' B' ELSE format('{:.2f} ', p_size * 2.0) || ['KiB', 'MiB', 'GiB', 'TiB'][(p_partkey % 5)::INT] END AS shown, p_size::BIGINT * 536870912 AS bytes,
round(pow(10.0, (p_size - 25) / 20), 9) AS gain, p_size - 5 >= 0 AND p_size + 5 <= 50 AS inside FROM n JOIN part USING (p_partkey)""")
def unit_functions(spark, sf_dir):
    size = F.col("p_size").cast("long")
    n = size * F.element_at(F.array(*[F.lit(1 << 10 * k) for k in range(5)]), (F.col("p_partkey") % 5 + 1).cast("int")) * 2
    return scan(spark, sf_dir, "part").select("p_partkey", X.human_bytes(n).alias("shown"), X.gigabytes(size / 2).alias("bytes"), F.round(X.decibel_gain((size - 25).cast("double")), 9).alias("gain"), X.within(size - 5, F.lit(10), F.lit(50)).alias("inside"))


@query("SELECT p_partkey, ['png', 'jpg', 'webp', 'gif', 'jpg'][(p_partkey % 5 + 1)::INT] AS kind, p_partkey % 5 = 1 AS jpeg FROM part")
def payload_kinds(spark, sf_dir):
    raw = F.unhex(pick(F.col("p_partkey"), "89504E470D0A1A0A0000", "FFD8FFE000104A464946", "524946460000000057454250", "474946383961", "00010203"))
    return scan(spark, sf_dir, "part").select("p_partkey", X.image_kind(raw).alias("kind"), F.coalesce(X.is_jpeg(raw), F.lit(False)).alias("jpeg"))


@query("SELECT p_partkey, lpad(p_partkey::VARCHAR, 8, '0') || '__' || p_brand || '__' || p_name AS flat, p_brand AS label, 'shard_' || p_partkey AS shard, p_partkey::INT AS number FROM part")
def flat_names(spark, sf_dir):
    flat, shard = X.flat_name(F.col("p_partkey"), F.col("p_brand"), F.col("p_name")), X.shard_name(F.col("p_partkey"))
    return scan(spark, sf_dir, "part").select("p_partkey", flat.alias("flat"), X.flat_label(flat).alias("label"), shard.alias("shard"), X.shard_number(shard).alias("number"))


@query(r"SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 2 = 0 THEN role ELSE '' END || chr(10) || text, '^\s+|\s+$', '', 'g') AS body FROM conversations")
def title_and_body(spark, sf_dir):
    return scan(spark, sf_dir, "conversations").select("conv_id", "turn", X.title_and_body(F.when(F.col("turn") % 2 == 0, F.col("role")), F.col("text")).alias("body"))


@query("""WITH h AS (SELECT p_partkey, 'MUT-' || lpad(p_partkey::VARCHAR, 8, '0') || '|' AS head, 64 + p_size AS n FROM part)
SELECT p_partkey, sha1(unhex(hex(head) || repeat(lpad(hex(p_partkey % 251), 2, '0'), greatest(0, n - 13)))) AS digest, n AS size FROM h""")
def replacement_payloads(spark, sf_dir):
    p = X.replacement_payload(F.col("p_partkey"), F.col("p_size") + 64)
    return scan(spark, sf_dir, "part").select("p_partkey", F.sha1(p).alias("digest"), F.octet_length(p).alias("size"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN (length(source) % 4)::VARCHAR ELSE (length(text) % 4)::VARCHAR END AS label, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN source ELSE 'run' END || CASE WHEN doc_id % 2 = 0 THEN '/tar' ELSE '' END AS series FROM documents")
def label_rules(spark, sf_dir):
    third = lambda k, c: F.when(F.col("doc_id") % 3 == k, F.col(c))
    label = X.steady_label(F.col("text"), third(0, "lang"), third(1, "source"), F.lit("p"))
    series = X.row_label(F.coalesce(third(0, "lang"), F.lit("")), third(1, "source"), format=F.when(F.col("doc_id") % 2 == 0, "tar"))
    return scan(spark, sf_dir, "documents").select("doc_id", label.alias("label"), series.alias("series"))


@query("SELECT vec_id, CASE vec_id % 2 WHEN 0 THEN round(embedding[1]::DOUBLE, 6) ELSE 4 END AS first, 8 AS n FROM embeddings")
def fusion_vectors(spark, sf_dir):
    tab = F.when(F.col("vec_id") % 2 == 0, F.transform("embedding", lambda x: x.cast("double")))
    v = P.fusion_vector(tab, F.lit(None).cast("array<array<double>>"), F.lit("four"), F.lit("p"))
    return scan(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(v, F.lit(0)), 6).alias("first"), F.size(v).alias("n"))


@query("""SELECT loader, count(*) AS rows FROM (SELECT l_returnflag AS loader, l_linenumber AS n, l_orderkey AS k FROM lineitem) WHERE n % 3 <> 1 AND k % 4 = 0 GROUP BY loader""")
def status_filters(spark, sf_dir):
    rows = scan(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("loader"), pick(F.col("l_linenumber"), "ok", "error", "").alias("status"), (F.col("l_orderkey") % 4).cast("string").alias("epoch"))
    return M.cold_start(M.only_ok(rows)).groupBy("loader").agg(F.count(F.lit(1)).alias("rows"))


# sources and writers


@query("SELECT 'c' || page_id % 5 AS label, page_id || '.html' AS name, sha1(html) AS digest FROM pages WHERE page_id % 5 <> 4")
def class_folder_round_trip(spark, sf_dir):
    path = scratch_path(spark, "classes")
    pages = scan(spark, sf_dir, "pages").select(F.concat(F.lit("c"), F.pmod("page_id", F.lit(5)).cast("string")).alias("label"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("payload"))
    sinks.write_class_files(pages, path)
    got = files.class_folder(spark, path, classes=("c0", "c1", "c2", "c3"), suffixes=(".html",))
    return got.select("label", X.base_name(F.col("path")).alias("name"), F.sha1("content").alias("digest"))


@query("SELECT event_id, event_type, value FROM events WHERE event_type <> ''")
def json_lines_source(spark, sf_dir):
    path = scratch_path(spark, "lines")
    scan(spark, sf_dir, "events").select("event_id", "event_type", "value").write.json(path)
    return files.json_lines(spark, path, "event_id long, event_type string, value double", "event_type")


@query("SELECT event_id::VARCHAR AS event_id, event_type, user_id::VARCHAR AS user_id FROM events")
def metric_csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    sinks.write_csv(scan(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), path)
    return files.metric_csv(spark, path)


@query("SELECT doc_id, source AS path, lang AS label, sha1(text) AS digest FROM documents")
def parquet_text_round_trip(spark, sf_dir):
    path = scratch_path(spark, "text")
    d = scan(spark, sf_dir, "documents")
    sinks.write_text(d.select(F.concat_ws(":", "doc_id", "source").alias("path"), "text", F.col("lang").alias("label")), path)
    return spark.read.parquet(path).select(F.split_part("path", F.lit(":"), F.lit(1)).cast("long").alias("doc_id"), F.split_part("path", F.lit(":"), F.lit(2)).alias("path"), "label", F.sha1(F.encode("text", "UTF-8")).alias("digest"))


@query("SELECT url AS path, sha1(html) AS digest, 'jpg' AS kind FROM pages")
def parquet_image_source(spark, sf_dir):
    path = scratch_path(spark, "images")
    scan(spark, sf_dir, "pages").select(F.struct(F.encode("html", "UTF-8").alias("bytes"), F.col("url").alias("path")).alias("image")).write.parquet(path)
    return files.parquet_images(spark, path).select("path", F.sha1("payload").alias("digest"), "kind")


@query(r"""WITH t AS (SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 2 = 0 THEN role ELSE '' END || chr(10) || CASE WHEN turn % 3 = 0 THEN '' ELSE text END, '^\s+|\s+$', '', 'g') AS body, role FROM conversations)
SELECT role AS label, sha1(body) AS digest, length(body) AS text_len FROM t WHERE body <> ''""")
def labelled_text_source(spark, sf_dir):
    rows = scan(spark, sf_dir, "conversations").select(F.when(F.col("turn") % 2 == 0, F.col("role")).alias("title"), F.when(F.col("turn") % 3 != 0, F.col("text")).alias("body"), "role")
    got = files.labelled_text(rows, "title", "body", "role", "talk")
    return got.select("label", F.sha1("payload").alias("digest"), F.get_json_object(F.decode("object_metadata", "UTF-8"), "$.text_len").cast("long").alias("text_len"))


@query("SELECT role AS label, conv_id::VARCHAR AS speaker, count(*) AS n FROM conversations WHERE text <> '' AND turn % 2 = 0 GROUP BY ALL")
def speech_source(spark, sf_dir):
    rows = scan(spark, sf_dir, "conversations").select(F.when(F.col("turn") % 2 == 0, F.encode("text", "UTF-8")).alias("payload"), F.col("role").alias("label"), F.col("conv_id").cast("string").alias("speaker"), "text")
    meta = F.decode("object_metadata", "UTF-8")
    return files.speech(rows).select(F.get_json_object(meta, "$.label").alias("label"), F.get_json_object(meta, "$.speaker").alias("speaker")).groupBy("label", "speaker").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, (props->>'$.k')::DOUBLE AS k, user_id AS count FROM events WHERE event_id % 3 = 0")
def metric_json_source(spark, sf_dir):
    raw = F.to_json(F.struct(F.map_from_arrays(F.array(F.lit("users")), F.array("user_id")).alias("counters"), F.map_from_arrays(F.array(F.lit("k")), F.array(F.get_json_object("props", "$.k").cast("double"))).alias("gauges")))
    rows = scan(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, raw).otherwise("{broken").alias("raw"))
    return files.metric_json(rows, "raw").where("counters is not null").select("event_id", F.col("gauges")["k"].alias("k"), F.col("counters")["users"].alias("count"))


@query("SELECT 'page' || page_id AS path, sha1(html) AS digest FROM pages WHERE page_id % 4 <> 0 UNION ALL SELECT 'page' || page_id, sha1('none') FROM pages WHERE page_id % 4 = 0 AND page_id % 8 <> 0")
def archive_sidecars(spark, sf_dir):
    """Members of archives with the JSON beside them, whatever their order: a page of its own, or what its sidecar says."""
    own = scan(spark, sf_dir, "pages").withColumn("stem", F.concat(F.lit("page"), F.col("page_id").cast("string")))
    members = own.select(F.lit("a.tar").alias("tar"), F.col("stem").alias("name"), "stem", F.lit(".html").alias("ext"), F.col("page_id").alias("offset"), F.lit(0).alias("size"), F.encode("html", "UTF-8").alias("payload"))
    side = own.where("page_id % 4 = 0").select(F.lit("a.tar").alias("tar"), F.concat("stem", F.lit(".json")).alias("name"), "stem", F.lit(".json").alias("ext"), (-F.col("page_id")).alias("offset"), F.lit(0).alias("size"), F.when(F.col("page_id") % 8 == 0, F.encode(F.lit("{}"), "UTF-8")).otherwise(F.encode(F.lit('{"annotations":"none"}'), "UTF-8")).alias("payload"))
    got = sets.pair_sidecars(members.unionByName(side))
    return got.where(F.col("object_metadata").isNotNull() | (F.col("offset") % 4 != 0)).select(F.col("stem").alias("path"), F.sha1(F.coalesce("object_metadata", "payload")).alias("digest"))


@query("SELECT page_id // 10 AS shard, page_id::VARCHAR AS name, sha1(CASE WHEN page_id % 50 = 7 THEN 'new' || page_id ELSE html END) AS digest FROM pages WHERE (page_id // 10) % 5 = 0")
def shard_replacements(spark, sf_dir):
    pages = scan(spark, sf_dir, "pages")
    members = pages.select(F.floor(F.col("page_id") / 10).alias("shard"), F.col("page_id").cast("string").alias("name"), F.encode("html", "UTF-8").alias("payload"))
    new = pages.where("page_id % 50 = 7").select(F.col("page_id").cast("string").alias("name"), F.encode(F.concat(F.lit("new"), F.col("page_id").cast("string")), "UTF-8").alias("payload"))
    return sets.replace_in_shards(members, new).select("shard", "name", F.sha1("payload").alias("digest"))


@query(f"""WITH RECURSIVE o AS (SELECT page_id, strlen(html) AS n, row_number() OVER (ORDER BY page_id) AS rn FROM pages),
f AS (SELECT rn, page_id, n, 0::BIGINT AS shard, n::BIGINT AS paid FROM o WHERE rn = 1 UNION ALL
  SELECT o.rn, o.page_id, o.n, f.shard + (CASE WHEN f.paid + o.n > 100000 THEN 1 ELSE 0 END), CASE WHEN f.paid + o.n > 100000 THEN 0 ELSE f.paid END + o.n FROM f JOIN o ON o.rn = f.rn + 1)
SELECT lpad((rn - 1)::VARCHAR, 8, '0') || '.html' AS name, shard FROM f""")
def webdataset_roll(spark, sf_dir):
    """Archives that end before their payloads pass the target, and the index of names."""
    path = scratch_path(spark, "web")
    pages = scan(spark, sf_dir, "pages").select("page_id", F.lit(".html").alias("ext"), F.encode("html", "UTF-8").alias("payload"), F.pmod("page_id", F.lit(7)).alias("label"))
    written = sinks.write_webdataset(sinks.webdataset_shards(pages, ["page_id"], 100_000), path)
    sinks.webdataset_index(written, f"{path}-index")
    return spark.read.option("header", True).csv(f"{path}-index").select("name", F.col("shard").cast("long").alias("shard"))


@query("WITH c AS (SELECT s_name AS name, 1000 + s_suppkey % 7 AS length, sum(1000 + s_suppkey % 7) OVER (ORDER BY s_name) AS cum FROM supplier) SELECT name, length FROM c WHERE cum <= 20000")
def web_staging(spark, sf_dir):
    return sinks.web_staging(scan(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") % 7 + 1000).alias("length")), 20_000)


@query("SELECT lang AS label, count(*) AS n, true AS whole FROM documents GROUP BY 1")
def record_file_index(spark, sf_dir):
    """The index of record files names each record's place: together they fill the files."""
    path = scratch_path(spark, "indexed")
    docs = scan(spark, sf_dir, "documents").select(F.encode("text", "UTF-8").alias("payload"), F.col("lang").alias("label"))
    sinks.write_record_files(docs, path, index=True)
    lines = spark.read.text(f"{path}_index").select(F.split("value", " ").alias("v"))
    size = files.listing(spark, path).agg(F.sum("length").alias("size"))
    whole = lines.agg(F.sum(F.col("v")[1].cast("long")).alias("s")).crossJoin(size).select((F.col("s") == F.col("size")).alias("whole"))
    return files.record_files(spark, path).groupBy("label").agg(F.count(F.lit(1)).alias("n")).crossJoin(whole)


@query(f"""{MU} SELECT CASE WHEN op = 'put' THEN 'add' ELSE 'delete' END AS op, path, CASE WHEN op = 'put' THEN -1 END AS shard_id, CASE WHEN op = 'put' THEN seq * 1024 END AS "offset", CASE WHEN op = 'put' THEN size END AS size FROM mutations WHERE op <> 'rename'""")
def binary_log_round_trip(spark, sf_dir):
    path = scratch_path(spark, "wal")
    put = F.col("op") == "put"
    m = T.mutations(spark, sf_dir).where("op <> 'rename'")
    binary_log.write_binary_log(m.select("seq", F.when(put, "add").otherwise("delete").alias("op"), "path", F.when(put, -1).alias("shard_id"), F.when(put, F.col("seq") * 1024).alias("offset"), F.when(put, F.col("size")).alias("size"), F.lit(None).cast("binary").alias("meta")), path)
    return binary_log.read_binary_log(spark, path).select("op", "path", "shard_id", "offset", "size")


# the engine as a whole


def _page_engine(spark, sf_dir):
    """Pages loaded in two parts, then changed in one transaction: page 1 deleted, 2 -> x -> y, 3 replaced, z new."""
    pages = scan(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), F.encode("html", "UTF-8").alias("payload"), F.encode(F.to_json(F.struct("url")), "UTF-8").alias("object_metadata"))
    e = Engine(spark, scratch_path(spark, "engine"))
    e.ingest(pages.where("page_id % 2 = 0").drop("page_id"), target=1 << 20)
    e.ingest(pages.where("page_id % 2 = 1").drop("page_id"), target=1 << 20)
    e.apply([Delete("p1"), Rename("p2", "x"), Rename("x", "y"), Put("p3", b"new three"), Put("z", b"zz")])
    return e


PAGES_SQL = """p AS (SELECT 'p' || page_id AS path, sha1(html) AS digest, strlen(html) AS size FROM pages),
now AS (SELECT CASE WHEN path = 'p2' THEN 'y' ELSE path END AS path, digest, size FROM p WHERE path NOT IN ('p1', 'p3') UNION ALL SELECT 'p3', sha1('new three'), 9 UNION ALL SELECT 'z', sha1('zz'), 2)"""


def _contents(e):
    with e.open() as s:
        return sets_of(s)


def sets_of(session):
    from ..storage import materialize

    return materialize(workload.drain(session).select("path", "digest"), "contents")


@query(f"WITH {PAGES_SQL} SELECT path, digest FROM now")
def engine_two_loads(spark, sf_dir):
    return _contents(_page_engine(spark, sf_dir))


@query(f"WITH {PAGES_SQL} SELECT path, digest FROM now")
def engine_vacuum(spark, sf_dir):
    e = _page_engine(spark, sf_dir)
    e.vacuum(target=1 << 20)
    return _contents(Engine(spark, e.root))


@query(f"WITH {PAGES_SQL} SELECT path, digest FROM now")
def engine_checkpoint(spark, sf_dir):
    e = _page_engine(spark, sf_dir)
    e.checkpoint()
    return _contents(Engine(spark, e.root))


@query(f"WITH {PAGES_SQL} SELECT path, digest FROM p")
def engine_pinned_session(spark, sf_dir):
    """What a session reads stays as it was opened, whatever commits meanwhile."""
    pages = scan(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), F.encode("html", "UTF-8").alias("payload"), F.lit(None).cast("binary").alias("object_metadata"))
    e = Engine(spark, scratch_path(spark, "engine"))
    e.ingest(pages)
    with e.open() as s:
        e.apply([Delete("p1"), Rename("p2", "y"), Put("p3", b"new three")])
        return sets_of(s)


@query(f"""WITH {PAGES_SQL} SELECT (SELECT count(*) FROM now) AS live_files, (SELECT sum({PAD.format("strlen(html)")}) FROM pages)::BIGINT AS bytes_before, (SELECT sum({PAD.format("size")}) FROM now)::BIGINT AS bytes_after""")
def vacuum_stats(spark, sf_dir):
    """The figures of a real compaction; base shards count before it."""
    stats = _page_engine(spark, sf_dir).vacuum()
    return spark.createDataFrame([(stats["live_files"], stats["bytes_before"], stats["bytes_after"])], "live_files long, bytes_before long, bytes_after long")


@query("SELECT 'doc' || lpad(doc_id::VARCHAR, 9, '0') AS path, sha1(text) AS digest FROM documents WHERE doc_id = 7")
def point_lookup(spark, sf_dir):
    """One object out of its shard: the filter prunes the catalog's row groups, one range is read."""
    root, objects = _packed_shards(spark, sf_dir)
    return tar.read_shards(spark, root, objects).where("path = 'doc000000007'").select("path", F.sha1("payload").alias("digest"))


@query(f"""{MU}, p AS (SELECT path, seq, op, size FROM mutations WHERE op <> 'rename'), s AS (SELECT 'w' || i AS path, 9000000 + i % 3 AS seq, 'put' AS op, i AS size FROM range(0, 30) t(i)),
l AS (SELECT path, arg_max(op, seq) AS op, arg_max(size, seq) AS size FROM (FROM p UNION ALL FROM s) GROUP BY path) SELECT path, size FROM l WHERE op = 'put'""")
def shard_record_replay(spark, sf_dir):
    """Whole shards in the log: each brings its objects."""
    o = F.struct(F.concat(F.lit("w"), F.col("id").cast("string")).alias("path"), F.lit(5).alias("shard_id"), F.lit(512).cast("long").alias("offset"), F.col("id").alias("size"), F.lit(False).alias("deleted"), F.lit(None).cast("binary").alias("object_metadata"))
    shard = F.struct(F.lit(5).alias("number"), F.lit("base").alias("type"), F.lit(1024).cast("long").alias("total_size"), F.collect_list(o).alias("objects"))
    rows = spark.range(30).groupBy((F.col("id") % 3 + 9_000_000).alias("seq")).agg(shard.alias("shard"))
    whole = rows.select("seq", F.lit("t").alias("txn_id"), F.lit(0).cast("long").alias("ts"), F.lit("shard").alias("op"), F.lit(None).cast(catalog.OBJECTS).alias("add"), F.lit(None).cast("string").alias("delete"), F.col("shard").cast(log.SHARD).alias("shard"))
    none = spark.createDataFrame([], catalog.OBJECTS), spark.createDataFrame([], catalog.SHARDS)
    return catalog.live(log.replay(*none, _records(spark, sf_dir).unionByName(whole))[0]).select("path", "size")


@query(f"""{O} SELECT path, size FROM objects o JOIN shards s ON o.shard_id = s.number WHERE NOT deleted AND "offset" + size <= total_size - CASE WHEN number % 2 = 0 THEN 4000 ELSE 0 END AND number <> 3""")
def payload_present(spark, sf_dir):
    """Objects whose bytes are there: some shard files are short, one is lost."""
    o = T.objects(spark, sf_dir)
    f = T.shards(o).where("number <> 3").select(X.shard_name(F.col("number")).alias("name"), (F.col("total_size") - F.when(F.col("number") % 2 == 0, 4000).otherwise(0)).alias("length"))
    return sets.with_payload(catalog.live(o), f).select("path", "size")


# checks with planted faults


@query("""SELECT 'doc' || lpad(doc_id::VARCHAR, 9, '0') AS path, CASE doc_id % 40 WHEN 3 THEN 'size ' || strlen(text) WHEN 5 THEN 'no shard' ELSE 'beyond the shard' END AS error FROM documents WHERE doc_id % 40 IN (3, 5, 7)""")
def shard_validation(spark, sf_dir):
    """Headers against a catalog with wrong sizes, unknown shards and ranges beyond their shard."""
    root, objects = _packed_shards(spark, sf_dir)
    kind = F.pmod(F.substring("path", 4, 9).cast("long"), F.lit(40))
    o = spark.read.parquet(objects).withColumns({"size": F.when(kind == 3, F.col("size") - 1).otherwise(F.col("size")), "shard_id": F.when(kind == 5, 999_999).otherwise(F.col("shard_id")), "offset": F.when(kind == 7, F.lit(1 << 40)).otherwise(F.col("offset"))})
    return validate.payload_problems(root, o)


@query("""SELECT shard_id, count(*) AS count FROM (SELECT (doc_id % 16)::INT AS shard_id FROM documents WHERE doc_id % 40 IN (3, 5, 7)) GROUP BY 1""")
def errors_by_shard(spark, sf_dir):
    o = T.objects(spark, sf_dir)
    return validate.errors_by_shard(o.where("doc_id % 40 in (3, 5, 7)").select("path", F.lit("x").alias("error")), o)


@query(f"""{O}, s AS (SELECT number, total_size, number <> 3 AS there, CASE WHEN number % 2 = 0 THEN 1 ELSE 0 END AS cut FROM shards)
SELECT 'shard_' || number AS subject, CASE WHEN NOT there THEN 'no file' ELSE 'short file' END AS problem FROM s WHERE NOT there OR cut = 1
UNION ALL SELECT path, 'unknown shard' FROM objects WHERE NOT deleted AND doc_id % 97 = 5
UNION ALL SELECT path, 'beyond the shard' FROM objects WHERE NOT deleted AND doc_id % 97 = 6""")
def catalog_invariants(spark, sf_dir):
    o = T.objects(spark, sf_dir)
    shards = T.shards(o)
    f = shards.where("number <> 3").select(X.shard_name(F.col("number")).alias("name"), (F.col("total_size") - F.when(F.col("number") % 2 == 0, 1).otherwise(0)).alias("length"))
    kind = F.col("doc_id") % 97
    bad = o.withColumns({"shard_id": F.when(kind == 5, 500).otherwise(F.col("shard_id")), "offset": F.when(kind == 6, F.lit(1 << 40)).otherwise(F.col("offset"))})
    return validate.catalog_problems(bad, shards, f)


@query(f"""{O} SELECT path, problem FROM objects, (VALUES (0, 'missing'), (1, 'shared'), (2, 'repeated')) k(k, problem) WHERE NOT deleted AND doc_id % 30 = k UNION ALL SELECT 'x' || path, 'leaked' FROM objects WHERE NOT deleted AND doc_id % 30 = 3""")
def reader_partition_check(spark, sf_dir):
    """A plan that loses objects, gives some to two readers, some twice to one, and has some that nobody asked for."""
    o = T.objects(spark, sf_dir)
    plan = loader.epoch_plan(o, T.shards(o), loader.LoaderSpec(workers=2, world=4, seed=3), all_ranks=True).select("path", "rank", "worker", (F.col("doc_id") % 30).alias("k"))
    again = plan.where("k in (1, 2)").withColumn("worker", F.when(F.col("k") == 1, 1 - F.col("worker")).otherwise(F.col("worker")))
    leaked = plan.where("k = 3").withColumn("path", F.concat(F.lit("x"), F.col("path")))
    return validate.partition_problems(plan.where("k <> 0").unionByName(again).unionByName(leaked), catalog.live(o))


@query(f"""{O}, l AS (SELECT doc_id FROM objects WHERE NOT deleted) SELECT (SELECT count(*) FROM l WHERE doc_id % 10 = 0) AS missing, 0 AS leaked, (SELECT count(*) FROM l WHERE doc_id % 10 = 7) AS duplicate, (SELECT count(*) FROM l WHERE doc_id % 10 = 3) AS wrong_content, 1 AS torn, (SELECT count(*) FROM l WHERE doc_id % 10 = 3) AS wrong_generation,
(SELECT count(*) FROM l WHERE doc_id % 10 IN (0, 7, 3)) + 1 + (SELECT count(*) FROM l WHERE doc_id % 10 = 3) AS total""")
def consistency_violations(spark, sf_dir):
    o = catalog.live(T.objects(spark, sf_dir)).select("doc_id", "path", F.col("size").cast("string").alias("digest"))
    k = F.col("doc_id") % 10
    seen = o.where(k != 0).withColumns({"digest": F.when(k == 3, "x").otherwise(F.col("digest")), "generation": F.when(k == 3, 2).otherwise(1)})
    return sets.violations(o, seen.unionByName(seen.where("doc_id % 10 = 7")), 1)


@query("SELECT true AS same, false AS other")
def same_sequence(spark, sf_dir):
    d = scan(spark, sf_dir, "documents").select("doc_id", "source")
    other = d.withColumn("source", F.when(F.col("doc_id") == 7, "x").otherwise(F.col("source")))
    return spark.createDataFrame([(sets.same_sequence(d, d.repartition(3), "doc_id", "source"), sets.same_sequence(d, other, "doc_id", "source"))], "same boolean, other boolean")


@query(f"{O} SELECT sum(total_size)::VARCHAR AS detail, true AS passed FROM shards")
def preflight_bytes(spark, sf_dir):
    got = validate.preflight({}, (), None, T.shards(T.objects(spark, sf_dir)))
    return spark.createDataFrame([(d, ok) for name, ok, d in got if name == "bytes"], "detail string, passed boolean")


# runs, workloads, reports


@query("""WITH e AS (SELECT l_returnflag AS loader, l_linenumber AS seed, round(avg(l_quantity), 6) AS q FROM lineitem GROUP BY ALL) SELECT loader, seed, q, CASE WHEN seed % 2 = 1 THEN 'c' || loader || seed END AS metric FROM e""")
def cell_metric_join(spark, sf_dir):
    e = scan(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("loader"), F.col("l_linenumber").alias("seed")).agg(F.round(F.avg("l_quantity"), 6).alias("q"))
    return sets.with_cell_metrics(e, e.where("seed % 2 = 1").select("loader", "seed", F.concat(F.lit("c"), "loader", F.col("seed").cast("string")).alias("metric")))


@query("WITH s AS (SELECT p_brand, round(avg(p_retailprice), 2) AS share FROM part GROUP BY 1) SELECT p_brand, share, row_number() OVER (ORDER BY share, p_brand) - 1 AS place FROM s")
def wait_sorted_labels(spark, sf_dir):
    return sets.by_wait(scan(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 2).alias("share")), "share", "p_brand")


@query("""SELECT n_name, n_regionkey, row_number() OVER (ORDER BY CASE n_name WHEN 'NATION_3' THEN 1 WHEN 'NATION_1' THEN 2 ELSE 3 END, n_name) - 1 AS position FROM nation""")
def config_order(spark, sf_dir):
    """The position is where a row comes out of the operator."""
    rows = ordered.config_order(scan(spark, sf_dir, "nation"), "n_name", ["NATION_3", "NATION_1"]).coalesce(1)
    return rows.select("n_name", "n_regionkey", F.monotonically_increasing_id().alias("position"))


@query("""WITH b AS (SELECT l_returnflag AS loader, l_discount + l_tax + 0.01 AS s, l_discount * 0.1 AS z, l_discount * 0.6 AS f, l_discount * 0.3 AS o FROM lineitem)
SELECT loader, round(sum(z) / sum(s), 6) AS zero_grad_fraction, round(sum(f) / sum(s), 6) AS forward_backward_fraction, round(sum(o) / sum(s), 6) AS optimizer_fraction FROM b GROUP BY loader""")
def stage_fractions(spark, sf_dir):
    d = F.col("l_discount")
    b = scan(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("loader"), F.lit(1).alias("batch_idx"), F.lit(1).alias("n"), F.col("l_tax").alias("fetch_s"), (d + 0.01).alias("compute_s"), (d * 0.1).alias("zero_grad_s"), (d * 0.6).alias("forward_backward_s"), (d * 0.3).alias("optimizer_s"))
    return M.epoch_summary(b, ["loader"]).select("loader", *[F.round(c, 6).alias(c) for c in ("zero_grad_fraction", "forward_backward_fraction", "optimizer_fraction")])


@query("SELECT l_returnflag AS loader, round(avg(l_tax) FILTER (WHERE l_linenumber > 1), 6) AS fetch_p50, round(avg(l_discount) FILTER (WHERE l_linenumber > 1), 6) AS wait_fraction, NULL::DOUBLE AS fetch_p95, NULL::DOUBLE AS fetch_p99, NULL::DOUBLE AS time_to_first_batch FROM lineitem GROUP BY 1")
def latency_report(spark, sf_dir):
    rows = scan(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("loader"), F.col("l_tax").alias("fetch_p50"), F.col("l_discount").alias("wait_fraction"), F.when(F.col("l_linenumber") == 1, "True").otherwise("").alias("warmup"))
    return report.latency_table(rows).withColumns({c: F.round(c, 6) for c in ("fetch_p50", "wait_fraction")})


@query("""SELECT o_orderpriority AS mode, month(o_orderdate)::VARCHAR AS rate, count(*) AS n, round(avg(o_totalprice), 4) AS mean_latency, round(avg(o_orderkey), 4) AS max_latency, round(sum(o_custkey)) AS violations, NULL::DOUBLE AS attempted, NULL::DOUBLE AS failed FROM orders GROUP BY ALL""")
def mutation_report(spark, sf_dir):
    rows = scan(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("mode"), F.month("o_orderdate").cast("string").alias("rate"), F.col("o_totalprice").alias("mean_latency_s"), F.col("o_orderkey").alias("max_latency_s"), F.col("o_custkey").alias("total"))
    return report.mutation_report(rows).withColumns({c: F.round(c, 4) for c in ("mean_latency", "max_latency")})


@query("SELECT s_name AS mode, s_acctbal AS min, s_suppkey::DOUBLE AS max, NULL::DOUBLE AS growth, NULL::DOUBLE AS slope, NULL::DOUBLE AS mean_drain FROM supplier")
def memory_report(spark, sf_dir):
    return report.memory_table(scan(spark, sf_dir, "supplier").select(F.col("s_name").alias("mode"), F.col("s_acctbal").alias("min"), F.col("s_suppkey").alias("max")))


@query("SELECT s_name AS loader, ['missing', 'error'][(s_suppkey % 3)::INT] AS status FROM supplier WHERE s_suppkey % 3 <> 0")
def missing_report(spark, sf_dir):
    return report.missing_table(scan(spark, sf_dir, "supplier").select(F.col("s_name").alias("loader"), pick(F.col("s_suppkey"), "ok", "missing", "error").alias("status")))


@query("SELECT p_brand AS label, count(*) AS n, count(*) = max(count(*)) OVER () AS longest FROM part GROUP BY 1")
def class_counts(spark, sf_dir):
    n = scan(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(n.agg(F.max("n").alias("m")), F.lit(True)).select("label", "n", (F.col("n") == F.col("m")).alias("longest"))


@query("""WITH v AS (SELECT 's' || s_suppkey AS path, row_number() OVER (ORDER BY md5('5:' || 's' || s_suppkey), 's' || s_suppkey) - 1 AS i FROM supplier),
m AS (SELECT i, ['add', 'delete', 'replace'][('0x' || md5('5:' || i)[1:8])::BIGINT % 3 + 1] AS op, path AS victim FROM v WHERE i < 60)
SELECT i, op, CASE WHEN op = 'add' THEN 'm' || lpad(i::VARCHAR, 8, '0') || '__added' ELSE victim END AS path, CASE WHEN op = 'delete' THEN -1 ELSE 100 END AS size FROM m""")
def random_mutations(spark, sf_dir):
    s = scan(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"))
    return workload.random_mutations(spark, s, 60, 5, size=100).select("i", "op", "path", F.coalesce(F.octet_length("payload"), F.lit(-1)).alias("size"))


@query("SELECT s_name AS path, 'delete' AS op FROM supplier ORDER BY md5('3:' || s_name), s_name LIMIT 20")
def fixed_deletes(spark, sf_dir):
    return workload.fixed_deletes(scan(spark, sf_dir, "supplier").select(F.col("s_name").alias("path")), 20, 3)


@query("WITH c AS (SELECT s_name AS path FROM supplier ORDER BY md5('4:' || s_name), s_name LIMIT 15) SELECT path, row_number() OVER (ORDER BY path) - 1 AS i, 80 AS size FROM c")
def planned_replacements(spark, sf_dir):
    p = workload.planned_replacements(scan(spark, sf_dir, "supplier").select(F.col("s_name").alias("path")), 15, 4, 80)
    return p.select("path", "i", F.octet_length("payload").alias("size"))


@query("WITH f AS (SELECT lpad(p_partkey::VARCHAR, 8, '0') || '__' || p_brand || '__x' AS path, p_brand AS label FROM part) SELECT path, label FROM f ORDER BY md5('6:' || path), path LIMIT 25")
def payload_pool(spark, sf_dir):
    return workload.payload_pool(scan(spark, sf_dir, "part").select(X.flat_name(F.col("p_partkey"), F.col("p_brand"), F.lit("x")).alias("path")), 25, 6)


@query("SELECT a.v AS workers, b.v AS seed, 'x' AS run FROM (VALUES (1), (2)) a(v), (VALUES (7), (8), (9)) b(v)")
def experiment_cells(spark, sf_dir):
    return workload.cells(spark, {"workers": [1, 2]}, [7, 8, 9], {"run": "x"}).select(F.col("workers").cast("int").alias("workers"), F.col("seed").cast("int").alias("seed"), "run")


@query("WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS turn FROM part), o AS (SELECT *, row_number() OVER (ORDER BY turn, p_brand) AS rn FROM r) SELECT p_partkey, k AS size FROM o, (VALUES (10), (40)) s(k) WHERE rn <= k")
def nested_prefixes(spark, sf_dir):
    got = workload.nested_prefixes(scan(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", [10, 40])
    return sets.union_rows(*[df.select("p_partkey", F.lit(n).alias("size")) for n, df in got.items()])


@query("SELECT 0 AS total, 2 AS attempted, 1 AS failed, 'ok' AS status UNION ALL SELECT NULL, NULL, NULL, 'missing'")
def mutation_run(spark, sf_dir):
    """A session over pages while others commit: nothing it reads changes; an absent format keeps its row."""
    e = _page_engine(spark, sf_dir)

    def run(cell):
        if cell["format"] == "absent":
            raise files.FormatUnavailable("absent")
        return [workload.mutation_case(e, loader.LoaderSpec(seed=2), lambda x: [lambda: x.put("n", b"1"), lambda: x.delete("nothing")])]

    rows = workload.run_cells(workload.cells(spark, {"format": ["tar", "absent"]}, [1]), run, files.FormatUnavailable)
    return spark.createDataFrame([(r.get("total"), r.get("attempted"), r.get("failed"), r["status"]) for r in rows], "total int, attempted int, failed int, status string")


@query("SELECT s AS scenario, count(*) AS live_files, (sum(512 + size + (512 - size % 512) % 512))::BIGINT AS bytes_after FROM (SELECT 's' || s_suppkey AS path, 13 + s_suppkey % 900 AS size FROM supplier) f, (VALUES ('few'), ('many')) k(s) WHERE NOT (path = 's3' OR s = 'many' AND path IN ('s4', 's5')) GROUP BY s")
def snapshot_comparison(spark, sf_dir):
    """Two compaction scenarios on copies of one base."""
    rows = scan(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), X.replacement_payload(F.col("s_suppkey"), F.col("s_suppkey") % 900 + 13).alias("payload"), F.lit(None).cast("binary").alias("object_metadata"))

    def base():
        e = Engine(spark, scratch_path(spark, "base"))
        e.ingest(rows)
        return e

    got = workload.compare_scenarios(base, {"few": lambda e: e.delete("s3"), "many": lambda e: e.apply([Delete("s3"), Delete("s4"), Delete("s5")])})
    return spark.createDataFrame([(r["scenario"], r["live_files"], r["bytes_after"]) for r in got], "scenario string, live_files long, bytes_after long")

"""Queries of the catalog, metric, ordered, set and packing operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..functions import scalar as X
from ..operators import metrics as M
from ..operators import ordered as P
from ..operators import packing, sets
from ..storage import scan
from . import tables as T

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(*names):
    """Round doubles whose sums depend on the order of addition."""
    return lambda df: df.withColumns({n: F.round(n, 6) for n in names})


O, MU, SE, RU = (f"WITH {x}" for x in (T.OBJECTS_SQL, T.MUTATIONS_SQL, T.SERIES_SQL, T.RUNS_SQL))


# catalog


@query(f"{O} SELECT path, shard_id, \"offset\", size, deleted, coalesce(lang, '') AS label FROM objects")
def manifest_scan(spark, sf_dir):
    o = catalog.metadata(T.objects(spark, sf_dir))
    return o.select("path", "shard_id", "offset", "size", "deleted", F.coalesce(F.variant_get("meta", "$.label", "string"), F.lit("")).alias("label"))


@query(f"{O} SELECT path, o.shard_id, coalesce(type, '') AS type, coalesce(total_size, -1) AS total_size FROM objects o LEFT JOIN (FROM shards WHERE number < 12) s ON o.shard_id = s.number")
def index_build(spark, sf_dir):
    o = T.objects(spark, sf_dir)
    return catalog.index(o, T.shards(o).where("number < 12")).select("path", "shard_id", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("total_size", F.lit(-1)).alias("total_size"))


@query(f"{O} SELECT path, shard_id FROM objects WHERE shard_id >= 12")
def index_orphans(spark, sf_dir):
    o = T.objects(spark, sf_dir)
    return catalog.orphans(o, T.shards(o).where("number < 12")).select("path", "shard_id")


@query(f"{O} SELECT path, size FROM objects WHERE NOT deleted")
def live_filter(spark, sf_dir):
    return catalog.live(T.objects(spark, sf_dir)).select("path", "size")


@query(f"""{O}, o AS (SELECT count(*) AS n_live, sum(size)::BIGINT AS live_bytes, avg(size) AS avg_object, max(size) AS max_object FROM objects WHERE NOT deleted)
SELECT o.*, n_shards, avg_shard, max_shard FROM o, (SELECT count(*) AS n_shards, avg(total_size) AS avg_shard, max(total_size) AS max_shard FROM shards)""")
def dataset_profile(spark, sf_dir):
    o = T.objects(spark, sf_dir)
    return catalog.profile(o, T.shards(o))


@query(f"""{O}, o AS (SELECT sum(size) FILTER (WHERE deleted)::BIGINT AS dead_bytes, sum(512 + size + (512 - size % 512) % 512) FILTER (WHERE NOT deleted) AS live FROM objects),
s AS (SELECT sum(total_size)::BIGINT AS physical_bytes FROM shards)
SELECT dead_bytes, physical_bytes, dead_bytes / physical_bytes AS fragmentation, greatest(0.0, 1 - live / physical_bytes) AS true_dead FROM o, s""")
def fragmentation(spark, sf_dir):
    o = T.objects(spark, sf_dir)
    return catalog.fragmentation(o, T.shards(o))


@query(f"""{O}, per AS (SELECT shard_id, count(*) AS n_live, max("offset" + size) AS reach FROM objects WHERE NOT deleted AND (shard_id % 4 <> 3 OR shard_id > 8) GROUP BY shard_id)
SELECT number, type, coalesce(n_live, 0) AS n_live, CASE WHEN type = 'delta' THEN coalesce(reach, 0) ELSE total_size END AS cover_size
FROM shards LEFT JOIN per ON number = shard_id WHERE type <> 'delta' OR coalesce(n_live, 0) > 0""")
def snapshot_cover(spark, sf_dir):
    o = T.objects(spark, sf_dir)
    return catalog.served_shards(o.where("shard_id % 4 <> 3 or shard_id > 8"), T.shards(o))


@query("""SELECT coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), ''), '<none>') AS suffix, count(*) AS n_files, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY 1""")
def inventory_by_suffix(spark, sf_dir):
    p = scan(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.octet_length("html").cast("long").alias("size"))
    return catalog.inventory(p, "host", "size")


@query(f"{O} SELECT number, total_size FROM shards WHERE number >= 0 AND type = 'base'")
def base_shards(spark, sf_dir):
    o = T.objects(spark, sf_dir)
    return catalog.base_shard_order(T.shards(o).where("type = 'base'")).select("number", "total_size")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN json_type(props) = 'OBJECT' THEN 'columns' WHEN json_type(props) = 'ARRAY' THEN 'annotations' ELSE 'meta_raw' END AS merged FROM events")
def json_metadata_merge(spark, sf_dir):
    v = F.try_parse_json("props")
    kind = F.schema_of_variant(v)
    return scan(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.when(kind.startswith("OBJECT"), "columns").when(kind.startswith("ARRAY"), "annotations").otherwise("meta_raw").alias("merged"))


# measurements


@query(f"{RU} SELECT loader, avg(coalesce(steady, throughput)) AS mean, round(stddev_samp(coalesce(steady, throughput)), 6) AS std, count(DISTINCT seed) AS n_seeds FROM runs WHERE lower(warmup) <> 'true' GROUP BY loader")
def loader_throughput_mean_std(spark, sf_dir):
    return r6("std")(M.throughput_by(M.without_warmup(T.runs(spark, sf_dir)), "loader", "throughput", "steady", "seed"))


@query(f"""{RU} SELECT loader, CASE WHEN count(steady) > 0 THEN avg(steady) ELSE avg(throughput) END AS mean, round(CASE WHEN count(steady) > 0 THEN coalesce(stddev_samp(steady), 0) ELSE coalesce(stddev_samp(throughput), 0) END, 6) AS std
FROM runs GROUP BY loader""")
def single_run_table(spark, sf_dir):
    return r6("std")(M.throughput_table(T.runs(spark, sf_dir), "loader", "throughput", "steady"))


@query(f"{RU} SELECT loader, quantile_cont(price, 0.5) AS p50, quantile_cont(price, 0.95) AS p95, quantile_cont(price, 0.99) AS p99 FROM runs GROUP BY loader")
def loader_latency_percentiles(spark, sf_dir):
    return M.percentiles(T.runs(spark, sf_dir), "loader", "price", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, float("nan"))


@query(f"""{RU} SELECT loader, round(avg(wait), 6) AS wait, round(avg(fb), 6) AS forward_backward, round(avg(opt), 6) AS optimizer, round(avg(greatest(0.0, 1 - wait - fb - opt)), 6) AS other FROM runs GROUP BY loader""")
def stage_fraction_means(spark, sf_dir):
    return r6("wait", "forward_backward", "optimizer", "other")(M.stage_shares(T.runs(spark, sf_dir), "loader", "wait", "fb", "opt"))


@query(f"""{RU}, c AS (SELECT loader, CASE WHEN seed % 2 = 0 THEN wait ELSE fb END AS w, CASE WHEN seed > 4 THEN fb ELSE 0 END AS f, CASE WHEN seed > 4 THEN opt ELSE 0 END AS o FROM runs)
SELECT loader, round(avg(w), 6) AS wait, round(avg(f) FILTER (WHERE f > 0 OR o > 0), 6) AS forward_backward, round(avg(o) FILTER (WHERE f > 0 OR o > 0), 6) AS optimizer,
round(avg(greatest(0, 1 - w - f - o)) FILTER (WHERE f > 0 OR o > 0), 6) AS other, round(avg(greatest(0, 1 - w)) FILTER (WHERE f <= 0 AND o <= 0), 6) AS compute FROM c GROUP BY loader""")
def wait_compute_switch(spark, sf_dir):
    late = F.col("seed") > 4
    rows = T.runs(spark, sf_dir).select("loader", F.when(F.col("seed") % 2 == 0, F.col("wait")).alias("steady_wait_fraction"), F.col("fb").alias("stall_fraction"), F.when(late, F.col("fb")).alias("forward_backward_fraction"), F.when(late, F.col("opt")).alias("optimizer_fraction"))
    return r6("wait", "forward_backward", "optimizer", "other", "compute")(M.stage_values(rows, "loader"))


@query("""WITH b AS (SELECT l_returnflag AS loader, l_linenumber AS epoch, l_orderkey % 7 AS batch_idx, 64 AS n, l_tax AS f, l_discount + 0.01 AS c FROM lineitem)
SELECT loader, epoch, count(*) AS n_batches, round(sum(n) / sum(f + c), 6) AS throughput, round(sum(n) FILTER (WHERE batch_idx >= 2) / sum(f + c) FILTER (WHERE batch_idx >= 2), 6) AS steady_throughput,
round(sum(f) / sum(f + c), 6) AS wait_fraction, round(quantile_cont(f, 0.95), 6) AS fetch_p95, round(quantile_cont(f + c, 0.99), 6) AS step_p99, max(f) AS fetch_max FROM b GROUP BY loader, epoch""")
def epoch_summary(spark, sf_dir):
    b = scan(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("loader"), F.col("l_linenumber").alias("epoch"), (F.col("l_orderkey") % 7).alias("batch_idx"), F.lit(64).alias("n"), F.col("l_tax").alias("fetch_s"), (F.col("l_discount") + 0.01).alias("compute_s"),
        (F.col("l_discount") * 0.1).alias("zero_grad_s"), (F.col("l_discount") * 0.6).alias("forward_backward_s"), (F.col("l_discount") * 0.3).alias("optimizer_s"),
    )
    out = M.epoch_summary(b, ["loader", "epoch"], 2).select("loader", "epoch", "n_batches", "throughput", "steady_throughput", "wait_fraction", "fetch_p95", "step_p99", "fetch_max")
    return r6("throughput", "steady_throughput", "wait_fraction", "fetch_p95", "step_p99")(out)


@query("SELECT p_brand, p_size::VARCHAR AS axis, round(avg(p_retailprice), 6) AS mean, round(coalesce(stddev_samp(p_retailprice), 0), 6) AS std, count(p_retailprice) AS n FROM part GROUP BY ALL")
def sweep_table(spark, sf_dir):
    return r6("mean", "std")(M.sweep_table(scan(spark, sf_dir, "part"), "p_brand", "p_size", "p_retailprice", numeric=False))


@query("SELECT p_brand, p_size::DOUBLE AS axis, round(avg(p_retailprice), 6) AS mean, round(coalesce(stddev_samp(p_retailprice), 0), 6) AS std, count(p_retailprice) AS n FROM part WHERE p_size % 5 <> 0 GROUP BY ALL")
def sweep_series(spark, sf_dir):
    p = scan(spark, sf_dir, "part").withColumn("cell", F.when(F.col("p_size") % 5 == 0, "n/a").otherwise(F.col("p_size").cast("string")))
    return r6("mean", "std")(M.sweep_table(p, "p_brand", "cell", "p_retailprice", numeric=True))


@query("SELECT 'axis_size' AS axis")
def axis_discovery(spark, sf_dir):
    p = scan(spark, sf_dir, "part").select(F.lit(1).alias("axis_const"), F.col("p_size").alias("axis_size"), F.col("p_brand").alias("axis_brand"))
    return spark.createDataFrame([(M.sweep_axis(p),)], "axis string")


@query("SELECT workers::BIGINT AS workers, batch::BIGINT AS batch, mode FROM (VALUES (1), (2), (4)) a(workers), (VALUES (64), (256)) b(batch), (VALUES ('raw'), ('rgb')) c(mode)")
def axis_cross_product(spark, sf_dir):
    return sets.axis_product(spark, {"workers": [1, 2, 4], "batch": [64, 256], "mode": ["raw", "rgb"]})


@query("""WITH m AS (SELECT n_regionkey AS region, c_nationkey AS nation, round(avg(c_acctbal), 6) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT region, nation, v, round((v / max(CASE WHEN v > 0 THEN v END) OVER (PARTITION BY region) - 1) * 100, 6) AS relative_pct FROM m""")
def relative_to_best(spark, sf_dir):
    m = scan(spark, sf_dir, "customer").join(scan(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("region"), F.col("c_nationkey").alias("nation")).agg(F.round(F.avg("c_acctbal"), 6).alias("v"))
    return r6("relative_pct")(M.relative_to_best(m, "region", "v"))


@query("""WITH m AS (SELECT o_orderpriority AS scenario, o_orderstatus AS wal, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY ALL),
b AS (SELECT wal, v AS base FROM m WHERE scenario = '5-LOW' AND wal <> 'P'), f AS (SELECT avg(v) AS base FROM m WHERE scenario = '5-LOW' AND wal = 'F')
SELECT scenario, m.wal, v, round((v / coalesce(b.base, f.base) - 1) * 100, 6) AS relative_pct, round(v - coalesce(b.base, f.base), 4) AS delta FROM m LEFT JOIN b USING (wal), f""")
def relative_to_baseline(spark, sf_dir):
    m = scan(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("scenario"), F.col("o_orderstatus").alias("wal")).agg(F.round(F.avg("o_totalprice"), 4).alias("v"))
    # the baseline of status P is taken away, so that the fallback steps in
    named = m.withColumn("s", F.when((F.col("scenario") == "5-LOW") & (F.col("wal") == "P"), "none").otherwise(F.col("scenario")))
    out = M.relative_to_baseline(named, ["wal"], "s", "5-LOW", "v", fallback={"wal": "F"}).drop("s")
    return out.withColumns({"relative_pct": F.round("relative_pct", 6), "delta": F.round("delta", 4)})


@query(f"""{SE}, o AS (SELECT series, t, counter - lag(counter) OVER w AS d, t - lag(t) OVER w AS dt FROM series WHERE event_id % 3 <> 0 WINDOW w AS (PARTITION BY series ORDER BY t, event_id))
SELECT series, t, round(greatest(0.0, d) / greatest(dt, 1e-9), 4) AS rate FROM o WHERE d IS NOT NULL AND dt > 0""")
def counter_rate(spark, sf_dir):
    s = T.series(spark, sf_dir).withColumn("counter", F.when(F.col("event_id") % 3 != 0, F.col("counter")))
    one = s.groupBy("series", "t").agg(F.max("counter").alias("counter"))  # points are distinct in time
    return P.counter_rate(one, "series", "t", "counter").withColumn("rate", F.round("rate", 4))


@query(f"{SE} SELECT event_id, series, round(t - min(t) OVER (PARTITION BY series), 6) AS rel_t FROM series")
def relative_time(spark, sf_dir):
    return P.relative_time(T.series(spark, sf_dir), "series", "t").select("event_id", "series", F.round("rel_t", 6).alias("rel_t"))


@query(f"""{SE} SELECT series, count(*) AS n_points, round(avg(value), 6) AS value_mean, round(quantile_cont(value, 0.95), 6) AS value_p95, max(value) AS value_max, min(value) AS value_min,
arg_max(counter, t) - arg_min(counter, t) AS counter_delta, round((arg_max(counter, t) - arg_min(counter, t)) / greatest(max(t) - min(t), 1e-9), 6) AS counter_per_s FROM series GROUP BY series""")
def system_summary_deltas(spark, sf_dir):
    return r6("value_mean", "value_p95", "counter_per_s")(M.series_summary(T.series(spark, sf_dir), "series", "t", ["value"], ["counter"])).drop("duration_s")


@query(f"{SE} SELECT series, round(coalesce(regr_slope(counter, t), 0), 6) AS slope, count(*) AS n FROM series GROUP BY series")
def regr_slope_per_series(spark, sf_dir):
    return r6("slope")(M.slope(T.series(spark, sf_dir), "series", "t", "counter"))


@query(f"""{SE} SELECT series, min(counter) AS min, max(counter) AS max, arg_max(counter, event_id) - arg_min(counter, event_id) AS growth, round(regr_slope(counter, event_id), 6) AS slope, round(avg(value), 6) AS mean_drain
FROM series WHERE event_id >= 100 GROUP BY series""")
def rss_plateau(spark, sf_dir):
    return r6("slope", "mean_drain")(M.plateau(T.series(spark, sf_dir), "series", "event_id", "counter", 100, "value"))


@query(f"""{SE}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY event_id DESC) AS rn FROM series)
SELECT series, count(*) AS n, round(quantile_cont(value, 0.5) FILTER (WHERE rn <= 8192), 6) AS p50, round(quantile_cont(value, 0.95) FILTER (WHERE rn <= 8192), 6) AS p95, round(quantile_cont(value, 0.99) FILTER (WHERE rn <= 8192), 6) AS p99, max(value) FILTER (WHERE rn <= 8192) AS max
FROM r GROUP BY series""")
def ring_last_n_percentiles(spark, sf_dir):
    return r6("p50", "p95", "p99")(M.ring_histogram(T.series(spark, sf_dir), "series", "event_id", "value"))


@query("""WITH u AS (FROM (SELECT l_returnflag AS loader, 'read' AS stage, l_discount AS p50, l_tax AS p95, l_quantity AS n FROM lineitem) UNION ALL SELECT l_returnflag, 'write', l_tax, l_discount, NULL FROM lineitem)
SELECT loader, stage, round(avg(p50) * 1000, 6) AS p50_ms, round(avg(p95) * 1000, 6) AS p95_ms, sum(n) AS samples FROM u GROUP BY loader, stage""")
def histogram_unpivot(spark, sf_dir):
    li = scan(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("loader"), F.col("l_discount").alias("rd_p50_s"), F.col("l_tax").alias("rd_p95_s"), F.col("l_quantity").alias("rd_count"), F.col("l_tax").alias("wr_p50_s"), F.col("l_discount").alias("wr_p95_s"))
    return r6("p50_ms", "p95_ms")(M.stage_percentile_table(li, "loader", {"read": "rd", "write": "wr"}))


@query("""SELECT o_orderpriority AS scenario, count(*) AS n, round(avg(o_totalprice), 4) AS mean_ms, max(o_totalprice) AS max_ms, min(o_totalprice) AS min_ms, arg_min(o_orderstatus, o_orderkey) AS wal_format FROM orders GROUP BY 1""")
def vacuum_matrix_table(spark, sf_dir):
    out = M.grouped_table(scan(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "scenario"), ["scenario"], means={"mean_ms": "o_totalprice"}, maxima={"max_ms": "o_totalprice"}, minima={"min_ms": "o_totalprice"}, first={"wal_format": ("o_orderstatus", "o_orderkey")})
    return out.withColumn("mean_ms", F.round("mean_ms", 4))


@query("""SELECT o_orderstatus AS format, month(o_orderdate)::DOUBLE AS changed, count(*) AS n, round(avg(o_totalprice), 4) AS mean_ms, round(sum(o_totalprice), 2) AS bytes FROM orders GROUP BY ALL""")
def format_mutation_table(spark, sf_dir):
    o = scan(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("format"), F.month("o_orderdate").cast("double").alias("changed"), "o_totalprice")
    out = M.grouped_table(o, ["format", "changed"], means={"mean_ms": "o_totalprice"}, sums={"bytes": "o_totalprice"}).withColumns({"mean_ms": F.round("mean_ms", 4), "bytes": F.round("bytes", 2)})
    return out.orderBy("format", "changed")


@query("""SELECT event_type AS mode, hour(ts)::INT AS rate, count(*) AS n, round(avg(value), 6) AS mean_latency, max(value) AS max_latency FROM events GROUP BY ALL""")
def mutation_table(spark, sf_dir):
    e = scan(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.hour("ts").alias("rate"), "value")
    return r6("mean_latency")(M.grouped_table(e, ["mode", "rate"], means={"mean_latency": "value"}, maxima={"max_latency": "value"}))


@query("SELECT p_brand, p_size, arg_max(p_retailprice, p_partkey) AS p_retailprice FROM part GROUP BY ALL")
def last_wins_points(spark, sf_dir):
    return M.last_wins(scan(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_retailprice", "p_partkey")


@query("SELECT p_brand, p_size, round(avg(p_retailprice), 6) AS mean, round(coalesce(stddev_samp(p_retailprice), 0), 6) AS std FROM part GROUP BY ALL")
def small_file_scaling(spark, sf_dir):
    return r6("mean", "std")(M.size_scaling(scan(spark, sf_dir, "part"), "p_brand", "p_size", "p_retailprice", "p_retailprice")[0])


@query("""SELECT event_type AS loader, round(avg(value), 6) AS mean_p50, round(avg(CASE WHEN event_id % 4 > 0 THEN value END), 6) AS mean_p99 FROM events GROUP BY 1""")
def sparse_cell_means(spark, sf_dir):
    e = scan(spark, sf_dir, "events").select(F.col("event_type").alias("loader"), F.col("value").cast("string").alias("a"), F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("value").cast("string")).alias("b"))
    return r6("mean_p50", "mean_p99")(M.mean_of(e, ["loader"], {"mean_p50": "a", "mean_p99": "b"}))


@query("""SELECT l_returnflag AS loader, count(*) AS objects, sum(l_orderkey)::BIGINT AS bytes, round(count(*) / greatest(max(l_quantity), 1e-9), 6) AS objects_per_s, round(sum(l_orderkey) / 1048576.0 / greatest(max(l_quantity), 1e-9), 6) AS mib_per_s, round(avg(l_orderkey), 6) AS avg_bytes, min(l_quantity) AS first_s FROM lineitem GROUP BY 1""")
def pure_read_row(spark, sf_dir):
    li = scan(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("loader"), "l_orderkey", "l_quantity")
    return r6("objects_per_s", "mib_per_s", "avg_bytes")(M.pure_read(li, "loader", "l_orderkey", "l_quantity"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY e DESC) AS rn FROM (SELECT l_suppkey, l_linenumber AS e, avg(l_quantity) AS q, max(l_tax) + 1 AS m FROM lineitem GROUP BY ALL))
SELECT l_suppkey, round(avg(q) FILTER (WHERE rn <= 3) / max(q) FILTER (WHERE e = 2), 6) AS retention, round(max(m) FILTER (WHERE rn = 1) / max(m) FILTER (WHERE e = 2), 6) AS rss_growth,
coalesce(avg(q) FILTER (WHERE rn <= 3) / max(q) FILTER (WHERE e = 2) >= 0.85 AND max(m) FILTER (WHERE rn = 1) / max(m) FILTER (WHERE e = 2) <= 2.0, false) AS stable FROM r GROUP BY l_suppkey""")
def stability_gates(spark, sf_dir):
    e = scan(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("e")).agg(F.avg("l_quantity").alias("q"), (F.max("l_tax") + 1).alias("m"))
    return r6("retention", "rss_growth")(M.stability(e, "l_suppkey", "e", "q", "m"))


@query("""WITH b AS (SELECT event_type AS name, count(*)::DOUBLE AS v FROM events WHERE event_id < 500 GROUP BY 1), a AS (SELECT event_type AS name, count(*)::DOUBLE AS v FROM events GROUP BY 1)
SELECT kind, name, CASE WHEN kind = 'gauge' THEN a.v ELSE a.v - coalesce(b.v, 0) END AS value FROM a LEFT JOIN b USING (name), (VALUES ('counter'), ('gauge'), ('histogram')) k(kind)""")
def snapshot_delta(spark, sf_dir):
    def maps(df):
        m = df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.col("n").cast("double")))).alias("m"))
        return m.select(F.col("m").alias("counters"), F.col("m").alias("gauges"), F.col("m").alias("histograms"))

    e = scan(spark, sf_dir, "events")
    return M.snapshot_delta(maps(e.where("event_id < 500")), maps(e))


# sets and joins


@query("""SELECT 'doc' || doc_id AS path, 'missing' AS problem FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT 'new' || doc_id, 'leaked' FROM documents WHERE doc_id % 25 = 1
UNION ALL SELECT 'doc' || doc_id, 'wrong_content' FROM documents WHERE doc_id % 10 = 3 UNION ALL SELECT 'doc' || doc_id, 'duplicate' FROM documents WHERE doc_id % 10 = 7""")
def epoch_differences(spark, sf_dir):
    d = scan(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), F.sha1(F.encode("text", "UTF-8")).alias("digest"))
    seen = d.where("doc_id % 10 <> 0").withColumn("digest", F.when(F.col("doc_id") % 10 == 3, "x").otherwise(F.col("digest")))
    leaked = d.where("doc_id % 25 = 1").select("doc_id", F.concat(F.lit("new"), F.col("doc_id").cast("string")).alias("path"), "digest")
    return sets.epoch_differences(d, seen.union(seen.where("doc_id % 10 = 7")).union(leaked))


@query("SELECT source AS path, count(*) AS count FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_paths(spark, sf_dir):
    return sets.duplicates(scan(spark, sf_dir, "documents").select(F.col("source").alias("path")), "path")


@query("SELECT doc_id, lang, (dense_rank() OVER (ORDER BY lang) - 1)::INT AS idx FROM documents")
def label_index(spark, sf_dir):
    d = scan(spark, sf_dir, "documents").select("doc_id", "lang")
    return sets.with_label_index(d, "lang", sets.label_index(d, "lang"))


@query("SELECT DISTINCT lang AS label FROM documents WHERE lang IS NOT NULL UNION SELECT x FROM (VALUES ('0'), ('1'), ('2'), ('3')) v(x)")
def label_collection(spark, sf_dir):
    return sets.collected_labels(scan(spark, sf_dir, "documents"), "lang")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, CASE WHEN event_id % 3 > 0 THEN event_type END) AS label FROM events")
def label_fallback(spark, sf_dir):
    path = F.concat(F.lit("1__"), F.col("event_type"), F.lit("__a__b.bin"))
    return scan(spark, sf_dir, "events").select("event_id", X.fallback_label(F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.when(F.col("event_id") % 3 > 0, path).otherwise("plain.bin")).alias("label"))


@query("""WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS captions, arg_max(role, turn) AS split FROM conversations GROUP BY 1)
SELECT p.page_id, coalesce(len(captions), 0)::INT AS n_captions, captions[1] AS first_caption, coalesce(split, 'train') AS split FROM pages p LEFT JOIN c ON p.page_id = c.conv_id""")
def caption_join(spark, sf_dir):
    images = scan(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("filename"))
    notes = scan(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("filename"), F.col("turn").alias("row_no"), F.col("text").alias("caption"), F.col("role").alias("split"))
    return sets.captions(images, notes).select("page_id", F.size("captions").alias("n_captions"), F.get("captions", F.lit(0)).alias("first_caption"), "split")


@query(f"{SE} SELECT event_id, i FROM series, (SELECT range AS i, range * 5000.0 AS a, range * 5000.0 + 1200.0 AS b FROM range(0, 500)) WHERE t BETWEEN a AND b")
def event_range_overlay(spark, sf_dir):
    iv = spark.range(500).select(F.col("id").alias("i"), (F.col("id") * 5000.0).alias("start_s"), (F.col("id") * 5000.0 + 1200.0).alias("end_s"))
    return sets.overlay(T.series(spark, sf_dir), "t", iv, 5000.0).select("event_id", "i")


@query("SELECT r_regionkey AS k, r_name AS name, NULL::VARCHAR AS extra FROM region UNION ALL SELECT n_nationkey, n_name, 'nation' FROM nation")
def union_schema_rows(spark, sf_dir):
    a = scan(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return sets.union_rows(a, scan(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.lit("nation").alias("extra")))


@query("SELECT 'shard_' || s_suppkey AS name FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'shard_' || s_suppkey || '.tmp' FROM supplier WHERE s_suppkey < 5")
def keep_set_cleanup(spark, sf_dir):
    s = scan(spark, sf_dir, "supplier")
    name = F.concat(F.lit("shard_"), F.col("s_suppkey").cast("string"))
    files = s.select(name.alias("name")).union(s.where("s_suppkey < 5").select(F.concat(name, F.lit(".tmp"))))
    return sets.stale_files(files, s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").cast("int").alias("number"))).select("name")


@query("SELECT path, replica, 'rep' || lpad(replica::VARCHAR, 4, '0') || '__' || path AS logical_path FROM (SELECT s_name AS path, unnest(range(0, 3))::INT AS replica FROM supplier)")
def replicate_cross(spark, sf_dir):
    return sets.replicate(scan(spark, sf_dir, "supplier").select(F.col("s_name").alias("path")), 3, "path").select("path", "replica", "logical_path")


# order


@query("SELECT * FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS turn FROM part) ORDER BY turn, p_brand LIMIT 100")
def balanced_round_robin(spark, sf_dir):
    return P.balanced_first(scan(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 100).withColumn("turn", F.col("turn").cast("long"))


@query(f"{O}, c AS (SELECT doc_id, size, sum(size) OVER (ORDER BY doc_id) AS cum FROM objects) SELECT doc_id, size FROM c WHERE cum <= 1000000 OR doc_id = (SELECT min(doc_id) FROM objects)")
def prefix_by_bytes(spark, sf_dir):
    d = scan(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return P.byte_prefix(d, ["doc_id"], "size", 1_000_000)


@query(f"{O}, c AS (SELECT doc_id, size, sum(size) OVER (ORDER BY doc_id) AS cum FROM objects) SELECT doc_id, size FROM c WHERE cum - size < 1000000")
def prefix_by_bytes_inclusive(spark, sf_dir):
    d = scan(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return P.byte_prefix_inclusive(d, ["doc_id"], "size", 1_000_000)


@query("SELECT p_partkey FROM part ORDER BY md5('7:' || p_partkey) LIMIT 50")
def seeded_subset_md5(spark, sf_dir):
    return P.seeded_subset(scan(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 7, 50)


@query("SELECT p_partkey, lpad((row_number() OVER (ORDER BY p_partkey) - 1)::VARCHAR, 8, '0') AS index_name FROM part")
def sequential_index(spark, sf_dir):
    return P.numbered(scan(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"])


@query("SELECT s_suppkey AS shard_id, (row_number() OVER (ORDER BY s_suppkey) - 1) % 12 // 4 AS rank, (row_number() OVER (ORDER BY s_suppkey) - 1) % 12 % 4 AS worker FROM supplier")
def shard_assignment_mod(spark, sf_dir):
    s = P.assigned(scan(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("shard_id")), 3, 4)
    return s.select("shard_id", F.col("rank").cast("long").alias("rank"), F.col("worker").cast("long").alias("worker"))


@query("SELECT s_suppkey, ntile(9) OVER (ORDER BY s_suppkey) - 1 AS owner FROM supplier")
def slot_range_ntile(spark, sf_dir):
    return P.slot_split(scan(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 9).withColumn("owner", F.col("owner").cast("long"))


@query(f"""{O}, a AS (SELECT path, shard_id, 0 AS rank, (dense_rank() OVER (ORDER BY shard_id) - 1) % 4 AS worker FROM objects WHERE NOT deleted),
s AS (SELECT worker, shard_id, row_number() OVER (PARTITION BY worker ORDER BY md5('11:' || worker || ':' || shard_id)) - 1 AS so FROM (SELECT DISTINCT worker, shard_id FROM a)),
o AS (SELECT a.path, a.worker, so // 3 AS "window", row_number() OVER (PARTITION BY a.worker, so // 3 ORDER BY md5('11:' || (so // 3) || ':' || a.path), a.path) - 1 AS position FROM a JOIN s ON a.worker = s.worker AND a.shard_id = s.shard_id)
SELECT path, worker, "window", position, position // 256 AS batch FROM o""")
def hash_shuffle_batches(spark, sf_dir):
    o = catalog.live(T.objects(spark, sf_dir)).select("path", "shard_id")
    a = o.join(P.assigned(o.select("shard_id").distinct(), 1, 4).select("shard_id", "rank", "worker"), "shard_id")
    return P.shuffled_batches(a, 11).select("path", *[F.col(c).cast("long").alias(c) for c in ("worker", "window", "position", "batch")])


@query(f"{MU} SELECT path, arg_max(op, seq) AS op, arg_max(size, seq) AS size, max(seq) AS seq FROM mutations WHERE op <> 'rename' GROUP BY path")
def latest_version_per_path(spark, sf_dir):
    m = T.mutations(spark, sf_dir).where("op <> 'rename'").select("path", "op", "size", "seq")
    return P.latest(m, "path", "seq").select("path", "op", "size", "seq")


@query(f"{MU} SELECT seq, sum(CASE WHEN op = 'put' THEN 1 ELSE 0 END) OVER (ORDER BY seq)::BIGINT AS generation FROM mutations")
def generation_running_sum(spark, sf_dir):
    m = T.mutations(spark, sf_dir).select("seq", "op")
    return P.generation(m, "seq", F.col("op") == "put").select("seq", "generation")


# packing


def _pack_sql(condition: str, size: str = "strlen(text)") -> str:
    return f"""
WITH RECURSIVE o AS (SELECT doc_id, {size} AS size, row_number() OVER (ORDER BY doc_id) AS rn FROM documents),
f AS (
  SELECT rn, doc_id, size, 0::BIGINT AS shard, 512::BIGINT AS "offset", (512 + size + (512 - size % 512) % 512)::BIGINT AS at, size::BIGINT AS paid FROM o WHERE rn = 1
  UNION ALL
  SELECT o.rn, o.doc_id, o.size, f.shard + (CASE WHEN {condition} THEN 1 ELSE 0 END), CASE WHEN {condition} THEN 512 ELSE f.at + 512 END,
         CASE WHEN {condition} THEN 0 ELSE f.at END + 512 + o.size + (512 - o.size % 512) % 512, CASE WHEN {condition} THEN 0 ELSE f.paid END + o.size
  FROM f JOIN o ON o.rn = f.rn + 1
)
SELECT doc_id, size, shard, "offset" FROM f"""


CAP = 65_536


def _packed(spark, sf_dir, rule):
    d = scan(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return packing.pack(d, ["doc_id"], "doc_id", "size", rule, CAP)


@query(_pack_sql(f"f.at > 0 AND f.at + 512 + o.size + (512 - o.size % 512) % 512 > {CAP}"))
def pack_vacuum(spark, sf_dir):
    return _packed(spark, sf_dir, "vacuum")


@query(_pack_sql(f"f.at > 0 AND f.at + o.size + 512 > {CAP}"))
def pack_writer(spark, sf_dir):
    return _packed(spark, sf_dir, "writer")


@query(_pack_sql(f"f.paid > {CAP}"))
def pack_converter(spark, sf_dir):
    return _packed(spark, sf_dir, "converter")


@query(_pack_sql(f"f.at > 0 AND f.paid + o.size > {CAP}"))
def pack_flat(spark, sf_dir):
    return _packed(spark, sf_dir, "flat")


@query(f"""
WITH RECURSIVE o AS (SELECT doc_id, strlen(text) AS size, row_number() OVER (ORDER BY doc_id) AS rn FROM documents),
f AS (
  SELECT rn, doc_id, size, (-1)::BIGINT AS shard, 512::BIGINT AS "offset", (1024 + 512 + size + (512 - size % 512) % 512)::BIGINT AS e FROM o WHERE rn = 1
  UNION ALL
  SELECT o.rn, o.doc_id, o.size, f.shard - (CASE WHEN e + 512 + o.size + (512 - o.size % 512) % 512 > {CAP} THEN 1 ELSE 0 END), CASE WHEN e + 512 + o.size + (512 - o.size % 512) % 512 > {CAP} THEN 512 ELSE e + 512 END,
         CASE WHEN e + 512 + o.size + (512 - o.size % 512) % 512 > {CAP} THEN 0 ELSE e END + 1024 + 512 + o.size + (512 - o.size % 512) % 512
  FROM f JOIN o ON o.rn = f.rn + 1
)
SELECT doc_id, size, shard, "offset" FROM f""")
def delta_rotation(spark, sf_dir):
    d = scan(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return packing.rotate_deltas(d, ["doc_id"], "doc_id", "size", target=CAP)


# scalar functions


@query("""SELECT doc_id, sha1(text) AS digest FROM documents""")
def content_sha1(spark, sf_dir):
    return scan(spark, sf_dir, "documents").select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("digest"))


@query("""SELECT doc_id, length(text)::DOUBLE AS chars, len(list_distinct(string_split(text, '')))::DOUBLE AS kinds, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS spaces, length(source)::DOUBLE AS path FROM documents""")
def text_features(spark, sf_dir):
    counts = X.text_counts(F.col("text"), F.col("source"))
    return scan(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for c, n in zip(counts, ("chars", "kinds", "spaces", "path"))])


@query("""WITH b AS (SELECT vec_id, embedding AS e FROM embeddings) SELECT vec_id, len(list_concat(e, [0.0 FOR x IN range(80 - len(e))])[1:80])::INT AS n, round(list_sum(e)::DOUBLE, 3) AS total FROM b""")
def feature_pad_truncate(spark, sf_dir):
    e = scan(spark, sf_dir, "embeddings")
    v = X.fit(F.transform("embedding", lambda x: x.cast("double")), 80)
    return e.select("vec_id", F.size(v).alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("""WITH x AS (SELECT p_partkey, p_name, 'cls/' || p_brand || '/' || p_name || '.JPEG' AS path, p_size AS n FROM part)
SELECT p_partkey, '.jpeg' AS ext, p_name AS stem, p_brand AS parent, p_brand || '/' || p_name || '.JPEG' AS key, (512 + n + (512 - n % 512) % 512)::INT AS record, format('{:.2f}', n / 3) AS shown FROM x JOIN part USING (p_partkey, p_name)""")
def path_functions(spark, sf_dir):
    path = F.concat(F.lit("cls/"), F.col("p_brand"), F.lit("/"), F.col("p_name"), F.lit(".JPEG"))
    return scan(spark, sf_dir, "part").select("p_partkey", X.extension(path).alias("ext"), X.stem(path).alias("stem"), X.parent_name(path).alias("parent"), X.canonical_key(path).alias("key"), X.record_size(F.col("p_size")).alias("record"), X.fixed(F.col("p_size") / 3).alias("shown"))

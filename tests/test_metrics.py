import math

import pytest
from pyspark.sql import functions as F

from shardwright.functions import scalar as X
from shardwright.operators import metrics as M
from shardwright.operators import ordered as P
from shardwright.operators import report
from shardwright.plans.loader import LoaderSpec, resolved_parallelism


def test_percentiles(spark):
    df = spark.range(1, 101).select((F.col("id") / 1000.0).alias("v"), "id", F.lit("g").alias("g"))
    row = df.agg(*[M.percentile_or(F.col("v"), q, 0.0).alias(str(q)) for q in (0.5, 0.95, 0.99)]).first()
    assert [round(x * 1000, 2) for x in row] == [50.5, 95.05, 99.01]
    ring = M.ring_histogram(df, "g", "id", "v", 10).first()
    assert ring.n == 100 and ring.max == 0.1 and ring.p50 == pytest.approx(0.0955)
    none = df.where("false").agg(M.percentile_or(F.col("v"), 0.5, 0.0).alias("a"), M.percentile_or(F.col("v"), 0.5, float("nan")).alias("b")).first()
    assert none.a == 0 and math.isnan(none.b)


def test_epoch_stages(spark):
    df = spark.createDataFrame([("l", i, 4, 0.2, 0.3, 0.01, 0.25, 0.04) for i in range(2)], "loader string, batch_idx int, n int, fetch_s double, compute_s double, zero_grad_s double, forward_backward_s double, optimizer_s double")
    r = M.epoch_summary(df, ["loader"]).first()
    assert (r.wait_total_s, r.compute_total_s, round(r.wait_fraction, 6), r.forward_backward_fraction, round(r.optimizer_fraction, 6)) == (0.4, 0.6, 0.4, 0.5, 0.08)
    assert M.epoch_summary(df, ["loader"], warmup_batches=9).first().steady_throughput == 0


def test_throughput_choices(spark):
    df = spark.createDataFrame([("d", "1", "100", "120"), ("d", "2", "100", "140"), ("e", "1", "50", ""), ("e", "2", "70", "90"), ("e", "3", "x", "")], "loader string, seed string, throughput string, steady_throughput string")
    by = {r.loader: r for r in M.throughput_by(df, "loader", "throughput", "steady_throughput", "seed").collect()}
    assert by["d"]["mean"] == 130 and by["d"]["std"] == pytest.approx(14.142, abs=1e-3) and by["d"].n_seeds == 2 and by["e"]["mean"] == 70
    table = {r.loader: r for r in M.throughput_table(df, "loader", "throughput", "steady_throughput").collect()}
    assert table["e"]["mean"] == 90 and table["e"]["std"] == 0
    text = report.generate({"Runs": report.single_run(df.withColumn("wait_fraction", F.lit("0.1")).withColumn("fetch_p99", F.lit("")).withColumn("sys_rss_max", F.lit("1048576")))})
    assert "| d | 130.00 | 14.14 |" in text


def test_counter_rate(spark):
    df = spark.createDataFrame([("s", 0.0, 10), ("s", 0.5, None), ("s", 1.0, 30), ("s", 2.0, 5), ("z", 0.0, 1)], "series string, t double, c long")
    assert [(r.t, r.rate) for r in P.counter_rate(df, "series", "t", "c").orderBy("t").collect()] == [(1.0, 20.0), (2.0, 0.0)]


def test_system_series(spark):
    df = spark.createDataFrame([("s", 0.0, 20.0, 1000), ("s", 1.0, 35.0, 2097152)], "series string, t double, cpu double, disk long")
    r = M.series_summary(df, "series", "t", ["cpu"], ["disk"]).first()
    assert r.cpu_mean == 27.5 and r.disk_delta == 2096152 and r.disk_per_s == 2096152


def test_wait_compute_switch(spark):
    rows = [("a", "0.30", None, "0.55", "0.10"), ("b", "0.10", None, "0.70", "0.10"), ("c", None, "0.25", None, None), ("d", None, None, "0.1", None)]
    df = spark.createDataFrame(rows, "k string, steady_wait_fraction string, stall_fraction string, forward_backward_fraction string, optimizer_fraction string")
    got = {r.k: r for r in M.stage_values(df, "k").collect()}
    assert got["a"].other == pytest.approx(0.05) and got["b"].other == pytest.approx(0.1) and (got["c"].wait, got["c"].compute) == (0.25, 0.75) and "d" not in got


def test_slopes_and_gates(spark):
    df = spark.createDataFrame([("n", 0, 16.0), ("n", 1, 16.1), ("b", 0, 20.0), ("b", 1, 20.2), ("one", 0, 1.0)], "mode string, cycle int, rss double")
    assert {r["mode"]: round(r.slope, 6) for r in M.slope(df, "mode", "cycle", "rss").collect()} == {"n": 0.1, "b": 0.2, "one": 0.0}
    runs = spark.createDataFrame([("x", e, 100.0 - e, 50.0 + e) for e in range(20)], "g string, epoch int, tp double, rss double")
    row = M.stability(runs, "g", "epoch", "tp", "rss").first()
    assert row.retention == pytest.approx(82 / 98) and not row.stable


def test_sparse_cells_are_skipped(spark):
    df = spark.createDataFrame([("a", "1.0"), ("a", ""), ("b", "oops")], "loader string, x string")
    assert {r.loader: r.m for r in M.mean_of(df, ["loader"], {"m": "x"}).collect()} == {"a": 1.0, "b": None}


def test_prefixes_and_orders(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([5, 5, 5, 100, 1])], "i int, size long")
    assert [r.i for r in P.byte_prefix(df, ["i"], "size", 12).orderBy("i").collect()] == [0, 1]
    assert [r.i for r in P.byte_prefix(df, ["i"], "size", 1).collect()] == [0]
    assert [r.i for r in P.byte_prefix_inclusive(df, ["i"], "size", 12).orderBy("i").collect()] == [0, 1, 2]
    rows = spark.createDataFrame([(lab, f"{lab}{i}") for lab, n in (("a", 3), ("b", 1), ("c", 2)) for i in range(n)], "label string, path string")
    assert [r.path for r in P.balanced_first(rows, "label", "path", 5).collect()] == ["a0", "b0", "c0", "a1", "c1"]
    assert [r.index_name for r in P.numbered(rows, ["path"]).orderBy("path").collect()][:2] == ["00000000", "00000001"]


@pytest.mark.parametrize(("n", "k", "want"), [(9, 1, [9]), (9, 2, [5, 4]), (9, 3, [3, 3, 3]), (9, 4, [3, 2, 2, 2]), (9, 9, [1] * 9)])
def test_slot_split(spark, n, k, want):
    rows = P.slot_split(spark.range(n), "id", k).groupBy("owner").count().orderBy("owner").collect()
    assert [r["count"] for r in rows] == want


def test_every_shard_has_one_reader(spark):
    for shards in (1, 5, 11, 64):
        ids = spark.range(shards).withColumnRenamed("id", "shard_id")
        for world in (1, 3):
            for workers in (1, 4):
                rows = P.assigned(ids, world, workers).collect()
                assert len(rows) == shards and all(r.rank * workers + r.worker == r.position % (world * workers) for r in rows)
    assert [r.position for r in P.assigned(spark.range(11).withColumnRenamed("id", "shard_id"), 1, 4).where("worker = 1").collect()] == [1, 5, 9]


def test_scalars(spark):
    paths = ["a/b.txt", "", "/a", "../a", "a/../../b", "..a", "a/./b", "a\0b", ".", "a/..", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    assert [r.ok for r in df.orderBy("i").select(X.valid_logical_path(F.col("p")).alias("ok")).collect()] == [True, False, False, False, False, False, True, False, False, False, False]
    one = spark.range(1)
    row = one.select(
        X.pad_to_block(F.lit(100)).alias("pad"), X.record_size(F.lit(1024)).alias("rec"), X.extension(F.lit("x/y.tar.GZ")).alias("ext"), X.stem(F.lit("x/y.tar.GZ")).alias("stem"), X.stem(F.lit("x/.hidden")).alias("dot"),
        X.shard_number(F.lit("shard_-3")).alias("n"), X.shard_number(F.lit("shard_1.tmp")).alias("none"), X.flat_label(F.lit("0__cat__a__b")).alias("label"), X.fixed(F.lit(float("nan"))).alias("nan"), X.fixed(F.lit(1234.5)).alias("num"),
        X.human_bytes(F.lit(1536)).alias("kib"), X.image_kind(F.lit(b"\xff\xd8\xff\xe0")).alias("jpg"), X.image_kind(F.lit(b"GIF89a")).alias("gif"), X.replacement_payload(F.lit(7), F.lit(20)).alias("mut"),
        X.title_and_body(F.lit(" t"), F.lit("b \n")).alias("tb"), X.text_statistics(F.lit("aa b"), F.lit("xyz")).alias("stat"), X.lenient_double(F.lit(" "), 0.0).alias("zero"), X.row_label(F.lit(""), F.lit("m"), format=F.lit("f")).alias("row"),
        X.gigabytes(F.lit(0.5)).alias("gb"), X.canonical_key(F.lit("/r/cat/1.jpg")).alias("key"), X.steady_label(F.lit("abcde"), F.lit(None), F.lit(None), F.lit("p")).alias("sl"),
    ).first()
    assert (row.pad, row.rec, row.ext, row.stem, row.dot, row.n, row.none, row.label, row.nan, row.num) == (412, 1536, ".gz", "y.tar", ".hidden", -3, None, "cat", "", "1234.50")
    assert (row.kib, row.jpg, row.gif, row.tb, row.zero, row.row, row.gb, row.key, row.sl) == ("1.50 KiB", "jpg", "gif", "t\nb", 0.0, "m/f", 1 << 29, "cat/1.jpg", "1")
    assert bytes(row.mut) == b"MUT-00000007|" + bytes([7]) * 7 and row.stat == [4.0, 3.0, 1.0, 3.0, 0, 0, 0, 0]


def test_loader_spec():
    assert resolved_parallelism(LoaderSpec(workers=3), 8) == 2
    for bad in ({"workers": 0}, {"rank": 1}, {"seed": -1}, {"mode": "x"}, {"mode": "rgb_uint8"}, {"workers": 10, "max_workers": 9}, {"batch": 0}):
        with pytest.raises(ValueError):
            LoaderSpec(**bad)


def test_percentiles_of_any_group(spark):
    """Counted values and ranks give what Spark's percentile does, for groups of one value, repeated values, none and the null group."""
    rows = [("a", float(i * 7 % 50) / 3) for i in range(101)] + [("b", 2.5)] * 7 + [("c", 1.0), ("d", None), ("e", 1.0), ("e", 4.0), (None, 3.0), (None, 9.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    q = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: tuple(r)[1:] for r in M.percentiles(df, "g", "x", q, -1.0).collect()}
    want = {r.g: tuple(r)[1:] for r in df.groupBy("g").agg(*[M.percentile_or(F.col("x"), p, -1.0).alias(n) for n, p in q.items()]).collect()}
    assert all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want) and len(got) == 6 and got["d"] == (-1.0,) * 4

import pytest
from pyspark.sql import functions as F

from shardwright import catalog
from shardwright.operators import packing, sets, validate

OBJECTS = [("a.png", 0, 512, 100, False, b'{"label":"cat"}'), ("b.png", 1, 512, 200, True, b"{}"), ("c.png", 1, 824, 50, False, None)]
SHARDS = [(0, "base", 1234), (1, "base", 5678)]


def tables(spark, objects=OBJECTS, shards=SHARDS):
    return spark.createDataFrame(objects, catalog.OBJECTS), spark.createDataFrame(shards, catalog.SHARDS)


def test_manifest_round_trip(spark, tmp_path):
    o, s = tables(spark)
    path = f"file://{tmp_path}/metadata.parquet"
    catalog.write_manifest(o, s, path)
    for trusted in (True, False):
        objects, shards = catalog.read_manifest(spark, path, trusted)
        rows = {r.path: r for r in objects.collect()}
        assert len(rows) == 3 and shards.count() == 2 and bytes(rows["c.png"].object_metadata) == b"" and rows["b.png"].deleted
    got = catalog.fragmentation(objects, shards).first()
    assert got.dead_bytes == 200 and got.fragmentation == pytest.approx(200 / 6912)
    assert {r.path for r in catalog.live(objects).collect()} == {"a.png", "c.png"}
    meta = {r.path: r.label for r in catalog.metadata(objects).select("path", F.variant_get("meta", "$.label", "string").alias("label")).collect()}
    assert meta == {"a.png": "cat", "b.png": None, "c.png": None}


def test_empty_manifest_is_an_error(spark, tmp_path):
    spark.createDataFrame([], catalog.MANIFEST).write.parquet(f"{tmp_path}/m")
    with pytest.raises(catalog.EmptyManifest):
        catalog.read_manifest(spark, f"{tmp_path}/m")


def test_duplicate_paths_last_wins(spark, tmp_path):
    files = [("a", 0, 512, 1, False, b""), ("a", 0, 1536, 2, False, b"")]
    spark.createDataFrame([("1", [(0, "base", 2048)], files)], catalog.MANIFEST).write.parquet(f"{tmp_path}/m")
    objects, _ = catalog.read_manifest(spark, f"{tmp_path}/m", trusted=False)
    assert [r["size"] for r in objects.collect()] == [2]


def test_delta_cover_and_orphans(spark):
    o, s = tables(spark, [("c", -1, 512, 100, False, None), ("d", -1, 1224, 50, False, None), ("x", 9, 0, 1, False, None), ("e", -2, 512, 9, True, None)], [(0, "base", 1000), (-1, "delta", 0), (-2, "delta", 0)])
    got = {r.number: r.cover_size for r in catalog.served_shards(o, s).collect()}
    assert got == {0: 1000, -1: 1274}
    assert [r.path for r in catalog.orphans(o, s).collect()] == ["x"]


def test_profile_of_nothing(spark):
    o, s = tables(spark, [], [])
    row = catalog.profile(o, s).first()
    assert row.n_live == 0 and row.live_bytes == 0 and catalog.fragmentation(o, s).first().fragmentation == 0


def packed(spark, sizes, rule, target):
    df = spark.createDataFrame([(f"{i:03d}", n) for i, n in enumerate(sizes)], "path string, size long")
    return [(r.shard, r.offset) for r in packing.pack(df, ["path"], "path", "size", rule, target).orderBy("path").collect()]


def test_packing_rules(spark):
    assert packed(spark, [100, 100, 100], "writer", 700) == [(0, 512), (1, 512), (2, 512)]
    assert packed(spark, [10_000, 13_000], "vacuum", 100 << 20) == [(0, 512), (0, 11_264)]
    assert packed(spark, [60, 60, 60], "converter", 100) == [(0, 512), (0, 1536), (1, 512)]
    assert packed(spark, [60, 60, 60], "flat", 120) == [(0, 512), (0, 1536), (1, 512)]
    assert packed(spark, [5000, 10], "vacuum", 1000) == [(0, 512), (1, 512)]
    with pytest.raises(ValueError):
        packed(spark, [1], "other", 1)


def test_delta_rotation(spark):
    df = spark.createDataFrame([("a", 3)], "path string, size long")
    assert packing.rotate_deltas(df, ["path"], "path", "size", -1, 100 << 20).first().shard == -2
    assert packing.rotate_deltas(df, ["path"], "path", "size", -1, 0).first().offset == 512


def test_parallel_packing_keeps_the_rule(spark):
    df = spark.range(500).select(F.format_string("%05d", "id").alias("path"), (F.col("id") * 37 % 900).alias("size"))
    rows = packing.pack_ranges(df, ["path"], "path", "size", "vacuum", 8192, 4).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.path):
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(len(by))) and len(rows) == 500
    for own in by.values():
        end = 0
        for r in own:
            assert r.offset == end + 512
            end += 512 + r.size + -r.size % 512
        assert end <= 8192 or len(own) == 1


def test_epoch_consistency(spark):
    expected = spark.createDataFrame([(f"f{i}", f"d{i}") for i in range(6)], "path string, digest string")
    seen = spark.createDataFrame([("f0", "d0", 1), ("f1", "bad", 1), ("f2", "d2", 1), ("f2", "d2", 2), ("f3", "d3", 1), ("g", "x", 1), ("f4", "d4", 1)], "path string, digest string, generation int")
    assert {tuple(r) for r in sets.epoch_differences(expected, seen.drop("generation")).collect()} == {("f5", "missing"), ("g", "leaked"), ("f1", "wrong_content"), ("f2", "duplicate")}
    v = sets.violations(expected, seen, 1).first()
    assert (v.missing, v.leaked, v.duplicate, v.wrong_content, v.torn, v.wrong_generation, v.total) == (1, 1, 1, 1, 1, 1, 6)


def test_catalog_problems(spark):
    o, s = tables(spark, [("a", 0, 512, 100, False, None), ("b", 0, 900, 500, False, None), ("c", 7, 512, 1, False, None)], [(0, "base", 1024), (1, "base", 0), (2, "base", 50), (-1, "delta", 0)])
    files = spark.createDataFrame([("shard_0", 2048), ("shard_2", 10)], "name string, length long")
    got = {tuple(r) for r in validate.catalog_problems(o, s, files).collect()}
    assert got == {("b", "beyond the shard"), ("c", "unknown shard"), ("shard_1", "no file"), ("shard_1", "empty"), ("shard_2", "short file")}


def test_joins(spark):
    notes = spark.createDataFrame([("a.jpg", 2, "two", "val"), ("a.jpg", 1, "one", "test"), ("b.jpg", 1, "b", "")], "filename string, row_no int, caption string, split string")
    images = spark.createDataFrame([("a.jpg",), ("b.jpg",), ("c.jpg",)], "filename string")
    got = {r.filename: (r.captions, r.split) for r in sets.captions(images, notes).collect()}
    assert got == {"a.jpg": (["one", "two"], "val"), "b.jpg": (["b"], "train"), "c.jpg": ([], "train")}
    known = sets.label_index(spark.createDataFrame([("b",), ("a",)], "label string"), "label")
    rows = spark.createDataFrame([("a",), ("b",), ("z",)], "label string")
    assert [r.idx for r in sets.with_label_index(rows.where("label <> 'z'"), "label", known).orderBy("label").collect()] == [0, 1]
    with pytest.raises(Exception, match="unknown label z"):
        sets.with_label_index(rows, "label", known).collect()
    members = spark.createDataFrame([("x", "s1", b"1"), ("y", "s1", b"2"), ("z", "s2", b"3")], "name string, shard string, payload binary")
    new = spark.createDataFrame([("x", b"9")], "name string, payload binary")
    assert {r.name: bytes(r.payload) for r in sets.replace_in_shards(members, new).collect()} == {"x": b"9", "y": b"2"}
    with pytest.raises(KeyError):
        sets.replace_in_shards(members, spark.createDataFrame([("q", b"9")], "name string, payload binary"))
    assert sets.same_sequence(members.withColumn("i", F.lit(1)), members.withColumn("i", F.lit(1)), "i", "name")

"""Joins and set operations between expected and delivered data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def epoch_differences(expected: DataFrame, seen: DataFrame) -> DataFrame:
    """(path, problem): missing, leaked, duplicate (a row for each extra delivery) and wrong_content. Both have path and digest.

    One join by path carries all four."""
    e = expected.groupBy("path").agg(F.max("digest").alias("want")).withColumn("__e", F.lit(True))
    s = seen.groupBy(F.col("path").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("digest").alias("got"))
    both = e.join(s, F.col("path") == F.col("p"), "full_outer")
    path = F.coalesce("path", "p").alias("path")
    kinds = F.array_compact(
        F.array(
            F.when(F.col("p").isNull(), F.lit("missing")),
            F.when(F.col("__e").isNull(), F.lit("leaked")),
            F.when(F.col("__e") & (F.size("got") > 0) & F.exists("got", lambda d: d != F.col("want")), F.lit("wrong_content")),
        )
    )
    extra = F.when(F.col("n") > 1, F.array_repeat(F.lit("duplicate"), (F.col("n") - 1).cast("int"))).otherwise(F.array().cast("array<string>"))
    return both.select(path, F.explode(F.concat(kinds, extra)).alias("problem"))


def violations(expected: DataFrame, seen: DataFrame, generation: int | None = None) -> DataFrame:
    """One row: each kind of violation and their total. seen also has generation; torn counts more than one of them."""
    d = epoch_differences(expected, seen).agg(*[F.count_if(F.col("problem") == k).alias(k) for k in ("missing", "leaked", "duplicate", "wrong_content")])
    wrong = F.count_if(F.col("generation") != generation) if generation is not None else F.lit(0).cast("long")
    g = seen.agg(F.greatest(F.countDistinct("generation") - 1, F.lit(0)).alias("torn"), wrong.alias("wrong_generation"))
    out = d.crossJoin(g)
    return out.withColumn("total", sum((F.col(c) for c in out.columns[1:]), F.col(out.columns[0])))


def label_index(rows: DataFrame, label: str) -> DataFrame:
    """(label, idx) of the sorted distinct labels: a small table."""
    return rows.select(label).distinct().withColumn("idx", F.dense_rank().over(Window.orderBy(label)) - 1)


def with_label_index(rows: DataFrame, label: str, known: DataFrame) -> DataFrame:
    """rows with idx; a label that isn't known is an error."""
    joined = rows.join(known.select(F.col(label).alias("__l"), "idx"), F.col(label) == F.col("__l"), "left").drop("__l")
    return joined.withColumn("idx", F.coalesce("idx", F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(F.col(label).cast("string"), F.lit("null")))).cast("int")))


def captions(images: DataFrame, notes: DataFrame) -> DataFrame:
    """Images with their captions in order and split. notes: filename, row_no, caption, split. No captions is [], no split is train."""
    per = notes.groupBy("filename").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "caption"))), lambda x: x.caption).alias("captions"), F.max_by(F.nullif("split", F.lit("")), F.when(F.nullif("split", F.lit("")).isNotNull(), F.col("row_no"))).alias("split"))
    return images.join(per, "filename", "left").withColumn("captions", F.coalesce("captions", F.array().cast("array<string>"))).withColumn("split", F.coalesce("split", F.lit("train")))


def pair_sidecars(members: DataFrame) -> DataFrame:
    """Payload members with the JSON of the same archive and stem, in whatever order they stand. members: tar, name, stem, ext, offset, size, payload."""
    side = members.where("ext = '.json'").groupBy("tar", "stem").agg(F.max_by("payload", "offset").alias("json"))
    return members.where("ext <> '.json'").join(side, ["tar", "stem"], "left").withColumn("object_metadata", F.encode(F.get_json_object(F.decode("json", "UTF-8"), "$.annotations"), "UTF-8")).drop("json")


def replace_in_shards(members: DataFrame, replacements: DataFrame) -> DataFrame:
    """Members of the shards that a replacement touches, with new payloads; a name that no shard has is an error."""
    own = replacements.select(F.col("name").alias("__n"), F.col("payload").alias("__p"))
    missing = own.join(members, F.col("__n") == F.col("name"), "left_anti")
    if not missing.isEmpty():
        raise KeyError(missing.first()[0])
    touched = members.join(own, F.col("name") == F.col("__n"), "left_semi").select("shard").distinct()
    return members.join(touched, "shard", "left_semi").join(own, F.col("name") == F.col("__n"), "left").withColumn("payload", F.coalesce("__p", "payload")).drop("__n", "__p")


def overlay(points: DataFrame, t: str, intervals: DataFrame, bucket: float = 60.0) -> DataFrame:
    """Points with the intervals [start_s, end_s] that hold them: an equi join on time buckets, then the exact test."""
    keyed = points.withColumn("__b", F.floor(F.col(t) / bucket))
    spread = intervals.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start_s") / bucket), F.floor(F.col("end_s") / bucket))))
    return keyed.join(spread, "__b").where((F.col(t) >= F.col("start_s")) & (F.col(t) <= F.col("end_s"))).drop("__b")


def same_sequence(left: DataFrame, right: DataFrame, order: str, name: str) -> bool:
    """Whether two tables list the same names at the same places."""
    a, b = (df.select(order, name) for df in (left, right))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def union_rows(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; columns in the order in which they are first seen, missing cells null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def axis_product(spark, axes: dict[str, list]) -> DataFrame:
    """All combinations of axis values."""
    tables = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in axes.items()]
    return reduce(lambda a, b: a.crossJoin(b), tables)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1")


def stale_files(files: DataFrame, shards: DataFrame) -> DataFrame:
    """Shard files that no shard names, and temporary ones. files: name."""
    from ..functions.scalar import shard_number

    numbered = files.withColumn("__n", shard_number(F.col("name")))
    known = shards.select(F.col("number").alias("__k"))
    shardlike = F.col("name").startswith("shard_")
    return numbered.where(shardlike).join(known, F.col("__n").eqNullSafe(F.col("__k")), "left_anti").drop("__n")


def collected_labels(rows: DataFrame, label: str, extra: tuple[str, ...] = ("0", "1", "2", "3")) -> DataFrame:
    spark = rows.sparkSession
    return rows.select(F.col(label).alias("label")).union(spark.createDataFrame([(x,) for x in extra], "label string")).where("label is not null").distinct()


def replicate(df: DataFrame, replicas: int, path: str) -> DataFrame:
    """Each row replicas times: rep0000__path."""
    spark = df.sparkSession
    out = df.crossJoin(F.broadcast(spark.range(replicas).select(F.col("id").cast("int").alias("replica"))))
    return out.withColumn("logical_path", F.concat(F.lit("rep"), F.lpad(F.col("replica").cast("string"), 4, "0"), F.lit("__"), F.col(path)))


def with_cell_metrics(epochs: DataFrame, cells: DataFrame, keys: tuple[str, ...] = ("loader", "seed")) -> DataFrame:
    """Each epoch row with the metrics of its cell; rows without any keep nulls. Spark broadcasts cells where their size allows."""
    return epochs.join(cells, list(keys), "left")


def by_wait(shares: DataFrame, share: str, label: str) -> DataFrame:
    """Labels with their place by ascending share of waiting, equal ones by name."""
    from .ordered import numbered

    return numbered(shares, [share, label]).withColumn("place", F.col("index_name").cast("long")).drop("index_name")


def with_payload(adds: DataFrame, files: DataFrame) -> DataFrame:
    """Added objects (shard_id, offset, size) whose bytes are there; files: name, length of shard files."""
    from ..functions.scalar import shard_number

    there = files.select(shard_number(F.col("name")).alias("__n"), F.col("length").alias("__length"))
    return adds.join(there, F.col("shard_id") == F.col("__n")).where(F.col("__length") >= F.col("offset") + F.col("size")).drop("__n", "__length")

"""The mutation log: ordered records folded to the state of the catalog, in batches and as a stream.

A record has seq (total order), txn_id, ts, op ('add', 'delete', 'shard'), and one payload: `add`, an object; `delete`, a path; `shard`, a shard with its
objects. The fold by path is idempotent: the last record of a path decides, so replay may start at any checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog

SHARD = T.StructType([*catalog.SHARDS.fields, T.StructField("objects", T.ArrayType(catalog.OBJECTS))])
RECORDS = T.StructType(
    [
        T.StructField("seq", T.LongType()), T.StructField("txn_id", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("op", T.StringType()),
        T.StructField("add", catalog.OBJECTS), T.StructField("delete", T.StringType()), T.StructField("shard", SHARD),
    ]
)


def path_events(records: DataFrame) -> DataFrame:
    """(path, seq, ord, object): object is null for deletes. Objects of a shard record count in its list order."""
    adds = records.where("op = 'add'").select(F.col("add.path").alias("path"), "seq", F.lit(0).alias("ord"), F.col("add").alias("object"))
    deletes = records.where("op = 'delete'").select(F.col("delete").alias("path"), "seq", F.lit(0).alias("ord"), F.lit(None).cast(catalog.OBJECTS).alias("object"))
    whole = records.where("op = 'shard'").select("seq", F.posexplode("shard.objects").alias("ord", "object")).select(F.col("object.path").alias("path"), "seq", "ord", "object")
    return adds.unionByName(deletes).unionByName(whole)


def fold(records: DataFrame) -> DataFrame:
    """(path, seq, object) of the last event of each path; partial aggregates before the shuffle."""
    return path_events(records).groupBy("path").agg(F.max("seq").alias("seq"), F.max_by("object", F.struct("seq", "ord")).alias("object"))


def replay(objects: DataFrame, shards: DataFrame, records: DataFrame, as_of: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(objects, shards) after the records up to as_of. Deleted paths stay as tombstones; deltas that an add names are made on demand."""
    if as_of is not None:
        records = records.where(F.col("seq") <= as_of)
    last = fold(records).select(F.col("path").alias("__p"), F.col("object").alias("__o"), F.lit(True).alias("__hit"))
    both = objects.join(last, F.col("path") == F.col("__p"), "full_outer")
    gone = F.col("__hit") & F.col("__o").isNull()
    cell = lambda c: F.when(F.col("__o").isNotNull(), F.col(f"__o.{c}")).otherwise(F.col(c)).alias(c)
    state = both.where(F.col("path").isNotNull() | F.col("__o").isNotNull()).select(
        F.coalesce("path", "__p").alias("path"), cell("shard_id"), cell("offset"), cell("size"), F.when(gone, True).when(F.col("__o").isNotNull(), False).otherwise(F.col("deleted")).alias("deleted"), cell("object_metadata")
    )
    added = records.where("op = 'shard'").select(F.col("shard.number").alias("number"), F.col("shard.type").alias("type"), F.col("shard.total_size").alias("total_size"), "seq")
    named = records.where("op = 'add'").select(F.col("add.shard_id").alias("number"), F.expr("add.offset + add.size + pmod(-add.size, 512)").alias("end")).groupBy("number").agg(F.max("end").alias("end"))
    known = shards.select("number", "type", "total_size", F.lit(-1).cast("long").alias("seq")).unionByName(added).groupBy("number").agg(F.max_by(F.struct("type", "total_size"), "seq").alias("s"))
    merged = known.join(named, "number", "full_outer")
    size = F.greatest(F.coalesce("s.total_size", F.lit(0)), F.when(F.col("number") < 0, F.coalesce("end", F.lit(0))).otherwise(0))
    return state, merged.select("number", F.coalesce("s.type", F.when(F.col("number") < 0, "delta").otherwise("base")).alias("type"), size.cast("long").alias("total_size"))


def generations(records: DataFrame, objects: DataFrame, strict: bool = False) -> DataFrame:
    """records with the generation after each. A delete of a path that doesn't live raises nothing and counts nothing, unless strict."""
    from pyspark.sql import Window

    from ..operators.ordered import running

    events = path_events(records).groupBy("seq", "path").agg(F.max_by(F.col("object").isNotNull(), "ord").alias("live"))
    start = objects.select("path", (~F.col("deleted")).alias("was"))
    before = F.lag("live").over(Window.partitionBy("path").orderBy("seq"))
    seen = events.join(start, "path", "left").withColumn("before", F.coalesce(before, "was", F.lit(False)))
    effective = seen.groupBy("seq").agg(F.max(F.when(F.col("live") | F.col("before"), 1).otherwise(0)).alias("e"), F.min_by("path", "live").alias("p"))
    if strict:
        effective = effective.withColumn("e", F.when(F.col("e") == 0, F.raise_error(F.concat(F.lit("no such path: "), F.col("p"))).cast("int")).otherwise(F.col("e")))
    return running(effective.select("seq", "e"), ["seq"], "e", "generation").select("seq", "generation")


def rename_records(ops: DataFrame) -> DataFrame:
    """(seq, path, live, size) events of put, delete and rename rows (seq, op, path, target, size) in log order.

    A rename of a live path ends it and gives the target what it had; one of a dead path, or of a path to itself, does nothing. What a path holds just before a rename is
    decided by its last event, a constant for puts, deletes and renames away from it (which leave it dead in any case), and for a rename onto it
    either what that rename brought or, if its source was dead, what stood there before. So each rename points to at most two earlier ones, and each round settles
    those that point to settled ones; rounds are as many as renames follow one another on one object's way, whatever the length of the log."""
    from pyspark.sql import Window

    from ..storage import materialize

    value = "struct<live:boolean,size:bigint>"
    dead = F.struct(F.lit(False).alias("live"), F.lit(None).cast("long").alias("size")).cast(value)
    facts = ops.where("op <> 'rename'").select("seq", "path", F.when(F.col("op") == "put", F.struct(F.lit(True).alias("live"), F.col("size").cast("long").alias("size")).cast(value)).otherwise(dead).alias("v"))
    moves = ops.where("op = 'rename' and path <> target").select("seq", "path", "target")
    none = F.lit(None).cast("long")
    # events by path: a value, or the rename that decides it; asks look back from just before
    events = facts.select("path", "seq", F.col("v"), none.alias("by"), F.lit(True).alias("event"), F.lit(None).cast("string").alias("role"))
    events = events.unionByName(moves.select("path", "seq", dead.alias("v"), none.alias("by"), F.lit(True).alias("event"), F.lit("source").alias("role")))
    events = events.unionByName(moves.select(F.col("target").alias("path"), "seq", F.lit(None).cast(value).alias("v"), F.col("seq").alias("by"), F.lit(True).alias("event"), F.lit("target").alias("role")))
    back = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumn("before", F.last(F.struct("v", "by")).over(back)).where("role is not null")
    one = lambda r, n: F.first(F.when(F.col("role") == r, F.struct(F.lit(True).alias("here"), F.col("before.v").alias("v"), F.col("before.by").alias("by"))), ignorenulls=True).alias(n)
    known = seen.groupBy("seq").agg(one("source", "s"), one("target", "t"))
    # s: what the source held; t: what the target held; each a value (dead where there was nothing) or the number of a rename
    settle = lambda c: F.when(F.col(f"{c}.by").isNull(), F.coalesce(F.col(f"{c}.v"), dead))
    open_ = materialize(known.select("seq", settle("s").alias("sv"), F.col("s.by").alias("sb"), settle("t").alias("tv"), F.col("t.by").alias("tb")), "renames")
    # r: what the source held, once it is known; a: what the target holds after it
    outcome = F.when(F.col("sv.live"), F.col("sv")).when(F.col("sv").isNotNull() & F.col("tv").isNotNull(), F.col("tv"))
    while True:
        state = open_.withColumn("a", outcome)
        done = state.where("a is not null").select(F.col("seq").alias("k"), F.col("a").alias("av"))
        # merge: compressed, these tables look small enough to be sent through the driver in each round
        left = state.join(done.withColumnsRenamed({"k": "sb", "av": "sa"}).hint("merge"), "sb", "left").join(done.withColumnsRenamed({"k": "tb", "av": "ta"}).hint("merge"), "tb", "left")
        open_ = materialize(left.select("seq", F.coalesce("sv", "sa").alias("sv"), "sb", F.coalesce("tv", "ta").alias("tv"), "tb"), "renames")
        if open_.where("sv is null").isEmpty():
            break
    found = moves.join(open_.select("seq", F.col("sv").alias("v")).hint("merge"), "seq").where("v.live")
    ended = found.select("seq", "path", F.lit(False).alias("live"), F.lit(None).cast("long").alias("size"))
    made = found.select("seq", F.col("target").alias("path"), F.lit(True).alias("live"), F.col("v.size").alias("size"))
    return facts.select("seq", "path", "v.live", "v.size").unionByName(ended).unionByName(made)


def snapshot_as_of(events: DataFrame, seq: int) -> DataFrame:
    """(path, size) that live after the events up to seq."""
    last = events.where(F.col("seq") <= seq).groupBy("path").agg(F.max_by(F.struct("live", "size"), F.struct("seq", "live")).alias("s"))
    return last.where("s.live").select("path", F.col("s.size").alias("size"))


# stream


def read_log_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Commit files as a stream of records; files_per_trigger limits the rate."""
    reader = spark.readStream.schema(RECORDS).option("mode", "FAILFAST")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def maintain(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Merge each micro-batch into a state; a batch may come twice, so merge must be idempotent by seq."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_paths_stream(stream: DataFrame) -> DataFrame:
    """The last event of each path as a stateful aggregate (update mode): keyed by path, order by seq, no watermark as seq is total."""
    return path_events(stream).groupBy("path").agg(F.max("seq").alias("seq"), F.max_by(F.col("object").isNotNull(), F.struct("seq", "ord")).alias("live"), F.max_by("object.size", F.struct("seq", "ord")).alias("size"))


def windowed_rates(stream: DataFrame, ts: str, key: str, size: str, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events and bytes per window and key, late rows up to the watermark."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "bytes")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def torn(generation: Column) -> Column:
    """Whether an epoch saw more than one generation."""
    return F.countDistinct(generation) != 1

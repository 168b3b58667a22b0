"""Operators over an order: rates, prefixes, versions, assignment, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counter_rate(points: DataFrame, series: str, t: str, counter: str) -> DataFrame:
    """(series, t, rate): increase per second since the point before; blanks are skipped, resets count 0, first points go."""
    w = Window.partitionBy(series).orderBy(t)
    own = points.where(F.col(counter).isNotNull()).select(series, t, (F.col(counter) - F.lag(counter).over(w)).alias("__d"), (F.col(t) - F.lag(t).over(w)).alias("__dt"))
    return own.where("__d is not null").select(series, t, (F.greatest(F.lit(0.0), F.col("__d")) / F.greatest(F.col("__dt"), F.lit(1e-9))).alias("rate"))


def relative_time(points: DataFrame, group: str, t: str) -> DataFrame:
    return points.withColumn("rel_t", F.col(t) - F.min(t).over(Window.partitionBy(group)))


def last_n(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The newest n rows of each group."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("__rn") <= n).drop("__rn")


def running(df: DataFrame, order: list[str], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """df with the sum of value up to and with each row, in one global order, without one big sort.

    Rows are range-partitioned; each partition adds the totals of those before it. The order columns should be unique."""
    from ..storage import materialize

    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "running")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    offsets = ranged.groupBy(F.col("__part").alias("__p")).agg(F.sum(value).alias("__s")).withColumn("__o", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), F.col("__part") == F.col("__p"))
    return out.withColumn(name, F.sum(value).over(inside) + F.col("__o")).drop("__part", "__p", "__o")


def byte_prefix(df: DataFrame, order: list[str], size: str, limit: int) -> DataFrame:
    """Rows while the total stays within limit; the first one always."""
    first = df.agg(F.min(F.struct(*order)).alias("f"))
    out = running(df, order, size, "__cum").crossJoin(F.broadcast(first))
    return out.where((F.col("__cum") <= limit) | (F.struct(*order) == F.col("f"))).drop("__cum", "f")


def byte_prefix_inclusive(df: DataFrame, order: list[str], size: str, limit: int) -> DataFrame:
    """Rows until the total reaches limit; the row that crosses it stays."""
    return running(df, order, size, "__cum").where(F.col("__cum") - F.col(size) < limit).drop("__cum")


def stratified_order(df: DataFrame, label: str, path: str) -> DataFrame:
    """df with (turn, label) as its order: the i-th item of every label, then the next."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(label).orderBy(path)) - 1)


def balanced_first(df: DataFrame, label: str, path: str, n: int) -> DataFrame:
    """The first n rows of the stratified order (top-k, no global sort)."""
    return stratified_order(df, label, path).orderBy("turn", label).limit(n)


def numbered(df: DataFrame, order: list[str], digits: int = 8, name: str = "index_name") -> DataFrame:
    """df with a running number in fixed digits."""
    one = df.withColumn("__one", F.lit(1))
    return running(one, order, "__one", "__i").withColumn(name, F.lpad((F.col("__i") - 1).cast("string"), digits, "0")).drop("__one", "__i")


def latest(records: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key; partial aggregates, no sort."""
    own = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*own), order).alias("r")).select(key, "r.*")


def generation(records: DataFrame, order: str, effective: Column) -> DataFrame:
    """records with the generation after each: one more for every effective one."""
    return running(records.withColumn("__e", F.when(effective, 1).otherwise(0)), [order], "__e", "generation").drop("__e")


def reader_of(position: Column, world: int, workers: int) -> Column:
    """Reader of the shard at a sorted position: struct(rank, worker)."""
    r = F.pmod(position, F.lit(world * workers))
    return F.struct((F.floor(r / workers)).cast("int").alias("rank"), F.pmod(r, F.lit(workers)).cast("int").alias("worker"))


def assigned(shards: DataFrame, world: int, workers: int) -> DataFrame:
    """Shards with position, rank and worker; each shard has exactly one reader. The shard list is the small table of a session."""
    placed = shards.withColumn("position", F.row_number().over(Window.orderBy("shard_id")) - 1)
    return placed.withColumn("__r", reader_of(F.col("position"), world, workers)).select(*placed.columns, "__r.*")


def slot_split(slots: DataFrame, order: str, workers: int) -> DataFrame:
    """Contiguous split; the first workers get one more where it doesn't divide."""
    return slots.withColumn("owner", F.ntile(workers).over(Window.orderBy(order)) - 1)


def shuffle_key(seed: int, *parts: Column) -> Column:
    """A seeded random order that any engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def shuffled_batches(samples: DataFrame, seed: int, window_shards: int = 3, batch: int = 256) -> DataFrame:
    """The order of an epoch. samples: rank, worker, shard_id, path.

    Shards of a worker go in seeded order, three at a time form a window, samples of a window go in seeded order, and batches of 256 never
    cross a window. All windows are of one worker and at most window_shards shards, so no sort sees the data set."""
    shards = samples.select("rank", "worker", "shard_id").distinct()
    order = Window.partitionBy("rank", "worker").orderBy(shuffle_key(seed, F.col("worker"), F.col("shard_id")))
    placed = shards.withColumn("shard_order", F.row_number().over(order) - 1).withColumn("window", F.floor(F.col("shard_order") / window_shards).cast("int"))
    inside = Window.partitionBy("rank", "worker", "window").orderBy(shuffle_key(seed, F.col("window"), F.col("path")), "path")
    out = samples.join(placed, ["rank", "worker", "shard_id"]).withColumn("position", F.row_number().over(inside) - 1)
    return out.withColumn("batch", F.floor(F.col("position") / batch).cast("int"))


def seeded_subset(df: DataFrame, path: str, seed: int, n: int) -> DataFrame:
    """n random rows, the same for the same seed."""
    return df.orderBy(shuffle_key(seed, F.col(path)), path).limit(n)


def config_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows in the order of a configured list, others after it by name."""
    position = F.array_position(F.array(*[F.lit(x) for x in order]).cast("array<string>"), F.col(column))
    return df.orderBy(F.when(position > 0, position).otherwise(F.lit(len(order) + 1)), column)

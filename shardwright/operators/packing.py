"""Greedy packing of objects into shards: four rules of when a shard is full, one fold.

The fold's state is (shard, bytes), so it is inherently sequential; `pack` runs it over (order, size) only, about 50 bytes an object, streamed through
one task behind a shuffle, so that the scan stays parallel. `pack_ranges`, which the engine uses, is the form for data sets too large for that: it folds range partitions independently and numbers
their shards by a prefix sum, at the cost of one short shard per partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

RULES = ("vacuum", "writer", "converter", "flat")
TARGET = 100 << 20


def fold(sizes: np.ndarray, rule: str, target: int, state: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """(shard of each object, its offset, state).

    vacuum: roll when the record would pass target and the shard isn't empty. writer: the same without padding. converter: append, roll when the payload bytes exceed
    target. flat: roll when payload bytes would exceed target and the shard isn't empty. Offsets are those of payloads in a tar: behind a 512-byte header, records padded to 512.
    converter and flat count payload bytes, so their state is payload and tar extent."""
    shard, filled = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    now, at = state[:2]
    paid = state[2] if len(state) > 2 else 0
    for i, n in enumerate(sizes.tolist()):
        record = 512 + n + -n % 512
        if rule == "vacuum":
            full = at > 0 and at + record > target
        elif rule == "writer":
            full = at > 0 and at + n + 512 > target
        elif rule == "flat":
            full = at > 0 and paid + n > target
        else:
            full = paid > target
        if full:
            now, at, paid = now + 1, 0, 0
        shard[i], filled[i] = now, at + 512
        at += record
        paid += n
    return shard, filled, (now, at, paid)


def _packer(rule: str, target: int):
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def pack(batches):
        state = (0, 0, 0)
        for batch in batches:
            sizes = np.asarray(batch.column(batch.num_columns - 1))
            shard, offset, state = fold(sizes, rule, target, state)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(offset)], names=[*batch.schema.names, "shard", "offset"])

    return pack


def pack(df: DataFrame, order: list[str], key: str, size: str, rule: str = "vacuum", target: int = TARGET) -> DataFrame:
    """(key, size, shard, offset) by the exact sequential rule."""
    slim = df.select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.col(key), F.col(size).cast("long").alias("size"))
    own = slim.repartition(1).sortWithinPartitions(*[f"__o{i}" for i in range(len(order))]).select(key, "size")
    schema = own.withColumns({"shard": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return own.mapInArrow(_packer(rule, target), schema)


def pack_ranges(df: DataFrame, order: list[str], key: str, size: str, rule: str = "vacuum", target: int = TARGET, partitions: int | None = None) -> DataFrame:
    """As pack, in parallel: a short shard may end each partition, every other rule holds."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = [f"__o{i}" for i in range(len(order))]
    slim = df.select(*[F.col(c).alias(a) for c, a in zip(order, at)], F.col(key).alias("__key"), F.col(size).cast("long").alias("size"))
    own = slim.repartitionByRange(n, *at).sortWithinPartitions(*at).select("__key", F.spark_partition_id().alias("__part"), "size")
    schema = own.withColumns({"shard": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    packed = materialize(own.mapInArrow(_packer(rule, target), schema), "packed")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = packed.groupBy(F.col("__part").alias("__p")).agg((F.max("shard") + 1).alias("n")).withColumn("__o", F.coalesce(F.sum("n").over(before), F.lit(0)))
    out = packed.join(F.broadcast(offsets), F.col("__part") == F.col("__p"))
    return out.select(F.col("__key").alias(key), "size", (F.col("shard") + F.col("__o")).alias("shard"), "offset")


def rotate_deltas(df: DataFrame, order: list[str], key: str, size: str, first: int = -1, filled: int = 0, target: int = TARGET) -> DataFrame:
    """(key, size, shard, offset) of appended objects: delta shards count down; each append is a record and a 1024-byte trailer."""
    slim = df.select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.col(key), F.col(size).cast("long").alias("size"))
    own = slim.repartition(1).sortWithinPartitions(*[f"__o{i}" for i in range(len(order))]).select(key, "size")

    def append(batches):
        shard, end = first, filled
        for batch in batches:
            ids, offsets = [], []
            for n in batch.column(1).to_pylist():
                record = 512 + n + -n % 512
                if end and end + record > target:
                    shard, end = shard - 1, 0
                ids.append(shard)
                offsets.append(end + 512)
                end += record + 1024
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], names=[*batch.schema.names, "shard", "offset"])

    return own.mapInArrow(append, own.withColumns({"shard": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema)


def shard_totals(packed: DataFrame) -> DataFrame:
    """(shard, n_objects, total_size): extents without the tar trailer."""
    return packed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_objects"), F.max(F.expr("offset + size + pmod(-size, 512)")).alias("total_size"))

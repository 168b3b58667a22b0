"""Loading plans: what a reader of an epoch gets, in which order, in which batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..operators import ordered

MODES = ("raw", "rgb_uint8")


@dataclass(frozen=True)
class LoaderSpec:
    """Parameters of a session; wrong ones raise ValueError."""

    workers: int = 1
    rank: int = 0
    world: int = 1
    seed: int = 0
    epoch: int = 0
    mode: str = "raw"
    image_size: int = 0
    batch: int = 256
    window_shards: int = 3
    parallelism: int | None = None
    max_workers: int | None = None
    timeout_s: float = 30.0

    def __post_init__(self) -> None:
        checks = (
            (self.workers >= 1 and (self.max_workers is None or self.workers <= self.max_workers), "workers"), (self.world >= 1, "world"), (0 <= self.rank < self.world, "rank"), (self.seed >= 0, "seed"), (self.epoch >= 0, "epoch"),
            (self.mode in MODES, "mode"), (self.mode == "raw" or self.image_size > 0, "image_size"), (self.batch >= 1, "batch"), (self.window_shards >= 1, "window_shards"), (self.parallelism is None or self.parallelism >= 1, "parallelism"), (self.timeout_s > 0, "timeout_s"),
        )
        for good, name in checks:
            if not good:
                raise ValueError(f"{name}={getattr(self, name)!r}")


def resolved_parallelism(spec: LoaderSpec, cores: int) -> int:
    return spec.parallelism or max(1, cores // spec.workers)


def epoch_plan(objects: DataFrame, shards: DataFrame, spec: LoaderSpec, all_ranks: bool = False) -> DataFrame:
    """Live objects with rank, worker, window, position and batch. Each object has one reader; the order depends on seed and epoch alone."""
    served = catalog.served_shards(objects, shards).select(F.col("number").alias("shard_id"))
    readers = ordered.assigned(served, spec.world, spec.workers).select("shard_id", "rank", "worker")
    if not all_ranks:
        readers = readers.where(F.col("rank") == spec.rank)
    own = catalog.live(objects).join(readers, "shard_id")
    return ordered.shuffled_batches(own, spec.seed + 1_000_003 * spec.epoch, spec.window_shards, spec.batch)


def decoded(samples: DataFrame, decode: Callable[[bytes], bytes | None], payload: str = "payload") -> DataFrame:
    """samples with the payload decoded; those whose decoder gives None or fails are left out, all others keep their place."""
    import pyarrow as pa

    at = samples.columns.index(payload)

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column(at).to_pylist():
                try:
                    out.append(decode(raw))
                except Exception:  # a broken sample is skipped, as documented
                    out.append(None)
            column = pa.array(out, pa.binary())
            yield batch.set_column(at, batch.schema.names[at], column).filter(column.is_valid())

    return samples.mapInArrow(run, samples.schema)


def merged(samples: DataFrame, generation: int) -> DataFrame:
    """samples with generation and the metadata by shape: meta (objects), annotations (arrays), meta_raw (other values)."""
    v = F.try_parse_json(F.nullif(F.decode("object_metadata", "UTF-8"), F.lit("")))
    kind = F.schema_of_variant(v)
    return samples.withColumns({"generation": F.lit(generation), "meta": F.when(kind.startswith("OBJECT"), v), "annotations": F.when(kind.startswith("ARRAY"), v), "meta_raw": F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "VOID"), v)})


def iterate(plan: DataFrame, order: tuple[str, ...] = ("rank", "worker", "window", "position")) -> Iterator[list]:
    """Batches of rows in order, one partition at a time on the driver; the end of the iterator is the end of the epoch."""
    held, key = [], None
    for row in plan.orderBy(*order).toLocalIterator(prefetchPartitions=True):
        now = (row.rank, row.worker, row.window, row.batch)
        if key is not None and now != key:
            yield held
            held = []
        key = now
        held.append(row)
    if held:
        yield held


def collate(samples: DataFrame, features: str, label: str, batch: str = "batch") -> DataFrame:
    """One row per batch: features and labels in order of position."""
    each = F.sort_array(F.collect_list(F.struct("position", F.col(features).alias("x"), F.col(label).alias("y"))))
    return samples.groupBy("worker", "window", batch).agg(each.alias("s")).select("worker", "window", batch, F.col("s.x").alias("x"), F.col("s.y").alias("y"))

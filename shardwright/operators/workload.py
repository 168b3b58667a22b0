"""Workloads as tables: mutation plans, experiment cells, and the cases that run them against an engine."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import flat_label, replacement_payload
from . import sets
from .ordered import seeded_subset, shuffle_key

KINDS = ("add", "delete", "replace")


def random_mutations(spark: SparkSession, victims: DataFrame, n: int, seed: int, kind: str = "mixed", size: int = 1024) -> DataFrame:
    """(i, op, path, payload): the op by hash of i, the victim by seeded order; adds make new names. A victim serves once."""
    i = spark.range(n).withColumnRenamed("id", "i")
    pick = F.pmod(F.conv(F.substring(shuffle_key(seed, F.col("i")), 1, 8), 16, 10).cast("long"), F.lit(len(KINDS)))
    op = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (pick + 1).cast("int")) if kind == "mixed" else F.lit(kind)
    from .ordered import numbered

    order = numbered(victims.select("path").withColumn("k", shuffle_key(seed, F.col("path"))), ["k", "path"]).select(F.col("index_name").cast("long").alias("i"), F.col("path").alias("victim"))
    out = i.withColumn("op", op).join(order, "i", "left")
    path = F.when(F.col("op") == "add", F.concat(F.lit("m"), F.lpad(F.col("i").cast("string"), 8, "0"), F.lit("__added"))).otherwise(F.col("victim"))
    return out.select("i", "op", path.alias("path"), F.when(F.col("op") != "delete", replacement_payload(F.col("i"), F.lit(size))).alias("payload")).where("path is not null")


def fixed_deletes(victims: DataFrame, n: int, seed: int) -> DataFrame:
    return seeded_subset(victims.select("path"), "path", seed, n).withColumn("op", F.lit("delete"))


def planned_replacements(names: DataFrame, n: int, seed: int, size: int) -> DataFrame:
    """(path, i, payload) of n names; more than there are is an error."""
    there = names.count()
    if n > there:
        raise ValueError(f"{n} replacements of {there} names")
    from .ordered import numbered

    chosen = numbered(seeded_subset(names.select("path"), "path", seed, n), ["path"]).withColumn("i", F.col("index_name").cast("long"))
    return chosen.select("path", "i", replacement_payload(F.col("i"), F.lit(size)).alias("payload"))


def payload_pool(objects: DataFrame, limit: int, seed: int) -> DataFrame:
    """The first objects of a seeded order with the label in their flat name."""
    return seeded_subset(objects, "path", seed, limit).withColumn("label", flat_label(F.col("path")))


def cells(spark: SparkSession, axes: dict[str, list], seeds: list[int], overrides: dict | None = None) -> DataFrame:
    """One row per cell and seed; overrides are further columns."""
    out = sets.axis_product(spark, {**axes, "seed": seeds})
    return out.withColumns({k: F.lit(v) for k, v in (overrides or {}).items()})


def run_cells(table: DataFrame, run: Callable[[dict], list[dict]], skip: type[Exception]) -> list[dict]:
    """Rows of all cells; a cell whose format is absent or that fails keeps a row with its status."""
    out = []
    for cell in table.toLocalIterator():
        given = cell.asDict()
        try:
            out += [{**given, **r, "status": "ok"} for r in run(given)]
        except skip as e:
            out.append({**given, "status": "missing", "detail": str(e)})
        except Exception as e:  # the row keeps the failure
            out.append({**given, "status": "error", "detail": f"{type(e).__name__}: {e}"})
    return out


def drain(session, epoch: int = 0) -> DataFrame:
    """(path, digest, generation) of an epoch with payloads."""
    return session.plan(epoch, payload=True).select("path", F.sha1("payload").alias("digest"), "generation")


def mutation_case(engine, spec, mutate: Callable) -> dict:
    """A session reads, mutations commit meanwhile, the session reads again: violations against its pinned state, and latencies."""
    from ..storage import materialize

    with engine.open(spec) as session:
        before = materialize(drain(session), "before")
        times, failed = [], 0
        for change in mutate(engine):
            start = time.perf_counter()
            try:
                change()
            except (ValueError, OSError):
                failed += 1
            times.append(time.perf_counter() - start)
        row = sets.violations(before.select("path", "digest"), drain(session), session.generation).first().asDict()
    n = max(1, len(times))
    return {**row, "attempted": len(times), "failed": failed, "mean_latency_s": sum(times) / n, "max_latency_s": max(times, default=0.0)}


def endurance_case(engine, spec, mutate: Callable, rounds: int) -> list[dict]:
    return [{"round": i, **mutation_case(engine, spec, mutate)} for i in range(rounds)]


def memory_case(engine, spec, cycles: int, rss: Callable[[], float], mutate: Callable | None = None) -> list[dict]:
    """Drained epochs with the memory after each."""
    out = []
    for c in range(cycles):
        start = time.perf_counter()
        with engine.open(spec) as session:
            n = drain(session, c).count()
        if mutate:
            mutate(engine)
        out.append({"cycle": c, "samples": n, "drain_s": time.perf_counter() - start, "rss_mib": rss()})
    return out


def nested_prefixes(files: DataFrame, label: str, path: str, sizes: list[int]) -> dict[int, DataFrame]:
    """Prefixes of the stratified order: each holds the smaller ones."""
    from .ordered import balanced_first

    return {n: balanced_first(files, label, path, n) for n in sizes}


def compare_scenarios(base: Callable, scenarios: dict[str, Callable]) -> list[dict]:
    """Each scenario on a data set of its own made by base(): changes, then compaction; one row of figures each."""
    out = []
    for name, change in scenarios.items():
        engine = base()
        change(engine)
        before, start = engine.fragmentation(), time.perf_counter()
        out.append({"scenario": name, "fragmentation": before, **engine.vacuum(), "vacuum_s": time.perf_counter() - start})
    return out

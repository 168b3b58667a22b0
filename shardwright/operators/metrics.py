"""Aggregates of measurements: percentiles, throughput, shares, slopes, tables by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import lenient_double


def guarded(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole isn't positive."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def percentile_or(value: Column, p: float, empty: float) -> Column:
    """Percentile with linear interpolation; `empty` for no values (0 for service metrics, NaN for training)."""
    return F.coalesce(F.percentile(value, F.lit(p)), F.lit(empty))


def percentiles(rows: DataFrame, group: str, value: str, quantiles: dict[str, float], empty: float) -> DataFrame:
    """(group, a column for each quantile) as percentile_or, for groups of any size: no task holds the values of a group.

    Equal values are counted first; ranks are running sums of the counts over ranges of (group, value), and a quantile lies between the values at two ranks."""
    from .ordered import running

    own = rows.select(F.col(group).alias("__g"), F.col(value).cast("double").alias("__x"))
    upto = running(own.groupBy("__g", "__x").agg(F.count("__x").alias("__c")), ["__g", "__x"], "__c", "__upto")
    groups = upto.groupBy("__g").agg(F.sum("__c").alias("__n"), F.min(F.col("__upto") - F.col("__c")).alias("__first"))
    ranked = upto.where("__c > 0").join(groups.withColumnRenamed("__g", "__h"), F.col("__g").eqNullSafe(F.col("__h")))
    low, high = F.col("__upto") - F.col("__c") - F.col("__first"), F.col("__upto") - F.col("__first")
    at = lambda rank: F.max(F.when((low <= rank) & (rank < high), F.col("__x")))
    place = {name: (F.col("__n") - 1) * F.lit(float(q)) for name, q in quantiles.items()}
    ends = ranked.groupBy("__h", "__n").agg(*[at(cut(place[name])).alias(f"{name}_{side}") for name in quantiles for side, cut in (("low", F.floor), ("high", F.ceil))])

    def between(name):
        a, b, p = F.col(f"{name}_low"), F.col(f"{name}_high"), place[name]
        return F.when(a.eqNullSafe(b), a).otherwise(a + (b - a) * (p - F.floor(p)))

    found = ends.select("__h", *[between(name).alias(name) for name in quantiles])
    out = groups.select("__g").join(found, F.col("__g").eqNullSafe(F.col("__h")), "left")
    return out.select(F.col("__g").alias(group), *[F.coalesce(name, F.lit(empty)).alias(name) for name in quantiles])


def std_or_zero(value: Column) -> Column:
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def present(rows: DataFrame, column: str) -> Column:
    """Number in a column, null if the table has no such column or the cell is empty."""
    return lenient_double(F.col(f"`{column}`")) if column in rows.columns else F.lit(None).cast("double")


def without_warmup(rows: DataFrame) -> DataFrame:
    return rows.where(F.lower(F.coalesce(F.col("warmup").cast("string"), F.lit(""))) != "true")


def only_ok(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("ok")) == "ok")


def cold_start(rows: DataFrame) -> DataFrame:
    return rows.where(lenient_double(F.col("epoch")) == 0)


def ring_histogram(samples: DataFrame, group: str, order: str, value: str, last: int = 8192) -> DataFrame:
    """count of all samples; p50, p95, p99 and max of the newest `last`."""
    newest = Window.partitionBy(group).orderBy(F.desc(order))
    ranked = samples.select(group, value, F.row_number().over(newest).alias("__rn"))
    kept = F.when(F.col("__rn") <= last, F.col(value))
    p = lambda q: F.coalesce(F.percentile(kept, F.lit(q)), F.lit(0.0))
    return ranked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.coalesce(F.max(kept), F.lit(0.0)).alias("max"))


def epoch_summary(batches: DataFrame, keys: list[str], warmup_batches: int = 0) -> DataFrame:
    """One row per run and epoch from batch facts (n, fetch_s, compute_s, zero_grad_s, forward_backward_s, optimizer_s).

    Percentiles are of fetch and step times; steady_* leave out the first batches."""
    steady = F.col("batch_idx") >= warmup_batches
    fetch, compute = F.col("fetch_s"), F.col("compute_s")
    step = fetch + compute
    s_n, s_fetch, s_wall = (F.sum(F.when(steady, c)) for c in (F.col("n"), fetch, step))
    stages = {k: F.sum(f"{k}_s") for k in ("zero_grad", "forward_backward", "optimizer")}
    total = F.sum(step)
    out = [
        F.count(F.lit(1)).alias("n_batches"), F.sum("n").alias("n_samples"), F.sum(fetch).alias("wait_total_s"), F.sum(compute).alias("compute_total_s"), total.alias("wall_s"),
        guarded(F.sum("n"), total).alias("throughput"), guarded(F.coalesce(s_n, F.lit(0)), F.coalesce(s_wall, F.lit(0.0))).alias("steady_throughput"),
        guarded(F.sum(fetch), total).alias("wait_fraction"), guarded(F.coalesce(s_fetch, F.lit(0.0)), F.coalesce(s_wall, F.lit(0.0))).alias("steady_wait_fraction"),
        *[guarded(v, total).alias(f"{k}_fraction") for k, v in stages.items()], *[v.alias(f"{k}_total_s") for k, v in stages.items()],
        *[percentile_or(c, q, float("nan")).alias(f"{name}_p{int(q * 100)}") for name, c in (("fetch", fetch), ("step", step)) for q in (0.5, 0.95, 0.99)],
        F.max(fetch).alias("fetch_max"), F.min(F.when(F.col("batch_idx") == 0, fetch)).alias("time_to_first_batch"),
    ]
    return batches.groupBy(*keys).agg(*out)


def throughput_by(rows: DataFrame, group: str, whole: str, steady: str, seed: str) -> DataFrame:
    """Mean and sample deviation of throughput; each row uses its steady value where it has one. n_seeds counts distinct seeds."""
    value = F.coalesce(present(rows, steady), present(rows, whole))
    return rows.select(group, value.alias("__v"), F.col(seed).alias("__s")).groupBy(group).agg(F.avg("__v").alias("mean"), std_or_zero(F.col("__v")).alias("std"), F.countDistinct("__s").alias("n_seeds"))


def throughput_table(rows: DataFrame, group: str, whole: str, steady: str) -> DataFrame:
    """As throughput_by, but a group uses steady values only, as soon as one of its rows has one."""
    cells = rows.select(group, present(rows, steady).alias("__s"), present(rows, whole).alias("__w"))
    any_steady = F.count("__s") > 0
    mean, std = (lambda c: F.coalesce(F.avg(c), F.lit(0.0))), std_or_zero
    return cells.groupBy(group).agg(F.when(any_steady, mean("__s")).otherwise(mean("__w")).alias("mean"), F.when(any_steady, std(F.col("__s"))).otherwise(std(F.col("__w"))).alias("std"))


def mean_of(rows: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """Means of several cells by group; empty and unreadable cells are skipped."""
    return rows.groupBy(*keys).agg(*[F.avg(present(rows, c)).alias(name) for name, c in values.items()])


def stage_shares(rows: DataFrame, group: str, wait: str, forward: str, optimizer: str) -> DataFrame:
    """Mean shares of an epoch and what is left of each row, at least 0."""
    w, f, o = (F.coalesce(present(rows, c), F.lit(0.0)) for c in (wait, forward, optimizer))
    return rows.groupBy(group).agg(F.avg(w).alias("wait"), F.avg(f).alias("forward_backward"), F.avg(o).alias("optimizer"), F.avg(F.greatest(F.lit(0.0), 1 - w - f - o)).alias("other"))


def stage_values(rows: DataFrame, group: str) -> DataFrame:
    """Mean stage shares of rows in new and old layouts.

    wait is the steady share, else the batch share, else the stall share; rows with none are skipped. If neither stage share is
    above 0 the row is split in two, wait and compute."""
    wait = F.coalesce(*[present(rows, c) for c in ("steady_wait_fraction", "batch_wait_fraction", "stall_fraction")])
    f, o = (F.coalesce(present(rows, c), F.lit(0.0)) for c in ("forward_backward_fraction", "optimizer_fraction"))
    two = (f <= 0) & (o <= 0)
    cells = rows.select(group, wait.alias("w"), f.alias("f"), o.alias("o"), two.alias("two")).where("w is not null")
    return cells.groupBy(group).agg(
        F.avg("w").alias("wait"), F.avg(F.when(~F.col("two"), F.col("f"))).alias("forward_backward"), F.avg(F.when(~F.col("two"), F.col("o"))).alias("optimizer"),
        F.avg(F.when(~F.col("two"), F.greatest(F.lit(0.0), 1 - F.col("w") - F.col("f") - F.col("o")))).alias("other"), F.avg(F.when(F.col("two"), F.greatest(F.lit(0.0), 1 - F.col("w")))).alias("compute"),
    )


def grouped_table(rows: DataFrame, keys: list[str], means: dict[str, str] | None = None, sums: dict[str, str] | None = None, maxima: dict[str, str] | None = None, minima: dict[str, str] | None = None, stds: dict[str, str] | None = None, first: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """The report tables: aggregates of numeric cells by group. first: name -> (column, order column), the cell of the first row."""
    out = [F.count(F.lit(1)).alias("n")]
    for kind, columns in ((F.avg, means), (F.sum, sums), (F.max, maxima), (F.min, minima), (std_or_zero, stds)):
        out += [kind(present(rows, c)).alias(name) for name, c in (columns or {}).items()]
    out += [F.min_by(F.col(c), F.col(o)).alias(name) for name, (c, o) in (first or {}).items()]
    return rows.groupBy(*keys).agg(*out)


def sweep_table(rows: DataFrame, group: str, axis: str, value: str, numeric: bool) -> DataFrame:
    """Mean and deviation by group and axis. The axis is text, or a number, and then rows with an unreadable one are left out."""
    at = lenient_double(F.col(axis)) if numeric else F.col(axis).cast("string")
    cells = rows.select(F.col(group), at.alias("axis"), present(rows, value).alias("v"))
    if numeric:
        cells = cells.where("axis is not null and v is not null")
    return cells.groupBy(group, "axis").agg(F.avg("v").alias("mean"), std_or_zero(F.col("v")).alias("std"), F.count("v").alias("n")).orderBy(group, "axis")


def sweep_axis(rows: DataFrame, prefix: str = "axis_") -> str | None:
    """The first axis column with more than one value, else the first."""
    axes = [c for c in rows.columns if c.startswith(prefix)]
    if not axes:
        return None
    n = rows.agg(*[F.countDistinct(f"`{c}`").alias(str(i)) for i, c in enumerate(axes)]).first()
    return next((c for i, c in enumerate(axes) if n[i] > 1), axes[0])


def stage_percentile_table(rows: DataFrame, group: str, stages: dict[str, str]) -> DataFrame:
    """Wide <prefix>_p50_s, _p95_s and _count cells to a row per group and stage: mean p50 and p95 in ms, samples."""
    parts = [F.struct(F.lit(name).alias("stage"), present(rows, f"{c}_p50_s").alias("p50"), present(rows, f"{c}_p95_s").alias("p95"), present(rows, f"{c}_count").alias("n")) for name, c in stages.items()]
    long = rows.select(group, F.inline(F.array(*parts)))
    return long.groupBy(group, "stage").agg((F.avg("p50") * 1000).alias("p50_ms"), (F.avg("p95") * 1000).alias("p95_ms"), F.sum("n").alias("samples"))


def relative_to_best(means: DataFrame, within: str, value: str) -> DataFrame:
    """Percent above or below the best positive value of its group."""
    best = F.max(F.when(F.col(value) > 0, F.col(value))).over(Window.partitionBy(within))
    return means.withColumn("relative_pct", (F.col(value) / best - 1) * 100)


def relative_to_baseline(rows: DataFrame, keys: list[str], scenario: str, baseline: str, value: str, fallback: dict[str, str] | None = None) -> DataFrame:
    """Percent and difference against the baseline scenario of the same keys, else that of the fallback keys."""
    base = rows.where(F.col(scenario) == baseline)
    own = base.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(value).alias("__base"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = rows.join(own, cond, "left").drop(*[f"__{k}" for k in keys])
    if fallback:
        for k, v in fallback.items():
            base = base.where(F.col(k) == v)
        out = out.crossJoin(base.agg(F.avg(value).alias("__other"))).withColumn("__base", F.coalesce("__base", "__other")).drop("__other")
    return out.withColumn("relative_pct", F.when(F.col("__base") != 0, (F.col(value) / F.col("__base") - 1) * 100)).withColumn("delta", F.col(value) - F.col("__base")).drop("__base")


def last_wins(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def size_scaling(rows: DataFrame, group: str, n: str, value: str, size: str) -> tuple[DataFrame, DataFrame]:
    """(mean and deviation by group and n, smallest and largest mean size over n)."""
    by = rows.groupBy(group, n).agg(F.avg(value).alias("mean"), std_or_zero(F.col(value)).alias("std"))
    sizes = rows.groupBy(n).agg(F.avg(size).alias("s")).agg(F.min("s").alias("min_size"), F.max("s").alias("max_size"))
    return by, sizes


def series_summary(points: DataFrame, group: str, t: str, gauges: list[str], counters: list[str]) -> DataFrame:
    """Gauges: mean, p95, min, max. Counters: last minus first and its rate; the duration counts as 1e-9 s at least."""
    duration = F.greatest(F.max(t) - F.min(t), F.lit(1e-9))
    out = [F.count(F.lit(1)).alias("n_points"), (F.max(t) - F.min(t)).alias("duration_s")]
    for g in gauges:
        out += [F.avg(g).alias(f"{g}_mean"), percentile_or(F.col(g), 0.95, float("nan")).alias(f"{g}_p95"), F.max(g).alias(f"{g}_max"), F.min(g).alias(f"{g}_min")]
    for c in counters:
        known = F.when(F.col(c).isNotNull(), F.col(t))
        delta = F.max_by(c, known) - F.min_by(c, known)
        out += [delta.alias(f"{c}_delta"), (delta / duration).alias(f"{c}_per_s")]
    return points.groupBy(group).agg(*out)


def slope(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Least-squares slope; 0 for fewer than two points."""
    return rows.groupBy(group).agg(F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"), F.count(y).alias("n"))


def plateau(rows: DataFrame, group: str, cycle: str, value: str, warmup: int, drain: str | None = None) -> DataFrame:
    """Memory over cycles after the warm-up: min, max, growth from first to last, slope, mean drain time."""
    kept = rows.where(F.col(cycle) >= warmup)
    out = [F.min(value).alias("min"), F.max(value).alias("max"), (F.max_by(value, cycle) - F.min_by(value, cycle)).alias("growth"), F.coalesce(F.regr_slope(value, cycle), F.lit(0.0)).alias("slope")]
    if drain:
        out.append(F.avg(drain).alias("mean_drain"))
    return kept.groupBy(group).agg(*out)


def snapshot_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, name, value) from one-row tables of maps counters, gauges and histogram counts: counters and histograms as differences, gauges as they end."""
    def long(df, kind, column):
        return df.select(F.explode(column).alias("name", "value")).select(F.lit(kind).alias("kind"), "name", F.col("value").cast("double").alias("value"))

    def all_of(df):
        return long(df, "counter", "counters").unionByName(long(df, "gauge", "gauges")).unionByName(long(df, "histogram", "histograms"))

    b = all_of(before).withColumnRenamed("value", "old")
    return all_of(after).join(b, ["kind", "name"], "left").select("kind", "name", F.when(F.col("kind") == "gauge", F.col("value")).otherwise(F.col("value") - F.coalesce("old", F.lit(0.0))).alias("value"))


def pure_read(reads: DataFrame, group: str, size: str, t: str) -> DataFrame:
    """Objects and MiB per second, mean size, time to the first object; t counts from 0."""
    wall = F.greatest(F.max(t), F.lit(1e-9))
    return reads.groupBy(group).agg(F.count(F.lit(1)).alias("objects"), F.sum(size).alias("bytes"), (F.count(F.lit(1)) / wall).alias("objects_per_s"), (F.sum(size) / 1048576.0 / wall).alias("mib_per_s"), F.avg(size).alias("avg_bytes"), F.min(t).alias("first_s"))


def stability(rows: DataFrame, group: str, epoch: str, throughput: str, rss: str, least: float = 0.85, most: float = 2.0) -> DataFrame:
    """Throughput kept (mean of the last three epochs over epoch 2) and memory growth (last over epoch 2), with their gates."""
    newest = Window.partitionBy(group).orderBy(F.desc(epoch))
    r = rows.withColumn("__rn", F.row_number().over(newest))
    second = lambda c: F.max(F.when(F.col(epoch) == 2, F.col(c)))
    out = r.groupBy(group).agg((F.avg(F.when(F.col("__rn") <= 3, F.col(throughput))) / F.nullif(second(throughput), F.lit(0.0))).alias("retention"), (F.max(F.when(F.col("__rn") == 1, F.col(rss))) / F.nullif(second(rss), F.lit(0.0))).alias("rss_growth"))
    return out.withColumn("stable", F.coalesce((F.col("retention") >= least) & (F.col("rss_growth") <= most), F.lit(False)))

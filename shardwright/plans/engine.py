"""A data set in a folder: versions, commits, transactions, sessions, compaction.

root/versions/<n>/{objects,shards} are immutable catalog tables; root/log/<seq>.json are commits, each one transaction; root/CURRENT names the version and the
seq up to which the log is in it. A commit is one file that appears under a name nobody had, so it is there as a whole or not at all, and never over another
one. Writers hold root/LOCK, which only one can create. Payloads are tar shards root/shard_<id>, each written once under a new number; deltas are negative, at
least one for each commit with payloads, until compaction.
"""

from __future__ import annotations

import json
import os
import queue
import threading
import time
import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog
from ..functions import scalar as X
from ..operators import packing
from ..sources.sinks import append_tar, write_shards
from ..sources.tar import filesystem, read_shards, write_catalog
from ..streaming import log
from . import loader

DELTA_TARGET, SHARD_TARGET = 100 << 20, 100 << 20


class Busy(RuntimeError):
    """A session or another writer holds the data set."""


@dataclass
class Put:
    path: str
    payload: bytes
    metadata: dict | None = None


@dataclass
class Delete:
    path: str


@dataclass
class Rename:
    path: str
    target: str


@dataclass
class Transaction:
    """Ordered operations that become visible together."""

    engine: Engine
    ops: list = field(default_factory=list)

    def put(self, path: str, payload: bytes, metadata: dict | None = None) -> Transaction:
        self.ops.append(Put(path, payload, metadata))
        return self

    def delete(self, path: str) -> Transaction:
        self.ops.append(Delete(path))
        return self

    def rename(self, path: str, target: str) -> Transaction:
        self.ops.append(Rename(path, target))
        return self

    def commit(self) -> int:
        return self.engine.apply(self.ops)


@dataclass
class Session:
    """A pinned state; its plans don't change while the data set does."""

    engine: Engine
    spec: loader.LoaderSpec
    version: int
    seq: int
    generation: int
    id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def plan(self, epoch: int = 0, payload: bool = False) -> DataFrame:
        objects, shards = self.engine.state(self.version, self.seq)
        spec = loader.LoaderSpec(**{**self.spec.__dict__, "epoch": epoch})
        plan = loader.epoch_plan(objects, shards, spec).withColumn("generation", F.lit(self.generation))
        if not payload:
            return plan
        path = self.engine.pinned_objects(self.version, self.seq, objects)
        data = read_shards(self.engine.spark, self.engine.root, path).select("path", "payload")
        return plan.join(data, "path")

    def batches(self, epoch: int = 0, payload: bool = False) -> Iterable[list]:
        """Batches in order. A wait of more than timeout_s ends in TimeoutError, whatever Spark does meanwhile; its jobs are cancelled."""
        return timed(self.engine.spark, lambda: loader.iterate(self.plan(epoch, payload)), self.spec.timeout_s)

    def close(self) -> None:
        self.engine.sessions.pop(self.id, None)

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def timed(spark: SparkSession, source, seconds: float, held: int = 2) -> Iterable:
    """Items of source(), read ahead by a thread; TimeoutError if the next one takes longer than that."""
    from pyspark import InheritableThread

    ready, group, done = queue.Queue(held), uuid.uuid4().hex, threading.Event()

    def offer(item) -> bool:
        while not done.is_set():
            try:
                ready.put(item, timeout=0.2)
                return True
            except queue.Full:
                pass
        return False

    def fill() -> None:
        try:
            spark.sparkContext.setJobGroup(group, "batches", True)
            for item in source():
                if not offer((item, None)):
                    return
            offer((None, StopIteration()))
        except BaseException as e:  # noqa: BLE001 - handed over to the reader
            offer((None, e))

    thread = InheritableThread(target=fill, daemon=True)
    thread.start()
    try:
        while True:
            try:
                item, error = ready.get(timeout=seconds)
            except queue.Empty:
                raise TimeoutError(f"no batch for {seconds} s") from None
            if isinstance(error, StopIteration):
                return
            if error is not None:
                raise error
            yield item
    finally:
        done.set()
        if thread.is_alive():
            spark.sparkContext.cancelJobGroup(group)


class Engine:
    def __init__(self, spark: SparkSession, root: str, delta_target: int = DELTA_TARGET) -> None:
        self.spark, self.root, self.delta_target = spark, root.rstrip("/"), delta_target
        self.files, self.base = filesystem(self.root)
        self.sessions: dict[str, Session] = {}
        self._pinned: dict[tuple[int, int], str] = {}
        for d in ("", "/versions", "/log"):
            self.files.create_dir(self.base + d, recursive=True)
        if not self._exists("CURRENT"):
            self._write_version(0, spark.createDataFrame([], catalog.OBJECTS), spark.createDataFrame([], catalog.SHARDS))
            self._point(0, 0, 0)

    # files

    def _exists(self, name: str) -> bool:
        return self.files.get_file_info(f"{self.base}/{name}").type.name == "File"

    def _read(self, name: str) -> bytes:
        with self.files.open_input_file(f"{self.base}/{name}") as f:
            return f.read()

    def _put_file(self, name: str, raw: bytes) -> None:
        temporary = f"{self.base}/{name}.{uuid.uuid4().hex}.tmp"
        with self.files.open_output_stream(temporary) as f:
            f.write(raw)
        self.files.move(temporary, f"{self.base}/{name}")

    def _put_new(self, name: str, raw: bytes) -> None:
        """A whole file under a name that must be free; FileExistsError if another writer was first."""
        from pyarrow import fs

        aside = f"{name}.{uuid.uuid4().hex}.tmp"
        with self.files.open_output_stream(f"{self.base}/{aside}") as f:
            f.write(raw)
        if isinstance(self.files, fs.LocalFileSystem):
            try:
                os.link(f"{self.base}/{aside}", f"{self.base}/{name}")  # fails where the target is, unlike a rename
            finally:
                os.unlink(f"{self.base}/{aside}")
            return
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        hadoop = path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not hadoop.rename(path(f"{self.root}/{aside}"), path(f"{self.root}/{name}")):
            hadoop.delete(path(f"{self.root}/{aside}"), False)
            raise FileExistsError(name)

    def shard_files(self) -> list[int]:
        """Numbers of all shard files there are, named by a catalog or not."""
        from pyarrow import fs

        names = (x.base_name for x in self.files.get_file_info(fs.FileSelector(self.base)) if x.type == fs.FileType.File)
        return sorted(int(n[6:]) for n in names if n.startswith("shard_") and n[6:].lstrip("-").isdigit())

    def _point(self, version: int, seq: int, generation: int) -> None:
        self._put_file("CURRENT", json.dumps({"version": version, "seq": seq, "generation": generation}).encode())

    def current(self) -> dict:
        return json.loads(self._read("CURRENT"))

    def _write_version(self, n: int, objects: DataFrame, shards: DataFrame) -> None:
        objects.select(*catalog.OBJECTS.names).write.mode("overwrite").parquet(f"{self.root}/versions/{n}/objects")
        shards.select(*catalog.SHARDS.names).write.mode("overwrite").parquet(f"{self.root}/versions/{n}/shards")

    def commits(self) -> list[int]:
        from pyarrow import fs

        listed = self.files.get_file_info(fs.FileSelector(f"{self.base}/log"))
        return sorted(int(x.base_name[:-5]) for x in listed if x.base_name.endswith(".json"))

    @contextmanager
    def exclusive(self):
        """The only writer: LOCK can be created by one only."""
        try:
            self._put_new("LOCK", uuid.uuid4().hex.encode())
        except FileExistsError:
            raise Busy("another writer") from None
        try:
            yield
        finally:
            self.files.delete_file(f"{self.base}/LOCK")

    # state

    def version(self, n: int) -> tuple[DataFrame, DataFrame]:
        read = lambda name, schema: self.spark.read.schema(schema).parquet(f"{self.root}/versions/{n}/{name}")
        return read("objects", catalog.OBJECTS), read("shards", catalog.SHARDS)

    def records(self, up_to: int, after: int) -> DataFrame:
        names = [f"{self.root}/log/{n:020d}.json" for n in self.commits() if after < n <= up_to]
        if not names:
            return self.spark.createDataFrame([], log.RECORDS)
        return self.spark.read.schema(log.RECORDS).option("mode", "FAILFAST").json(names)

    def state(self, version: int | None = None, seq: int | None = None) -> tuple[DataFrame, DataFrame]:
        now = self.current()
        version = now["version"] if version is None else version
        base = json.loads(self._read(f"versions/{version}/BASE"))["seq"] if self._exists(f"versions/{version}/BASE") else 0
        last = max([base, *self.commits()]) if seq is None else seq
        objects, shards = self.version(version)
        return log.replay(objects, shards, self.records(last, base))

    def lookup(self, paths: list[str]) -> dict:
        """Live objects among these paths: the filter reaches the catalog's files and the log, nothing else is read."""
        now = self.current()
        base = json.loads(self._read(f"versions/{now['version']}/BASE"))["seq"] if self._exists(f"versions/{now['version']}/BASE") else 0
        asked = F.col("path").isin(sorted(set(paths)))
        found = {r.path: r.asDict() for r in catalog.live(self.version(now["version"])[0]).where(asked).collect()}
        for r in log.fold(self.records(max([base, *self.commits()]), base)).where(asked).collect():
            found.pop(r.path, None)
            if r.object is not None:
                found[r.path] = {**r.object.asDict(), "path": r.path}
        return found

    def last_seq(self) -> int:
        return max([self.current()["seq"], *self.commits()])

    def generation(self) -> int:
        now = self.current()
        return now["generation"] + len([n for n in self.commits() if n > now["seq"]])

    def objects(self) -> DataFrame:
        return catalog.live(self.state()[0])

    def list(self) -> list[str]:
        return [r.path for r in self.objects().select("path").orderBy("path").toLocalIterator()]

    def read(self, path: str) -> bytes:
        row = self.lookup([path]).get(path)
        if row is None:
            raise FileNotFoundError(path)
        with self.files.open_input_file(f"{self.base}/shard_{row['shard_id']}") as f:
            f.seek(row["offset"])
            return f.read(row["size"])

    def pinned_objects(self, version: int, seq: int, objects: DataFrame) -> str:
        """The state of a session as a table that the payload source reads."""
        from ..storage import scratch_path

        if (version, seq) not in self._pinned:
            path = scratch_path(self.spark, "pinned")
            write_catalog(objects, path)
            self._pinned[version, seq] = path
        return self._pinned[version, seq]

    # writes

    def _check(self, *paths: str) -> None:
        rows = self.spark.createDataFrame([(p,) for p in paths], "path string")
        bad = rows.where(~X.valid_logical_path(F.col("path"))).first()
        if bad is not None:
            raise ValueError(f"bad path {bad.path!r}")

    def put(self, path: str, payload: bytes, metadata: dict | None = None) -> int:
        return self.apply([Put(path, payload, metadata)])

    def delete(self, path: str, strict: bool = True) -> int:
        if not strict and path not in self.lookup([path]):
            return self.last_seq()
        return self.apply([Delete(path)])

    def rename(self, path: str, target: str) -> int:
        return self.apply([Rename(path, target)])

    def replace(self, payloads: dict[str, bytes]) -> int:
        return self.apply([Put(p, b) for p, b in payloads.items()])

    def transaction(self) -> Transaction:
        return Transaction(self)

    def apply(self, ops: list) -> int:
        """One transaction in the order of its ops, live and replayed alike. Sources of renames and deletes are looked up as they were before it, or as made by it.

        Bytes are written before the commit file names them: a crash between leaves unnamed bytes, never a name without bytes."""
        self._check(*[p for op in ops for p in ((op.path, op.target) if isinstance(op, Rename) else (op.path,))])
        with self.exclusive():
            seq = self.last_seq() + 1
            asked = sorted({op.path for op in ops if not isinstance(op, Put)})
            known = self.lookup(asked) if asked else {}
            shard, end = min([0, *self.shard_files()]) - 1, 0
            staged: dict[int, list] = {}
            records, made = [], {}
            txn, now = uuid.uuid4().hex, int(time.time())
            row = lambda kind, **x: {"seq": seq, "txn_id": txn, "ts": now, "op": kind, **x}
            for op in ops:
                if isinstance(op, Put):
                    n = 512 + len(op.payload) + -len(op.payload) % 512
                    if end and end + n > self.delta_target:
                        shard, end = shard - 1, 0
                    staged.setdefault(shard, []).append((op.path, op.payload))
                    add = {"path": op.path, "shard_id": shard, "offset": end + 512, "size": len(op.payload), "deleted": False, "object_metadata": op.metadata}
                    end += n + 1024
                    records.append(row("add", add=add))
                    made[op.path] = add
                elif isinstance(op, Delete):
                    if op.path not in known and made.get(op.path) is None:
                        raise FileNotFoundError(op.path)
                    records.append(row("delete", delete=op.path))
                    made[op.path] = None
                    known.pop(op.path, None)
                else:
                    source = made.get(op.path) or known.get(op.path)
                    if source is None:
                        raise FileNotFoundError(op.path)
                    records += [row("delete", delete=op.path), row("delete", delete=op.target), row("add", add={**source, "path": op.target})]
                    made[op.path], made[op.target] = None, {**source, "path": op.target}
                    known.pop(op.path, None)
            for number, items in staged.items():
                self._put_new(f"shard_{number}", append_tar(items)[0])
            self._put_new(f"log/{seq:020d}.json", self._lines(records))
            return seq

    @staticmethod
    def _lines(records: list[dict]) -> bytes:
        """JSON lines of the last record of each path (the fold by seq needs one a commit); bytes as Spark reads them, base64."""
        import base64

        last: dict[str, dict] = {}
        for r in records:
            path = r["delete"] if r["op"] == "delete" else r["add"]["path"]
            last.pop(path, None)
            last[path] = r
        out = []
        for r in last.values():
            if r["op"] == "add":
                meta = r["add"]["object_metadata"]
                raw = bytes(meta) if isinstance(meta, (bytes, bytearray)) else json.dumps(meta, separators=(",", ":")).encode() if meta is not None else b""
                r = {**r, "add": {**r["add"], "object_metadata": base64.b64encode(raw).decode()}}
            out.append(json.dumps(r))
        return ("\n".join(out) + "\n").encode()

    def ingest(self, samples: DataFrame, rule: str = "converter", target: int = SHARD_TARGET) -> int:
        """Bulk-load samples (path, payload, object_metadata) as base shards; repeated paths are an error. Returns the new version."""
        from ..storage import materialize

        own = materialize(samples.select("path", "payload", "object_metadata"), "ingest")
        twice = own.groupBy("path").count().where("count > 1").first()
        if twice is not None:
            raise ValueError(f"repeated path {twice.path!r}")
        bad = own.where(~X.valid_logical_path(F.col("path"))).first()
        if bad is not None:
            raise ValueError(f"bad path {bad.path!r}")
        with self.exclusive():
            objects, shards = self.state()
            first = self._next_shard(shards)
            sizes = own.select("path", F.octet_length("payload").cast("long").alias("size"))
            packed = packing.pack_ranges(sizes, ["path"], "path", "size", rule, target, self._ranges(sizes, target))
            placed = materialize(packed.withColumn("shard_id", (F.col("shard") + first).cast("int")), "placed")
            written = write_shards(own.join(placed, "path").select("path", "shard_id", "offset", "payload"), self.root)
            fresh = own.drop("payload").join(placed, "path").select("path", "shard_id", "offset", "size", F.lit(False).alias("deleted"), "object_metadata")
            kept = objects.join(fresh.select("path"), "path", "left_anti")
            return self._advance(kept.unionByName(fresh), shards.unionByName(written.select(F.col("shard_id").alias("number"), F.lit("base").alias("type"), "total_size")))

    def _next_shard(self, shards: DataFrame) -> int:
        """A number above all shards that a catalog names and all files there are, so nothing is written over."""
        named = shards.where("number >= 0").agg(F.max("number")).first()[0]
        return max([-1, *self.shard_files(), *([] if named is None else [named])]) + 1

    @staticmethod
    def _ranges(sizes: DataFrame, target: int) -> int:
        """Ranges packed apart: each fills some 16 shards, as its last one may be short."""
        total = sizes.agg(F.sum("size")).first()[0] or 0
        return max(1, total // (16 * target))

    def _advance(self, objects: DataFrame, shards: DataFrame) -> int:
        now, seq, generation = self.current(), self.last_seq(), self.generation() + 1
        n = now["version"] + 1
        self._write_version(n, objects, shards)
        self._put_file(f"versions/{n}/BASE", json.dumps({"seq": seq}).encode())
        self._point(n, seq, generation)
        return n

    def checkpoint(self) -> int:
        """A new version with the log in it; then the log up to it expires, except for what open sessions still read."""
        with self.exclusive():
            n = self._advance(*self.state())
            self._expire()
            return n

    def _expire(self) -> None:
        seq = self.current()["seq"]
        if not self.sessions:
            for c in self.commits():
                if c <= seq:
                    self.files.delete_file(f"{self.base}/log/{c:020d}.json")

    # sessions

    def open(self, spec: loader.LoaderSpec | None = None) -> Session:
        now = self.current()
        s = Session(self, spec or loader.LoaderSpec(), now["version"], self.last_seq(), self.generation())
        self.sessions[s.id] = s
        return s

    def oldest_pin(self) -> int | None:
        return min((s.generation for s in self.sessions.values()), default=None)

    # maintenance

    def fragmentation(self) -> float:
        objects, shards = self.state()
        return catalog.fragmentation(objects, shards).first().fragmentation

    def vacuum(self, target: int = SHARD_TARGET, dry_run: bool = False) -> dict:
        """Rewrite live objects in order of (shard, offset, path) into new base shards; old ones go once the new version is current."""
        from ..storage import materialize

        if self.sessions:
            raise Busy("a session is open")
        with self.exclusive():
            objects, shards = self.state()
            live = materialize(catalog.live(objects), "vacuum")
            packed = materialize(packing.pack_ranges(live, ["shard_id", "offset", "path"], "path", "size", "vacuum", target, self._ranges(live, target)), "vacuum-packed")
            totals = packing.shard_totals(packed)
            before = shards.where("number >= 0").agg(F.coalesce(F.sum("total_size"), F.lit(0))).first()[0]
            after = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum("total_size"), F.lit(0))).first()
            stats = {"live_files": live.count(), "new_shards": after[0], "bytes_before": before, "bytes_after": after[1]}
            if dry_run:
                return stats
            first = self._next_shard(shards)
            placed = packed.select("path", (F.col("shard") + first).cast("int").alias("shard_id"), "offset", "size")
            data = read_shards(self.spark, self.root, self.pinned_objects(-1, self.last_seq() + self.generation(), live)).select("path", "payload")
            write_shards(placed.join(data, "path"), self.root)
            fresh = placed.join(live.select("path", "object_metadata"), "path").select("path", "shard_id", "offset", "size", F.lit(False).alias("deleted"), "object_metadata")
            self._advance(fresh, totals.select((F.col("shard") + first).cast("int").alias("number"), F.lit("base").alias("type"), "total_size"))
            self._expire()
            self.clean()
            return stats

    def clean(self) -> list[str]:
        """Delete shard files that the current state doesn't name, and what an interrupted writer left."""
        from pyarrow import fs

        from ..operators.sets import stale_files

        names = [x.base_name for x in self.files.get_file_info(fs.FileSelector(self.base)) if x.type == fs.FileType.File]
        listed = self.spark.createDataFrame([(n,) for n in names if n.startswith("shard_")], "name string")
        gone = [r.name for r in stale_files(listed, self.state()[1]).toLocalIterator()]
        for name in gone:
            self.files.delete_file(f"{self.base}/{name}")
        return gone

    def maintain(self, threshold: float = 0.3) -> dict | None:
        """One tick of automatic compaction: vacuum if no session is open and fragmentation has reached the threshold."""
        if self.sessions or self.fragmentation() < threshold:
            return None
        return self.vacuum()

    def export_manifest(self, path: str) -> None:
        catalog.write_manifest(*self.state(), path)

    def import_manifest(self, path: str) -> int:
        with self.exclusive():
            return self._advance(*catalog.read_manifest(self.spark, path, trusted=False))

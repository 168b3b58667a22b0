"""Tar shards as Spark data sources.

tar_shards: payloads of a catalog's objects. The driver reads the footers of the catalog's Parquet files only and cuts their row groups into ranges of rows; each
reader takes its own rows, in order of shard and offset, and reads neighbours in one go. Footers' statistics prune row groups by shard_id and path, filters then prune
objects; without the payload column nothing is read from shards. write_catalog sorts a catalog by shard and offset, so that readers share few shards.

tar_members: the records of archives in a folder, one partition per archive (or glob), name, stem, ext, offset, size and payload.
"""

from __future__ import annotations

import os
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

BATCH_BYTES = 4 << 20
ROWS, SPAN, GAP = 16_384, 8 << 20, 64 << 10
CATALOG_GROUP = 2 << 20  # bytes of a catalog's row groups, about what a few readers take


def filesystem(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def opened(path: str):
    """A file of any length as a seekable stream; nothing but what is asked for is read."""
    files, at = filesystem(path)
    return files.open_input_file(at)


def pieces(batches, rows: int = 64):
    """Slices of batches: what is made of one is no more than of so many rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


class Rows(InputPartition):
    """Rows [start, stop) of one row group of a catalog file."""

    def __init__(self, file: str, group: int, start: int, stop: int) -> None:
        super().__init__((file, group, start))
        self.file, self.group, self.start, self.stop = file, group, start, stop


class ShardReader(DataSourceReader):
    """options: root, objects (path of a Parquet table path, shard_id, offset, size, object_metadata, deleted), ignorecorrupt."""

    def __init__(self, options: dict, schema) -> None:
        self.root, self.objects = options["root"], options["objects"]
        self.ignore = options.get("ignorecorrupt", "false").lower() == "true"
        self.names = [f.name for f in schema.fields]
        self.shards = self.paths = None

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", None)
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and column == ("shard_id",):
                self.shards = values if self.shards is None else self.shards & values
            elif values is not None and column == ("path",):
                self.paths = values if self.paths is None else self.paths & values
            yield f

    def _hopeless(self, group) -> bool:
        """Whether a row group's statistics exclude all wanted shards or paths."""
        for i in range(group.num_columns):
            c = group.column(i)
            wanted = {"shard_id": self.shards, "path": self.paths}.get(c.path_in_schema)
            if wanted is not None and c.statistics is not None and c.statistics.has_min_max and not any(c.statistics.min <= w <= c.statistics.max for w in wanted):
                return True
        return False

    def partitions(self):
        import pyarrow.dataset as ds
        import pyarrow.parquet as pq

        files, at = filesystem(self.objects)
        out = []
        for name in ds.dataset(at, filesystem=files, format="parquet", exclude_invalid_files=True).files:
            with files.open_input_file(name) as f:
                meta = pq.read_metadata(f)
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                if not self._hopeless(group):
                    out += [Rows(name, g, i, min(i + ROWS, group.num_rows)) for i in range(0, group.num_rows, ROWS)]
        return out or [Rows("", 0, 0, 0)]

    def _wanted(self, part: Rows) -> pa.Table:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        files, _ = filesystem(self.objects)
        with files.open_input_file(part.file) as f:
            rows, at = [], 0
            # the row group is streamed and left behind the last row; it may be much longer than the part
            for batch in pq.ParquetFile(f, buffer_size=1 << 20).iter_batches(ROWS, [part.group], ["path", "shard_id", "offset", "size", "deleted", "object_metadata"], use_threads=False):
                low, high = max(part.start - at, 0), min(part.stop - at, batch.num_rows)
                if low < high:
                    rows.append(batch.slice(low, high - low))
                at += batch.num_rows
                if at >= part.stop:
                    break
            rows = pa.Table.from_batches(rows)
        keep = pc.invert(rows.column("deleted"))
        for name, values in (("shard_id", self.shards), ("path", self.paths)):
            if values is not None:
                keep = pc.and_(keep, pc.is_in(rows.column(name), pa.array(sorted(values), rows.schema.field(name).type)))
        return rows.filter(keep).sort_by([("shard_id", "ascending"), ("offset", "ascending")])

    def read(self, partition):
        import numpy as np

        if not partition.file:
            return
        wanted = self._wanted(partition)
        if "payload" not in self.names:
            yield from wanted.select(self.names).to_batches()
            return
        shard, offset, size = (np.asarray(wanted.column(c)).astype(np.int64) for c in ("shard_id", "offset", "size"))
        end = offset + size
        files, root = filesystem(self.root)
        i, now, f, length = 0, None, None, 0
        try:
            while i < len(shard):
                if shard[i] != now:
                    if f is not None:
                        f.close()
                    now, f = shard[i], None
                    try:
                        f = files.open_input_file(f"{root}/shard_{now}")
                        length = f.size()
                    except OSError:
                        if not self.ignore:
                            raise
                j = i + 1
                # neighbours are read in one go
                while j < len(shard) and shard[j] == now and offset[j] - end[j - 1] <= GAP and end[j] - offset[i] <= SPAN:
                    j += 1
                whole = np.flatnonzero(end[i:j] <= length) + i if f is not None else np.zeros(0, np.int64)
                if len(whole) < j - i and not self.ignore:
                    lost = next(k for k in range(i, j) if end[k] > length)
                    raise OSError(f"shard_{now} ends before {wanted.column('path')[lost].as_py()}")
                if len(whole):
                    f.seek(int(offset[whole[0]]))
                    raw = f.read_buffer(int(end[whole].max() - offset[whole[0]]))
                    yield from self._batches(wanted, whole, raw, offset - offset[whole[0]], size)
                i = j
        finally:
            if f is not None:
                f.close()

    def _batches(self, wanted: pa.Table, rows, raw: pa.Buffer, at, size):
        """Rows with their payloads out of one span, in batches of bounded size."""
        import numpy as np

        view = memoryview(raw)
        cuts = np.searchsorted(np.cumsum(size[rows] + 100), np.arange(BATCH_BYTES, int((size[rows] + 100).sum()), BATCH_BYTES))
        for own in np.split(rows, np.unique(cuts)):
            if len(own):
                # pa.array of memoryviews never gives up their span, so the array is made of its buffers
                cut = np.concatenate([[0], np.cumsum(size[own])]).astype(np.int32)
                data = b"".join(view[at[k] : at[k] + size[k]] for k in own)
                payload = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(cut), pa.py_buffer(data)])
                batch = wanted.take(pa.array(own)).append_column("payload", payload)
                yield from batch.select(self.names).combine_chunks().to_batches()

class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def schema(self) -> str:
        base = "path string, shard_id int, offset long, size long, object_metadata binary"
        return base if self.options.get("payload", "true").lower() == "false" else base + ", payload binary"

    def reader(self, schema):
        return ShardReader(dict(self.options), schema)


def read_shards(spark: SparkSession, root: str, objects: str, payload: bool = True, ignore_corrupt: bool = False) -> DataFrame:
    spark.dataSource.register(ShardSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tar_shards").options(root=root, objects=objects, payload=str(payload), ignorecorrupt=str(ignore_corrupt)).load()


def read_object(spark: SparkSession, root: str, objects: str, path: str) -> bytes | None:
    """One object's payload, clamped to its size; None if it doesn't live."""
    row = read_shards(spark, root, objects).where(F.col("path") == path).select("payload").first()
    return None if row is None else bytes(row[0])


MEMBERS = "tar string, name string, stem string, ext string, offset long, size long, payload binary"


def tar_members(batches):
    """Paths to members; directories are skipped, names keep their folders. Archives are streamed, in batches of bounded size."""
    names = [x.split()[0] for x in MEMBERS.split(", ")]
    kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.binary()]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows, held = [], 0
            with opened(path) as f, tarfile.open(fileobj=f) as tar:
                while (m := tar.next()) is not None:
                    tar.members = []  # it would keep all headers
                    if m.isfile():
                        base = os.path.basename(m.name)
                        stem, ext = os.path.splitext(m.name)
                        rows.append((path, m.name, stem, ext.lower() if base != ext else "", m.offset_data, m.size, tar.extractfile(m).read()))
                        held += m.size + 500
                        if held >= BATCH_BYTES:
                            yield made(rows)
                            rows, held = [], 0
            yield made(rows)


def read_tars(spark: SparkSession, root: str, glob: str = "*.tar") -> DataFrame:
    """Members of all archives that match, whatever their length; each is streamed by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(root).select("path")
    return files.mapInArrow(tar_members, MEMBERS)


def write_catalog(objects: DataFrame, path: str) -> None:
    """A catalog table in the order of shards and offsets, so that a reader's rows lie in few shards."""
    objects.repartitionByRange("shard_id", "offset").sortWithinPartitions("shard_id", "offset").write.option("parquet.block.size", CATALOG_GROUP).parquet(path)


def tar_header_errors(root: str):
    """(path, shard_id, offset, size), sorted by shard and offset, to (path, error): what stands in the 512 bytes before each object."""

    def check(batches):
        files, base = filesystem(root)
        now, f, length = None, None, 0
        for batch in batches:
            out = []
            for path, shard, offset, size in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    if f is not None:
                        f.close()
                    now, f, length = shard, None, 0
                    try:
                        f = files.open_input_file(f"{base}/shard_{shard}")
                        length = f.size()
                    except OSError:
                        pass
                if f is None:
                    out.append((path, "no shard"))
                    continue
                if offset < 512 or offset + size > length:
                    out.append((path, "beyond the shard"))
                    continue
                f.seek(offset - 512)
                try:
                    info = tarfile.TarInfo.frombuf(f.read(512), "utf-8", "surrogateescape")
                except tarfile.HeaderError:
                    out.append((path, "no tar header"))
                    continue
                if info.name not in (path, os.path.basename(path)):
                    out.append((path, f"name {info.name}"))
                elif info.size != size:
                    out.append((path, f"size {info.size}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(2)], names=["path", "error"])
        if f is not None:
            f.close()

    return check

"""Binary columns from archives: a Spark data source over directories of zip files.

The driver only lists archives and cuts each into byte ranges. The reader of a range reads the archive's central directory, takes the members whose
headers lie in its range, and streams their payloads in Arrow batches of bounded size. A member that fails (short read, wrong
checksum, unknown method, I/O error) is read again by itself, at its offset and through a new handle, up to `retries` times; if it still fails,
its row has a null payload and the error, and the others are not touched. An archive without a readable directory is one row with an error, from its first range.

write_archives makes such directories from a table: one task, one archive or several of about `archive_bytes`, written
under another name and renamed, so that a task that runs again replaces its own files.

Cases: a null payload becomes no member; an empty one is a member of size 0. Members may share a name. Directory entries are skipped. An empty table or folder gives
no rows. A member's name is its number, a dash and the title; without a title there is no dash. page_media gives titles back in the type that page_id
has, negative, text and null ones too. Options: path, rangebytes, batchbytes, retries, payload (false: members and sizes only, no payload is read).
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import scratch_path

SCHEMA = "archive string, member string, offset long, size long, attempts int, error string, payload binary"
RANGE_BYTES, BATCH_BYTES, ARCHIVE_BYTES, RETRIES = 16 << 20, 4 << 20, 64 << 20, 3


def open_filesystem(path: str):
    """(pyarrow file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int) -> None:
        super().__init__((archive, start, end))
        self.archive, self.start, self.end = archive, start, end


def read_member(files, path: str, info: zipfile.ZipInfo) -> bytes:
    """One member's payload, by its offset alone."""
    with files.open_input_file(path) as f:
        f.seek(info.header_offset)
        head = f.read(30)
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            raise OSError(f"no member header at {info.header_offset}")
        name, extra = struct.unpack("<HH", head[26:30])
        f.seek(info.header_offset + 30 + name + extra)
        raw = f.read(info.compress_size)
    if len(raw) < info.compress_size:
        raise OSError(f"short read at {info.header_offset}")
    return payload_of(raw, info)


def payload_of(raw: bytes, info: zipfile.ZipInfo) -> bytes:
    if info.compress_type == zipfile.ZIP_DEFLATED:
        raw = zlib.decompress(raw, -15)
    elif info.compress_type != zipfile.ZIP_STORED:
        raise OSError(f"unknown method {info.compress_type}")
    if len(raw) != info.file_size or zlib.crc32(raw) != info.CRC:
        raise OSError(f"wrong checksum at {info.header_offset}")
    return raw


class MediaReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchbytes", BATCH_BYTES))
        self.retries = int(options.get("retries", RETRIES))
        self.payload = options.get("payload", "true").lower() != "false"

    def partitions(self):
        from pyarrow import fs

        files, root = open_filesystem(self.path)
        listed = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        archives = sorted((x.path, x.size) for x in listed if x.type == fs.FileType.File and x.path.endswith(".zip"))
        out = [ByteRange(path, a, min(a + self.range_bytes, size)) for path, size in archives for a in range(0, max(size, 1), self.range_bytes)]
        return out or [ByteRange("", 0, 0)]

    def _rows(self, part: ByteRange):
        files, _ = open_filesystem(self.path)
        error = None
        for _ in range(self.retries + 1):
            try:
                with files.open_input_file(part.archive) as f, zipfile.ZipFile(f) as z:
                    members = [m for m in z.infolist() if part.start <= m.header_offset < part.end and not m.is_dir()]
                break
            except Exception as e:  # a bad archive is a row, not a lost job
                error = e
        else:
            if part.start == 0:
                yield part.archive, None, None, None, self.retries + 1, f"{type(error).__name__}: {error}"[:300], None
            return
        for m in sorted(members, key=lambda m: m.header_offset):
            payload, error, attempt = None, None, 0
            for attempt in range(1, self.retries + 2) if self.payload else ():
                try:
                    payload, error = read_member(files, part.archive, m), None
                    break
                except Exception as e:  # noqa: BLE001 - the row tells
                    error = f"{type(e).__name__}: {e}"[:300]
            yield part.archive, m.filename, m.header_offset, m.file_size, attempt, error, payload

    def read(self, partition):
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
        held, size = [], 0
        for row in self._rows(partition) if partition.archive else ():
            held.append(row)
            size += len(row[-1] or b"") + 200
            if size >= self.batch_bytes:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)


class MediaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(dict(self.options))


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archive").options(path=path, **{k.replace("_", ""): str(v) for k, v in options.items()}).load()


def write_archives(df: DataFrame, path: str, name: str, payload: str, archive_bytes: int = ARCHIVE_BYTES) -> tuple[int, int]:
    """Pack the payload column (string or binary) into archives under path, members called <number>-<name>. Returns (members, bytes)."""

    def pack(batches):
        from pyspark import TaskContext

        files, root = open_filesystem(path)
        files.create_dir(root, recursive=True)
        task, part, number, written = TaskContext.get().partitionId(), 0, 0, 0
        buffer, archive = io.BytesIO(), None

        def close():
            nonlocal part, written
            archive.close()
            final = f"{root}/part-{task:06d}-{part:04d}.zip"
            with files.open_output_stream(f"{final}.{TaskContext.get().taskAttemptId()}") as out:
                out.write(buffer.getbuffer())
            files.move(f"{final}.{TaskContext.get().taskAttemptId()}", final)
            part += 1
            written += buffer.tell()

        for batch in batches:
            for title, body in zip(batch.column(0), batch.column(1)):
                if not body.is_valid:
                    continue
                if archive is None:
                    buffer = io.BytesIO()
                    archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                archive.writestr(zipfile.ZipInfo(f"{number:08d}" + (f"-{title.as_py()}" if title.is_valid else "")), body.as_py(), zipfile.ZIP_DEFLATED)
                number += 1
                if buffer.tell() >= archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        yield pa.record_batch([pa.array([number]), pa.array([written])], ["members", "bytes"])

    done = df.select(F.col(name).cast("string"), payload).mapInArrow(pack, "members long, bytes long").agg(F.sum("members"), F.sum("bytes")).first()
    return done[0] or 0, done[1] or 0


def media_type(payload):
    """Kind of a payload by its first bytes."""
    head = lambda n: F.hex(F.substring(payload, 1, n))
    return (
        F.when(head(8) == "89504E470D0A1A0A", "image/png").when(head(3) == "FFD8FF", "image/jpeg").when(head(4) == "47494638", "image/gif")
        .when((head(4) == "52494646") & (F.hex(F.substring(payload, 9, 4)) == "57454250"), "image/webp").when((head(4) == "52494646") & (F.hex(F.substring(payload, 9, 4)) == "57415645"), "audio/wav")
        .when(F.lower(F.substring(payload, 1, 14).cast("string")) == "<!doctype html", "text/html").when(F.lower(F.substring(payload, 1, 5).cast("string")) == "<html", "text/html").otherwise("application/octet-stream")
    )


def page_media(pages: DataFrame) -> DataFrame:
    """(page_id, media_type, n_bytes, digest, attempts, error, html): the pages packed into archives and read back as a media column."""
    spark = pages.sparkSession
    path = scratch_path(spark, "archives")
    write_archives(pages, path, "page_id", "html")
    media = read_archives(spark, path)
    return media.select(
        F.when(F.col("member").contains("-"), F.regexp_replace("member", r"^\d+-", "")).cast(pages.schema["page_id"].dataType).alias("page_id"), media_type(F.col("payload")).alias("media_type"), F.col("size").alias("n_bytes"),
        F.sha2("payload", 256).alias("digest"), "attempts", F.coalesce("error", F.lit("")).alias("error"), F.decode("payload", "UTF-8").alias("html"),
    )

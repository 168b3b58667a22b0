"""Folders, text tables, and other formats as sources; formats whose library is absent raise FormatUnavailable."""

from __future__ import annotations

import importlib.util
import io
import struct
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as X

IMAGES = (".jpeg", ".jpg", ".png", ".webp", ".gif")


class FormatUnavailable(RuntimeError):
    """The format needs a library or platform that isn't here; a runner skips the cell."""


@dataclass(frozen=True)
class Dataset:
    """What a data set offers: classes, where it is, how it lies there."""

    name: str
    url: str = ""
    classes: tuple[str, ...] = ()
    layout: str = "folder"
    suffixes: tuple[str, ...] = IMAGES
    options: dict = field(default_factory=dict)


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime); content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root).drop("content")


def class_folder(spark: SparkSession, root: str, classes: tuple[str, ...] | None = None, suffixes: tuple[str, ...] | None = None, check: bool = False) -> DataFrame:
    """(path, label, length, content, object_metadata) of root/<label>/<file>; hidden files skipped.

    check: the labels found must be exactly the classes."""
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*")
    out = files.select("path", X.parent_name(F.col("path")).alias("label"), "length", "content")
    out = out.where(~X.base_name(F.col("path")).startswith("._"))
    if suffixes:
        out = out.where(X.extension(F.col("path")).isin(*suffixes))
    if classes:
        if check:
            found = sorted(r[0] for r in out.select("label").distinct().collect())
            if found != sorted(classes):
                raise ValueError(f"classes {found}, not {sorted(classes)}")
        out = out.where(F.col("label").isin(*classes))
    return out.withColumn("object_metadata", F.encode(F.to_json(F.struct("label")), "UTF-8"))


def video_folder(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".avi", ".mp4", ".mkv")) -> DataFrame:
    """Label is the directory, else the second part of a stem like v_Label_g01."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    part = F.get(F.split(X.stem(F.col("path")), "_"), F.lit(1))
    label = F.coalesce(F.nullif(X.parent_name(F.col("path")), F.lit(root.rstrip("/").split("/")[-1])), part)
    return files.where(X.extension(F.col("path")).isin(*suffixes)).select("path", label.alias("label"), "length", "content")


def zip_members(spark: SparkSession, path: str, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """(archive, name, payload) without directories and resource forks."""
    from .tar import opened

    def explode(batches):
        for batch in batches:
            for where in batch.column(0).to_pylist():
                with opened(where) as f, zipfile.ZipFile(f) as z:
                    for m in z.infolist():
                        base = m.filename.rsplit("/", 1)[-1]
                        if not m.is_dir() and not base.startswith("._") and "__MACOSX/" not in m.filename and (not suffixes or base.lower().endswith(tuple(suffixes))):
                            yield pa.record_batch([pa.array([where]), pa.array([m.filename]), pa.array([z.read(m)], pa.binary())], ["archive", "name", "payload"])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(explode, "archive string, name string, payload binary")


def json_lines(spark: SparkSession, path: str, schema: str, text: str = "text") -> DataFrame:
    """Rows of JSON lines with a text that isn't empty."""
    return spark.read.schema(schema).json(path).where(F.length(text) > 0)


def labelled_text(rows: DataFrame, title: str, body: str, label: str, source: str) -> DataFrame:
    """(path, text, label, payload, object_metadata) of titled texts; empty ones are skipped."""
    text = X.title_and_body(F.col(title), F.col(body))
    own = rows.select(text.alias("text"), F.col(label).cast("string").alias("label")).where(F.length("text") > 0)
    meta = F.struct("label", F.lit(source).alias("source"), F.char_length("text").alias("text_len"))
    return own.withColumn("payload", F.encode("text", "UTF-8")).withColumn("object_metadata", F.encode(F.to_json(meta), "UTF-8"))


def speech(rows: DataFrame) -> DataFrame:
    """(payload, object_metadata) of recordings with label, speaker and text; empty payloads are skipped."""
    return rows.where(F.octet_length("payload") > 0).withColumn("object_metadata", F.encode(F.to_json(F.struct("label", "speaker", "text")), "UTF-8"))


def metric_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text; numbers are read by lenient casts where they are used."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def metric_json(rows: DataFrame, column: str) -> DataFrame:
    """counters, gauges and histograms of recorded snapshots; unreadable ones are empty."""
    kind = "struct<counters: map<string, bigint>, gauges: map<string, double>, histograms: map<string, struct<count: bigint, p50: double, p95: double, p99: double, max: double>>>"
    return rows.withColumn("snapshot", F.from_json(column, kind)).select("*", "snapshot.*").drop("snapshot")


def parquet_images(spark: SparkSession, path: str, column: str = "image") -> DataFrame:
    """Image cells {bytes, path} as payload and kind."""
    return spark.read.parquet(path).select(F.col(f"{column}.path").alias("path"), F.col(f"{column}.bytes").alias("payload"), X.image_kind(F.col(f"{column}.bytes")).alias("kind"))


def synthetic(spark: SparkSession, n: int, size: int, pool: int = 256, seed: int = 0, classes: int = 10) -> DataFrame:
    """n samples that cycle through a seeded pool; each payload is a function of (seed, slot)."""
    slot = F.pmod("id", F.lit(pool))
    block = F.unhex(F.sha2(F.concat_ws(":", F.lit(str(seed)), slot.cast("string")), 256))
    return spark.range(n).select("id", slot.alias("slot"), F.pmod(slot, F.lit(classes)).cast("int").alias("label"), F.substring(F.encode(F.repeat(F.hex(block), size // 64 + 1), "UTF-8"), 1, size).alias("payload"))


def _crc_table():
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


def masked_crc(data: bytes, table: list[int]) -> int:
    """CRC-32C as record files store it."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = table[(crc ^ b) & 255] ^ crc >> 8
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17 & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 127) << shift
        at += 1
        if b < 128:
            return value, at
        shift += 7


def _delimited(number: int, raw: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def encode_example(features: dict[str, bytes]) -> bytes:
    """A tf.train.Example of byte lists."""
    entries = b"".join(_delimited(1, _delimited(1, k.encode()) + _delimited(2, _delimited(1, _delimited(1, v)))) for k, v in features.items())
    return _delimited(1, entries)


def _fields(raw: bytes):
    at = 0
    while at < len(raw):
        tag, at = _read_varint(raw, at)
        if tag & 7 == 2:
            n, at = _read_varint(raw, at)
            yield tag >> 3, raw[at : at + n]
            at += n
        elif tag & 7 == 0:
            _, at = _read_varint(raw, at)
        else:
            at += 8 if tag & 7 == 1 else 4


def decode_example(raw: bytes) -> dict[str, bytes]:
    out = {}
    for _, features in _fields(raw):
        for _, entry in _fields(features):
            parts = dict(_fields(entry))
            lists = dict(_fields(parts.get(2, b"")))
            if 1 in lists:
                out[parts[1].decode()] = dict(_fields(lists[1])).get(1, b"")
    return out


def frame_record(raw: bytes, table: list[int]) -> bytes:
    head = struct.pack("<Q", len(raw))
    return head + struct.pack("<I", masked_crc(head, table)) + raw + struct.pack("<I", masked_crc(raw, table))


def record_files(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """(file, image, label) of TFRecord files of Examples; files are streamed, in batches of bounded size."""
    from .tar import BATCH_BYTES, filesystem

    def explode(batches):
        table = _crc_table() if verify else None
        made = lambda where, images, labels: pa.record_batch([pa.array([where] * len(images), pa.string()), pa.array(images, pa.binary()), pa.array(labels, pa.string())], ["file", "image", "label"])
        for batch in batches:
            for where in batch.column(0).to_pylist():
                at, held, images, labels = 0, 0, [], []
                files, name = filesystem(where)
                with files.open_input_stream(name, compression=None, buffer_size=1 << 20) as f:
                    while head := f.read(12):
                        n = struct.unpack("<Q", head[:8])[0] if len(head) == 12 else 0
                        raw, crc = f.read(n), f.read(4)
                        if len(head) < 12 or len(raw) < n or len(crc) < 4:
                            raise ValueError(f"{where} ends inside the record at {at}")
                        if verify and masked_crc(raw, table) != struct.unpack("<I", crc)[0]:
                            raise ValueError(f"wrong checksum in {where} at {at}")
                        example = decode_example(raw)
                        images.append(example.get("image"))
                        labels.append(example.get("label", b"").decode())
                        at += 16 + n
                        held += n + 200
                        if held >= BATCH_BYTES:
                            yield made(where, images, labels)
                            held, images, labels = 0, [], []
                yield made(where, images, labels)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(explode, "file string, image binary, label string")


def arrow_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of Arrow stream or file-format files (*.arrow)."""
    from .tar import opened

    def explode(batches):
        for batch in batches:
            for where in batch.column(0).to_pylist():
                with opened(where) as f:
                    try:
                        reader = pa.ipc.open_file(f)
                    except pa.ArrowInvalid:
                        f.seek(0)
                        yield from pa.ipc.open_stream(f)
                    else:
                        yield from (reader.get_batch(i) for i in range(reader.num_record_batches))

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(path).select("path").mapInArrow(explode, schema)


def _needs(library: str, what: str) -> Callable:
    def read(*args, **options):
        if importlib.util.find_spec(library) is None:
            raise FormatUnavailable(f"{what} needs {library}")
        raise FormatUnavailable(f"{what} is not served from here")

    return read


def keyed_store(spark: SparkSession, path: str) -> DataFrame:
    """(key, payload, label) of an LMDB of {data, label} records, read by one task per environment."""
    if importlib.util.find_spec("lmdb") is None:
        raise FormatUnavailable("LMDB needs lmdb")

    def read(batches):
        import json

        import lmdb

        for batch in batches:
            for where in batch.column(0).to_pylist():
                with lmdb.open(where, readonly=True, lock=False).begin() as txn:
                    for key, value in txn.cursor():
                        item = json.loads(value)
                        yield pa.record_batch([pa.array([key.decode()]), pa.array([bytes.fromhex(item["data"])], pa.binary()), pa.array([str(item["label"])])], ["key", "payload", "label"])

    return spark.createDataFrame([(path,)], "path string").mapInArrow(read, "key string, payload binary, label string")


def hierarchical(spark: SparkSession, path: str) -> DataFrame:
    """(payload, label) of HDF5 files with datasets data (bytes of any length) and labels."""
    if importlib.util.find_spec("h5py") is None:
        raise FormatUnavailable("HDF5 needs h5py")

    def read(batches):
        import h5py

        for batch in batches:
            for content in batch.column(0):
                with h5py.File(io.BytesIO(content.as_buffer()), "r") as f:
                    yield pa.record_batch([pa.array([bytes(x) for x in f["data"]], pa.binary()), pa.array([str(x) for x in f["labels"]])], ["payload", "label"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, "payload binary, label string")


READERS: dict[str, Callable] = {
    "class_folder": class_folder, "video_folder": video_folder, "zip": zip_members, "json_lines": json_lines, "parquet_images": parquet_images, "synthetic": synthetic,
    "tfrecord": record_files, "arrow": arrow_files, "metric_csv": metric_csv, "lmdb": keyed_store, "hdf5": hierarchical, "beton": _needs("ffcv", "The beton format"),
}


def reader(name: str) -> Callable:
    if name not in READERS:
        raise FormatUnavailable(f"no reader {name}")
    return READERS[name]

"""The mutation log and transactions as checked binary records, for exchange with other programs.

A log file is MAGIC, a version byte, and records: kind (1 add, 2 delete), length, body, CRC-64 of kind, length and body. Numbers are LEB128; an add's body is path, shard,
offset, size and metadata, a delete's is the path, texts with their length before them. A transaction file is TXN, version, flags, number of operations, operations.
A file that ends between records is whole; anything else that doesn't fit is an error that names the place.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .files import _read_varint, _varint
from .tar import filesystem

MAGIC, TXN, VERSION = bytes.fromhex("D5F5574C"), b"SWTX", 1
ADD, DELETE, RENAME = 1, 2, 3
SCHEMA = "seq long, op string, path string, shard_id long, offset long, size long, meta binary"


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xD800000000000000 if n & 1 else 0)
        out.append(n)
    return out


_TABLE = _crc_table()


def crc64(data: bytes) -> int:
    """CRC-64 of ISO 3309: reflected, all ones before and after."""
    crc = (1 << 64) - 1
    for b in data:
        crc = _TABLE[(crc ^ b) & 255] ^ crc >> 8
    return crc ^ (1 << 64) - 1


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else -n * 2 - 1


def unzigzag(n: int) -> int:
    return n >> 1 if n & 1 == 0 else -(n + 1 >> 1)


def _text(raw: bytes) -> bytes:
    return _varint(len(raw)) + raw


def encode_record(op: str, path: str, shard: int = 0, offset: int = 0, size: int = 0, meta: bytes | None = None) -> bytes:
    kind = {"add": ADD, "delete": DELETE}[op]
    body = _text(path.encode())
    if kind == ADD:
        body += _varint(zigzag(shard)) + _varint(offset) + _varint(size) + _text(meta or b"")
    raw = bytes([kind]) + _varint(len(body)) + body
    return raw + struct.pack(">Q", crc64(raw))


def decode_records(raw: bytes):
    """(op, path, shard, offset, size, meta) of a log file."""
    if raw[:5] != MAGIC + bytes([VERSION]):
        raise ValueError("no log of this version")
    at = 5
    while at < len(raw):
        begin = at
        try:
            kind = raw[at]
            n, body = _read_varint(raw, at + 1)
            at = body + n + 8
            (crc,) = struct.unpack(">Q", raw[body + n : at])
        except (IndexError, struct.error):
            raise ValueError(f"the record at {begin} is cut off") from None
        if crc != crc64(raw[begin : body + n]) or kind not in (ADD, DELETE):
            raise ValueError(f"the record at {begin} is damaged")
        size, p = _read_varint(raw, body)
        path, p = raw[p : p + size].decode(), p + size
        if kind == DELETE:
            yield "delete", path, None, None, None, None
            continue
        shard, p = _read_varint(raw, p)
        offset, p = _read_varint(raw, p)
        length, p = _read_varint(raw, p)
        size, p = _read_varint(raw, p)
        yield "add", path, unzigzag(shard), offset, length, raw[p : p + size]


def write_binary_log(records: DataFrame, root: str) -> None:
    """records (seq, op, path, shard_id, offset, size, meta) as files root/<first seq>.wal in order of seq, one a range."""

    def write(batches):
        files, base = filesystem(root)
        files.create_dir(base, recursive=True)
        out, n = None, 0
        for batch in batches:
            for seq, op, path, shard, offset, size, meta in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{base}/{seq:020d}.wal"
                    out = files.open_output_stream(f"{name}.part")
                    out.write(MAGIC + bytes([VERSION]))
                out.write(encode_record(op, path, shard or 0, offset or 0, size or 0, meta))
                n += 1
        if out is not None:
            out.close()
            files.move(f"{name}.part", name)
        yield pa.record_batch([pa.array([n])], ["n"])

    ordered = records.select("seq", "op", "path", "shard_id", "offset", "size", "meta").repartitionByRange("seq").sortWithinPartitions("seq")
    ordered.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def read_binary_log(spark: SparkSession, root: str) -> DataFrame:
    """SCHEMA of all log files; seq is the first one of the file plus the place of the record in it where files number their records without gaps."""

    def read(batches):
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first = int(where.rsplit("/", 1)[-1].split(".")[0])
                rows = list(decode_records(content))
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(range(first, first + len(rows)), pa.int64()), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(root).select("path", "content").mapInArrow(read, SCHEMA)


def encode_transaction(ops: list[tuple]) -> bytes:
    """ops: ('put', path, staged name), ('delete', path) or ('rename', path, target)."""
    out = TXN + bytes([VERSION, 0]) + _varint(len(ops))
    for op, *args in ops:
        out += bytes([{"put": ADD, "delete": DELETE, "rename": RENAME}[op]]) + b"".join(_text(a.encode()) for a in args)
    return out


def decode_transaction(raw: bytes) -> list[tuple]:
    if raw[:4] != TXN or len(raw) < 6 or raw[4] != VERSION:
        raise ValueError("no transaction of this version")
    try:
        n, at = _read_varint(raw, 6)
        out = []
        for _ in range(n):
            op = {ADD: "put", DELETE: "delete", RENAME: "rename"}[raw[at]]
            args, at = [], at + 1
            for _ in range(1 if op == "delete" else 2):
                size, at = _read_varint(raw, at)
                if at + size > len(raw):
                    raise IndexError
                args.append(raw[at : at + size].decode())
                at += size
            out.append((op, *args))
    except (IndexError, KeyError):
        raise ValueError(f"the transaction is damaged at {at}") from None
    if at != len(raw):
        raise ValueError(f"{len(raw) - at} bytes behind the transaction")
    return out

"""Writers: tar shards, WebDataset-style archives, record files, class folders, tables, reports.

Each archive is written by one task under another name and renamed, so a task that runs again replaces its own file.
"""

from __future__ import annotations

import io
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as X
from .files import _crc_table, encode_example, frame_record
from .tar import filesystem, pieces


def write_shards(packed: DataFrame, root: str, trailer: bool = True) -> DataFrame:
    """Write objects (path, shard_id, offset, size, payload) to root/shard_<id>; returns (shard_id, total_size), the data extent.

    Shuffled by shard, sorted by offset inside: rows stream into the file, no shard is held in memory."""
    own = packed.select("path", "shard_id", "offset", "payload").repartition("shard_id").sortWithinPartitions("shard_id", "offset")

    def write(batches):
        from pyspark import TaskContext

        files, base = filesystem(root)
        files.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        now, out, end, done = None, None, 0, []

        def close():
            nonlocal out
            if out is not None:
                if trailer:
                    out.write(bytes(1024))
                out.close()
                files.move(f"{base}/shard_{now}.tmp.{attempt}", f"{base}/shard_{now}")
                done.append((now, end))

        for batch in pieces(batches):
            for path, shard, offset, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    close()
                    now, end = shard, 0
                    out = files.open_output_stream(f"{base}/shard_{now}.tmp.{attempt}")
                if offset - 512 != end:
                    raise ValueError(f"{path}: offset {offset} in shard {shard}, which has {end} bytes")
                info = tarfile.TarInfo(path)
                info.size = len(payload)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                out.write(head[:512] if len(head) == 512 else tarfile.TarInfo(path[-100:]).tobuf(tarfile.USTAR_FORMAT))
                out.write(payload)
                out.write(bytes(-len(payload) % 512))
                end += 512 + len(payload) + -len(payload) % 512
        close()
        yield pa.record_batch([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.int64())], ["shard_id", "total_size"])

    from ..storage import materialize

    return materialize(own.mapInArrow(write, "shard_id int, total_size long"), "written")


def append_tar(payloads: list[tuple[str, bytes]]) -> tuple[bytes, list[int]]:
    """A delta's bytes: for each object header, payload, padding and a trailer; and the payload offsets."""
    out, offsets = io.BytesIO(), []
    for path, payload in payloads:
        info = tarfile.TarInfo(path)
        info.size = len(payload)
        out.write(info.tobuf(tarfile.USTAR_FORMAT))
        offsets.append(out.tell())
        out.write(payload + bytes(-len(payload) % 512) + bytes(1024))
    return out.getvalue(), offsets


WEB_TARGET = 500 << 20


def webdataset_shards(samples: DataFrame, order: list[str], target: int = WEB_TARGET) -> DataFrame:
    """samples (ext, payload, label, ...) with ordinal in the order and shard, a new one as soon as payload bytes would pass target.

    The rule is sequential at any size: only (ordinal, size) goes through its one task, 24 bytes a sample."""
    from ..operators.ordered import numbered
    from ..operators.packing import pack

    sized = numbered(samples.select(*order, F.octet_length("payload").cast("long").alias("__size")), order, 18, "__index").withColumn("ordinal", F.col("__index").cast("long"))
    placed = pack(sized, ["ordinal"], "ordinal", "__size", "flat", target)
    keyed = sized.join(placed.select("ordinal", "shard"), "ordinal").select(*order, "ordinal", "shard")
    return samples.join(keyed, order)


def webdataset_index(written: DataFrame, path: str) -> None:
    """CSV of name and shard."""
    written.select("name", "shard").write.mode("overwrite").option("header", True).csv(path)


def web_staging(files: DataFrame, max_bytes: int) -> DataFrame:
    """Archives (name, length) in order of name while their bytes stay within max_bytes, the first always."""
    from ..operators.ordered import byte_prefix

    return byte_prefix(files, ["name"], "length", max_bytes)


def write_class_files(samples: DataFrame, root: str) -> int:
    """Payloads as files root/<label>/<name>; each is written aside and renamed. Returns the files."""

    def write(batches):
        files, base = filesystem(root)
        made, n = set(), 0
        for batch in batches:
            for label, name, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if label not in made:
                    files.create_dir(f"{base}/{label}", recursive=True)
                    made.add(label)
                with files.open_output_stream(f"{base}/{label}/._{name}.part") as out:
                    out.write(payload)
                files.move(f"{base}/{label}/._{name}.part", f"{base}/{label}/{name}")
                n += 1
        yield pa.record_batch([pa.array([n])], ["n"])

    own = samples.select(F.col("label").cast("string"), "name", "payload")
    return own.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def write_webdataset(samples: DataFrame, root: str) -> DataFrame:
    """Archives of <key>.<ext> and <key>.cls from samples (shard, ordinal, ext, payload, label); returns (name, shard), the index of names."""
    ext = F.regexp_replace(F.lower("ext"), r"^\.?(jpeg|jpe|jpg)$", "jpg")
    own = samples.select("shard", F.lpad(F.col("ordinal").cast("string"), 8, "0").alias("key"), F.ltrim(ext, F.lit(".")).alias("ext"), "payload", F.col("label").cast("string").alias("label"))
    own = own.repartition("shard").sortWithinPartitions("shard", "key")

    def write(batches):
        from pyspark import TaskContext

        files, base = filesystem(root)
        files.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        now, stream, tar = None, None, None

        def close():
            if tar is not None:
                tar.close()
                stream.close()
                files.move(f"{base}/shard-{now:06d}.tar.{attempt}", f"{base}/shard-{now:06d}.tar")

        for batch in pieces(batches):
            names = []
            for shard, key, kind, payload, label in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    close()
                    now = shard
                    stream = files.open_output_stream(f"{base}/shard-{now:06d}.tar.{attempt}")
                    tar = tarfile.open(fileobj=stream, mode="w|", format=tarfile.USTAR_FORMAT)
                for name, raw in ((f"{key}.{kind}", payload), (f"{key}.cls", label.encode())):
                    info = tarfile.TarInfo(name)
                    info.size = len(raw)
                    tar.addfile(info, io.BytesIO(raw))
                    tar.members = []  # it would keep all headers
                names.append((f"{key}.{kind}", shard))
            yield pa.record_batch([pa.array([n[0] for n in names], pa.string()), pa.array([n[1] for n in names], pa.int64())], ["name", "shard"])
        close()

    from ..storage import materialize

    return materialize(own.mapInArrow(write, "name string, shard long"), "webdataset")


def write_record_files(samples: DataFrame, root: str, index: bool = False) -> int:
    """TFRecord files of {image, label} Examples, one per partition of samples (payload, label). Returns the records.

    index: also root_index/<part>.idx, a line 'offset size' for each record."""

    def write(batches):
        from pyspark import TaskContext

        files, base = filesystem(root)
        files.create_dir(base, recursive=True)
        table, task, n = _crc_table(), TaskContext.get(), 0
        name = f"{base}/part-{task.partitionId():06d}.tfrecord"
        at, places, idx = 0, None, f"{base}_index/part-{task.partitionId():06d}.idx"
        aside = f"{base}_index/._{task.partitionId():06d}.{task.taskAttemptId()}"
        if index:
            files.create_dir(f"{base}_index", recursive=True)
            places = files.open_output_stream(aside, buffer_size=1 << 16)
        with files.open_output_stream(f"{name}.{task.taskAttemptId()}") as out:
            for batch in pieces(batches):
                for payload, label in zip(*(c.to_pylist() for c in batch.columns)):
                    raw = frame_record(encode_example({"image": payload, "label": label.encode()}), table)
                    out.write(raw)
                    if index:
                        places.write(b"%d %d\n" % (at, len(raw)))
                    at += len(raw)
                    n += 1
        if index:
            places.close()
            files.move(aside, idx)
        files.move(f"{name}.{task.taskAttemptId()}", name)
        yield pa.record_batch([pa.array([n])], ["n"])

    return samples.select("payload", F.col("label").cast("string")).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def write_labelled(samples: DataFrame, path: str) -> None:
    """Parquet with class ids in the order of the sorted labels."""
    from ..operators.sets import label_index, with_label_index

    with_label_index(samples, "label", label_index(samples, "label")).write.mode("overwrite").parquet(path)


def write_class_folder(samples: DataFrame, path: str) -> None:
    """Payloads by label: one directory a class, files in Parquet."""
    samples.write.mode("overwrite").partitionBy("label").parquet(path)


def write_text(rows: DataFrame, path: str, compression: str = "zstd") -> None:
    rows.select("path", "text", "label").write.mode("overwrite").option("compression", compression).parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """One table of all columns; missing cells are empty."""
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def combined(spark: SparkSession, cells: list[tuple[dict, DataFrame]]) -> DataFrame:
    """Rows of all cells of a sweep with the cell's axis_* columns."""
    from ..operators.sets import union_rows

    return union_rows(*[df.withColumns({f"axis_{k}": F.lit(v) for k, v in axes.items()}) for axes, df in cells])


def markdown(df: DataFrame, digits: int = 2) -> str:
    """A small result as a Markdown table; aggregates only come here."""
    shown = df.select(*[X.fixed(F.col(n), digits).alias(n) if t == "double" else F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n, t in df.dtypes])
    rows = [df.columns, ["---"] * len(df.columns), *[list(r) for r in shown.toLocalIterator()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n"


def subset(objects: DataFrame, shards: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Base shards in order while their total stays within max_bytes (the first always), with their live objects."""
    from ..operators.ordered import byte_prefix

    kept = byte_prefix(shards.where("number >= 0"), ["number"], "total_size", max_bytes)
    return objects.where("not deleted").join(kept.select(F.col("number").alias("shard_id")), "shard_id", "left_semi"), kept

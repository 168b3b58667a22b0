"""Line deduplication by two Bloom filters.

Of lines that occur more than once in the corpus only the first occurrence stays, in the order (doc_id, text hash, line
number). Filter A holds the hashes seen once, filter B those seen twice; only lines that B suspects are shuffled, compared
as text, and given a first occurrence.

Cases: blank lines always stay. A null text counts as one with no line and stays null. A null doc_id sorts first. Rows with the same
doc_id and text are one document and get the same result. A document that loses all its lines has the text '' (or is
dropped with drop_emptied). Other columns are passed on, whatever their names; n_chars is counted anew where it exists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import BROADCAST_BYTES, Hasher, flat, free_names, lines, mix, pieces, runs, take_spans

SEGMENT_BITS = 1 << 20
BITS_PER_LINE = 12
PROBES = 4


def bit_positions(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment of each hash, its PROBES bits in that segment)."""
    segment = (hashes >> np.uint64(40)) % np.uint64(segments)
    one, two = mix(hashes), mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    with np.errstate(over="ignore"):
        bits = (one[:, None] + two[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(SEGMENT_BITS - 1)
    return segment.astype(np.int64), bits.astype(np.int64)


class TwoBlooms:
    """Filters of hashes seen once and twice, by segment; adding two of them is commutative and associative."""

    def __init__(self, segments: int) -> None:
        self.segments, self.once, self.twice = segments, {}, {}

    def add(self, hashes: np.ndarray, twice: np.ndarray | None = None) -> None:
        """Hashes of one batch. Those that repeat in the batch, are known as seen twice, or whose bits are all set in A, go to B."""
        by = np.argsort(hashes)
        at = runs(hashes[by])
        count, hashes = np.diff(at), hashes[by[at[:-1]]] if len(by) else hashes
        if twice is not None and len(by):
            count = count + np.maximum.reduceat(twice[by].astype(np.int64), at[:-1])
        segment, bits = bit_positions(hashes, self.segments)
        order = np.argsort(segment, kind="stable")
        segment, bits, count = segment[order], bits[order], count[order]
        edge = runs(segment)
        for a, b in zip(edge[:-1], edge[1:]):
            s = int(segment[a])
            if s not in self.once:
                self.once[s], self.twice[s] = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
            own = bits[a:b]
            again = self.once[s][own].all(1) | (count[a:b] > 1)
            self.twice[s][own[again].ravel()] = True
            self.once[s][own.ravel()] = True

    def rows(self) -> pa.RecordBatch:
        pack = lambda x: [np.packbits(v).tobytes() for v in x.values()]
        return pa.record_batch([pa.array(list(self.once), pa.int32()), pa.array(pack(self.once), pa.binary()), pa.array(pack(self.twice), pa.binary())], ["segment", "once", "twice"])


def merge_filters(table: pa.Table) -> pa.Table:
    """One segment's filters of all tasks: B takes what both of two A's hold."""
    once = np.zeros(SEGMENT_BITS // 8, np.uint8)
    twice = np.zeros(SEGMENT_BITS // 8, np.uint8)
    for a, b in zip(table.column("once"), table.column("twice")):
        a, b = np.frombuffer(a.as_py(), np.uint8), np.frombuffer(b.as_py(), np.uint8)
        twice |= b | (once & a)
        once |= a
    return pa.table([table.column("segment").slice(0, 1), pa.array([twice.tobytes()], pa.binary())], ["segment", "twice"])


def suspected(hashes: np.ndarray, segments: int, twice: np.ndarray) -> np.ndarray:
    segment, bits = bit_positions(hashes, segments)
    at = segment[:, None] * SEGMENT_BITS + bits
    return ((twice[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)


SUSPECTS = "line string, doc_id long, text_hash long, line_no int, lost boolean"


def _suspects(batch: pa.RecordBatch, hasher: Hasher, chosen) -> pa.RecordBatch:
    """Suspected lines of a batch; of equal ones in the batch only the first travels as text, the others are lost already."""
    hashes, doc, number, start, end, raw = lines(batch.column(1), hasher)
    keep = np.flatnonzero(chosen(hashes)) if chosen else np.arange(len(hashes))
    line = take_spans(raw, start[keep], end[keep])
    ids = np.asarray(batch.column(0).fill_null(np.iinfo(np.int64).min))[doc[keep]]
    text_hash = np.asarray(batch.column(2))[doc[keep]]
    number = number[keep]
    code = np.asarray(line.dictionary_encode().indices) if len(line) else np.zeros(0, np.int32)
    order = np.lexsort((number, text_hash, ids, code))
    sorted_code = code[order]
    lost = np.zeros(len(code), bool)
    if len(code):
        same = np.zeros(len(code), bool)
        same[1:] = sorted_code[1:] == sorted_code[:-1]
        # a repeated row is the same document: its line is no later occurrence
        twin = np.zeros(len(code), bool)
        o = order
        twin[1:] = same[1:] & (ids[o][1:] == ids[o][:-1]) & (text_hash[o][1:] == text_hash[o][:-1]) & (number[o][1:] == number[o][:-1])
        head = np.maximum.accumulate(np.where(~same, np.arange(len(code)), 0))
        chain = np.maximum.accumulate(np.where(~twin, np.arange(len(code)), 0))
        lost[order] = chain != head
    mask = pa.array(lost)
    return pa.record_batch(
        [pc.if_else(mask, pa.scalar(None, pa.string()), line), pa.array(ids, pa.int64(), mask=ids == np.iinfo(np.int64).min), pa.array(text_hash, pa.int64()), pa.array(number, pa.int32()), mask],
        ["line", "doc_id", "text_hash", "line_no", "lost"],
    )


def suspect_lines(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Lines that may occur more than once (SUSPECTS).

    The filters take BITS_PER_LINE bits a line. Up to broadcast_bytes filter B is broadcast. Beyond that the filters stay
    apart: line hashes go to the owner of their range, which builds both filters for it, and only the places of suspected lines
    return to their documents. Of equal lines in a slice of 4 MB of text only the first goes to the owner, with the
    news that it was seen twice; the others are suspected as they are, so a line that is everywhere fills no owner.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    feeds = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    count = docs.agg(F.coalesce(F.sum(feeds), F.lit(0))).first()[0]
    segments = max(1, -(-count * BITS_PER_LINE // SEGMENT_BITS))
    if segments * SEGMENT_BITS // 8 <= broadcast_bytes:

        def build(batches):
            hasher, filters = Hasher(), TwoBlooms(segments)
            for batch in pieces(batches, 0):
                filters.add(lines(batch.column(0), hasher)[0])
            yield filters.rows()

        merged = docs.select("text").mapInArrow(build, "segment int, once binary, twice binary").groupBy("segment").applyInArrow(merge_filters, "segment int, twice binary")
        twice = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
        for row in merged.toLocalIterator():
            twice[row.segment] = np.frombuffer(row.twice, np.uint8)
        shared = spark.sparkContext.broadcast(twice.ravel())

        def find(batches):
            hasher, bits = Hasher(), shared.value
            for batch in pieces(batches, 1):
                yield _suspects(batch, hasher, lambda h: suspected(h, segments, bits))

        return source.mapInArrow(find, SUSPECTS)

    def places(batches):
        hasher = Hasher()
        for batch in pieces(batches, 1):
            hashes, doc, number, *_ = lines(batch.column(1), hasher)
            by = np.argsort(hashes, kind="stable")
            edge = runs(hashes[by])
            first = np.zeros(len(hashes), bool)
            first[by[edge[:-1]]] = True
            twice = np.zeros(len(hashes), bool)
            twice[by] = np.repeat(np.diff(edge) > 1, np.diff(edge))
            # suspected as they are: spread by their place
            owner = np.where(first, hashes, mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + number.astype(np.uint64)))
            yield pa.record_batch(
                [pa.array(owner.view(np.int64)), pa.array(first), pa.array(twice), batch.column(0).take(pa.array(doc)), batch.column(2).take(pa.array(doc)), pa.array(number, pa.int32())],
                ["h", "first", "twice", "doc_id", "text_hash", "line_no"],
            )

    def check(batches):
        # only first places have a say; they are as many as a slice has distinct lines
        kept = []
        for batch in batches:
            first = batch.column(1)
            yield batch.filter(pc.invert(first)).select(["doc_id", "text_hash", "line_no"])
            kept.append(batch.filter(first))
        filters = TwoBlooms(max(1, -(-sum(b.num_rows for b in kept) * BITS_PER_LINE // SEGMENT_BITS)))
        for b in kept:
            filters.add(np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(2)))
        bits = np.zeros((filters.segments, SEGMENT_BITS // 8), np.uint8)
        for s, v in filters.twice.items():
            bits[s] = np.packbits(v)
        for b in kept:
            hit = suspected(np.asarray(b.column(0)).view(np.uint64), filters.segments, bits.ravel())
            yield b.filter(pa.array(hit)).select(["doc_id", "text_hash", "line_no"])

    parts = max(spark.sparkContext.defaultParallelism, -(-count // 4_000_000))
    placed = source.mapInArrow(places, "h long, first boolean, twice boolean, doc_id long, text_hash long, line_no int")
    found = placed.repartition(parts, "h").mapInArrow(check, "doc_id long, text_hash long, line_no int").distinct()
    owners = found.groupBy("doc_id", "text_hash").agg(F.collect_list("line_no").alias("at")).withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    texts = source.join(owners, source.doc_id.eqNullSafe(owners.d) & (source.text_hash == owners.t)).select("doc_id", "text", "text_hash", "at")

    def text_of(batches):
        hasher = Hasher()
        for batch in pieces(batches, 1):
            at = [set(x) for x in batch.column(3).to_pylist()]
            _, doc, number, *_ = lines(batch.column(1), hasher)
            mask = np.fromiter((n in at[d] for d, n in zip(doc.tolist(), number.tolist())), bool, len(doc))
            yield _suspects(batch, hasher, lambda h, mask=mask: mask)

    return texts.mapInArrow(text_of, SUSPECTS)


def repeated_lines(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text_hash, line_no) of each line that occurred before."""
    found = suspect_lines(docs, broadcast_bytes)
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text_hash", "line_no")
    # text hashes compare as signed numbers in both engines
    live = found.where(~F.col("lost")).select("line", place.alias("place"), "doc_id", "text_hash", "line_no")
    first = live.groupBy("line").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = live.join(first, "line").where(F.col("place") != F.col("first"))
    return later.select("doc_id", "text_hash", "line_no").unionByName(found.where("lost").select("doc_id", "text_hash", "line_no"))


def without_lines(batches):
    """Drop the lines numbered in the last column from the text in the first one."""
    for batch in pieces(batches, 0):
        raw, offsets = flat(batch.column(0))
        drop = batch.column(batch.num_columns - 1)
        text = batch.column(0).cast(pa.string()).to_pylist()
        for i in np.flatnonzero(~np.asarray(drop.is_null())):
            gone = np.asarray(drop[int(i)].values)
            each = raw[offsets[i] : offsets[i + 1]].tobytes().decode().split("\n")
            keep = np.ones(len(each), bool)
            keep[gone] = False
            text[i] = "\n".join([each[k] for k in np.flatnonzero(keep)])
        yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), *batch.columns[1:-1]], names=batch.schema.names[:-1])


def dedup_lines(docs: DataFrame, drop_emptied: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents without repeated lines, columns as in docs. drop_emptied: without those that had lines and lost all of them."""
    names = docs.columns
    doc, hashed, own, gone, cut = free_names(names, "doc", "hash", "own", "gone", "cut")
    drop = repeated_lines(docs, broadcast_bytes).groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(hashed)).agg(F.array_distinct(F.collect_list("line_no")).alias(gone))
    rest = [n for n in names if n != "text"]
    texts = docs.select("text", *[F.col(f"`{n}`") for n in rest], F.xxhash64("text").alias(own))
    joined = texts.join(drop, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(hashed)), "left")
    edited = joined.select("text", *[F.col(f"`{n}`") for n in rest], F.col(gone).isNotNull().alias(cut), gone)
    out = edited.mapInArrow(without_lines, edited.drop(gone).schema)
    if drop_emptied:
        # blank as the kernel has it: ASCII white space only
        out = out.where(~(F.col(cut) & (F.trim(F.translate("text", "\n\t\r\v\f", "     ")) == "")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{n}`") for n in names])

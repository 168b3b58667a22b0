"""Near-duplicate groups by improved consistent weighted sampling over TF-IDF shingles.

A document is a weighted set: each run of `k` words (all its words if it has fewer) weighs its count times the mean IDF of its
words. `bands` x `rows` consistent samples make the band keys; documents that share a band key are compared by one byte of
each sample, and pairs that may reach the threshold are verified by their exact weighted Jaccard similarity. Groups are the
connected components of verified pairs and of equal texts.

IDF counts documents per word over the whole corpus, in 2**DF_BITS hash buckets, so that the table is broadcast at one size for
any corpus; words that share a bucket share its count.

Within a band key pairs are found without a cap: members whose estimate to the first one is clear link to it, every other member is compared with
all members. Where a clear pair then fails the exact test, its member is compared with all members of its band keys, too. A band key of more than HOT
texts is spread first: each member meets the first one by a join, clear ones link to it, and all go apart by each of SPLITS other samples, so that a
pair of similarity s comes together again but for a chance of (1 - s) ** SPLITS (one in 65,536 at 0.5); there members that aren't clear are held
and all others stream past them.

What can be missed: pairs that share no band key ((1 - s ** 3) ** 20: 0.07 at s = 0.5, 0.008 at 0.6), and pairs whose estimate lies more than three standard
errors below the threshold (at most 0.0014, as the estimate of a pair at the threshold is binomial).

Cases: documents without a word (null, empty or blank) and those with a null doc_id belong to no group. Rows with the same doc_id
are one document, with all their texts, and stay or go together. Of a group the smallest doc_id stays. An empty table gives an empty result. Only doc_id
and text are read, and other columns are passed on, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .components import components
from .text import BROADCAST_BYTES, Hasher, free_names, mix, pieces, runs, small, words

DF_BITS = 20
K, THRESHOLD, BANDS, ROWS = 2, 0.5, 20, 3
DOC_LIMIT = 4096
HOT, SPLITS = 20_000, 16
PAIRS = 1 << 18
IDF_STEP = 128.0
STEP = np.uint64(0xD6E8FEB86659FD93)
ELEMENT = np.uint64((1 << 52) - 1)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents per word bucket, documents with a word)."""
    size, piece = 1 << DF_BITS, 1 << 14

    def count(batches):
        hasher, total, n = Hasher(), np.zeros(size, np.int64), 0
        for batch in pieces(batches, 0):
            hashes, at = words(batch.column(0), hasher)
            n += int((np.diff(at) > 0).sum())
            for i in range(0, len(at) - 1, DOC_LIMIT):
                j = min(i + DOC_LIMIT, len(at) - 1)
                own = hashes[at[i] : at[j]] >> np.uint64(64 - DF_BITS)
                own |= np.repeat(np.arange(j - i, dtype=np.uint64), np.diff(at[i : j + 1])) << np.uint64(DF_BITS)
                own.sort()
                own = own[runs(own)[:-1]] if len(own) else own
                total += np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size)
        yield pa.record_batch([pa.array(range(-1, size // piece), pa.int32()), pa.array([np.int64(n).tobytes(), *(total[i : i + piece].tobytes() for i in range(0, size, piece))], pa.binary())], ["piece", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
        return pa.table([table.column("piece").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["piece", "counts"])

    rows = {r.piece: np.frombuffer(r.counts, np.int64) for r in docs.select("text").mapInArrow(count, "piece int, counts binary").groupBy("piece").applyInArrow(add, "piece int, counts binary").collect()}
    if not rows:
        return np.zeros(size, np.int64), 0
    return np.concatenate([rows[i] for i in range(size // piece)]), int(rows[-1][0])


def idf_codes(df: np.ndarray, n: int) -> np.ndarray:
    """IDF of each bucket in steps of 1/IDF_STEP."""
    return np.rint((np.log((1.0 + n) / (1.0 + df)) + 1.0) * IDF_STEP).astype(np.uint16)


def shingles(hashes: np.ndarray, at: np.ndarray, codes: np.ndarray, k: int):
    """(keys, counts, edges of the documents): keys hold document (12 bits), shingle hash (40) and IDF code (12), sorted; at most DOC_LIMIT documents."""
    size = np.diff(at)
    doc = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(doc)) - (at[:-1] - at[0])[doc]
    left = size[doc] - place
    start = np.flatnonzero((left >= k) | (place == 0))
    own = hashes[at[0] : at[-1]]
    code = codes[own >> np.uint64(64 - DF_BITS)].astype(np.uint32)
    key, weight, n = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint32), np.minimum(left[start], k).astype(np.uint32)
    for j in range(k):
        if j:
            inside = left[start] > j
            where = np.where(inside, start + j, 0)
            key = key * STEP + np.where(inside, own[where], np.uint64(0))
            weight += np.where(inside, code[where], np.uint32(0))
        else:
            key, weight = own[start].copy(), code[start].copy()
    key = (mix(key) >> np.uint64(24)) << np.uint64(12) | np.minimum((weight + n // 2) // n, 4095).astype(np.uint64)
    key |= doc[start].astype(np.uint64) << np.uint64(52)
    key.sort()
    edge = runs(key)
    key = key[edge[:-1]] if len(key) else key
    return key, np.diff(edge), np.searchsorted(key, np.arange(len(size) + 1, dtype=np.uint64) << np.uint64(52)) if len(size) < DOC_LIMIT else np.append(np.searchsorted(key, np.arange(len(size), dtype=np.uint64) << np.uint64(52)), len(key))


def weights(key: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (count * (key & np.uint64(4095)).astype(np.float32) / np.float32(IDF_STEP)).astype(np.float32)


class Sampler:
    """Consistent weighted samples; the random variables of an element come from tables of quantiles, indexed by its hash."""

    def __init__(self, samples: int) -> None:
        rng = np.random.default_rng(977)
        u = (np.arange(1 << 16) + 0.5) / (1 << 16)
        # quantiles of Gamma(2, 1): solve 1 - exp(-x)(1 + x) = u by bisection
        low, high = np.zeros(len(u)), np.full(len(u), 40.0)
        for _ in range(60):
            mid = (low + high) / 2
            less = 1 - np.exp(-mid) * (1 + mid) < u
            low, high = np.where(less, mid, low), np.where(less, high, mid)
        self.r = low.astype(np.float32)
        self.inverse = (1 / low).astype(np.float32)
        self.log_c = np.log(low).astype(np.float32)
        self.seeds = rng.integers(1, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signatures(self, key: np.ndarray, count: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """uint32 samples, a row for each document with at least one shingle."""
        full = np.flatnonzero(np.diff(edge))
        out = np.zeros((len(full), len(self.seeds)), np.uint32)
        # pieces of about 16k shingles stay in the cache
        i = 0
        while i < len(full):
            j = max(i + 1, int(np.searchsorted(edge[full], edge[full[i]] + 16384)))
            a, b = edge[full[i]], edge[full[min(j, len(full)) - 1] + 1]
            own = key[a:b]
            element = mix(own & ELEMENT)
            log_w = np.log(weights(own, count[a:b]))
            first = edge[full[i : min(j, len(full))]] - a
            for s, seed in enumerate(self.seeds):
                x = element * seed
                x ^= x >> np.uint64(29)
                x *= np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(32)
                half = x.view(np.uint16).reshape(-1, 4)
                beta = x.view(np.uint32)[1::2].astype(np.float32) * np.float32(2.0**-32)
                at = half[:, 0]
                t = np.floor(log_w * self.inverse[at] + beta)
                value = self.log_c[half[:, 1]] - self.r[at] * (t - beta + np.float32(1))
                bits = value.view(np.int32)
                bits ^= (bits >> 31) & np.int32(0x7FFFFFFF)
                name = (x.view(np.uint32)[1::2] * np.uint32(0x9E3779B1)) ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x85EBCA6B))
                packed = (bits.astype(np.int64) << 32) | name.astype(np.int64)
                out[i:j, s] = np.minimum.reduceat(packed, first) & 0xFFFFFFFF
            i = j
        return out


def node_of(text) -> F.Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("node")


def signature_rows(docs: DataFrame, codes, k: int, samples: int) -> DataFrame:
    """(doc_id, node, signature) of the documents with a word; node is half the digest of the text."""

    def sign(batches):
        hasher, sampler, table = Hasher(), Sampler(samples), codes.value
        for batch in pieces(batches, 2):
            hashes, at = words(batch.column(2), hasher)
            ids, sigs = [], []
            for i in range(0, len(at) - 1, DOC_LIMIT):
                j = min(i + DOC_LIMIT, len(at) - 1)
                key, count, edge = shingles(hashes, at[i : j + 1], table, k)
                ids.append(np.flatnonzero(np.diff(edge)) + i)
                sigs.append(sampler.signatures(key, count, edge))
            if ids:
                rows = pa.array(np.concatenate(ids))
                raw = pa.py_buffer(np.ascontiguousarray(np.concatenate(sigs)))
                yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * samples), len(rows), [None, raw]).cast(pa.binary())], ["doc_id", "node", "sig"])

    source = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), node_of("text"), "text")
    return source.mapInArrow(sign, "doc_id long, node long, sig binary")


def band_rows(batches, bands: int, rows: int):
    for batch in batches:
        n = batch.num_rows
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, bands * rows)
        low = np.ascontiguousarray(sig.astype(np.uint8))
        small = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bands * rows), n, [None, pa.py_buffer(low)]).cast(pa.binary())
        for b in range(bands):
            key = np.full(n, b + 1, np.uint64)
            for c in range(b * rows, b * rows + rows):
                key = mix(key * STEP + sig[:, c].astype(np.uint64))
            yield pa.record_batch([pa.array(key.view(np.int64)), batch.column(0), small], ["band", "node", "low"])


def split_rows(batches, splits: int, clear: float):
    """(band, node, low, first, first's low) to longer keys by other samples; calm members are those that link to the first one."""
    for batch in batches:
        n = batch.num_rows
        low, first = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, -1) for c in (2, 4))
        calm = pa.array((low == first).mean(1) >= clear) if n else pa.array([], pa.bool_())
        band = np.asarray(batch.column(0)).view(np.uint64)
        samples = low.shape[1] if n else 1
        for i in range(splits):
            key = mix(mix(band * STEP + np.uint64(i + 1)) + (low[:, (i * samples // splits + 1) % samples].astype(np.uint64) if n else np.zeros(0, np.uint64)))
            yield pa.record_batch([pa.array(key.view(np.int64)), calm, batch.column(1), batch.column(2)], ["band", "calm", "node", "low"])


def first_pairs(batches, clear: float):
    """Links of the calm members of hot band keys to the first one."""
    for batch in batches:
        n = batch.num_rows
        low, first = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, -1) for c in (2, 4))
        a, b = np.asarray(batch.column(3)), np.asarray(batch.column(1))
        own = ((low == first).mean(1) >= clear) & (a != b) if n else np.zeros(0, bool)
        yield pa.record_batch([pa.array(a[own]), pa.array(b[own]), pa.array(np.ones(own.sum(), bool))], ["a", "b", "star"])


class PairWriter:
    """Pairs in batches of bounded size."""

    def __init__(self) -> None:
        self.parts, self.size = [], 0

    def add(self, a: np.ndarray, b: np.ndarray, star: bool) -> None:
        if len(a):
            self.parts.append((a, b, np.full(len(a), star)))
            self.size += len(a)

    def take(self, least: int = 1):
        if self.size >= least:
            a, b, star = (np.concatenate(x) for x in zip(*self.parts))
            self.parts, self.size = [], 0
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(star)], ["a", "b", "star"])


def bucket_pairs(ids: np.ndarray, low: np.ndarray, least: float, clear: float, out: PairWriter):
    """Pairs of one band key whose estimate is at least `least`; members with a `clear` estimate to the first one link to it alone."""
    alike = (low == low[0]).mean(1)
    star = np.flatnonzero(alike[1:] >= clear) + 1
    out.add(np.full(len(star), ids[0]), ids[star], True)
    for i in np.flatnonzero(alike < clear):
        other = np.flatnonzero((low == low[i]).mean(1) >= least)
        other = other[other != i]
        out.add(np.full(len(other), ids[i]), ids[other], False)
        yield from out.take(PAIRS)


def seeking_pairs(batches, least: float):
    """Batches sorted by (band, calm) to pairs of members that aren't calm with all members; only the former are held."""
    out, now, held = PairWriter(), None, None
    for batch in batches:
        band, calm, ids = (np.asarray(batch.column(c)) for c in range(3))
        low = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(ids), -1)
        edge = np.concatenate([[0], np.flatnonzero((band[1:] != band[:-1]) | (calm[1:] != calm[:-1])) + 1, [len(band)]]) if len(band) else [0]
        for a, b in zip(edge[:-1], edge[1:]):
            if band[a] != now:
                now, held = band[a], (ids[:0], low[:0])
            if not calm[a]:
                held = np.concatenate([held[0], ids[a:b]]), np.concatenate([held[1], low[a:b]])
            for x, own in zip(*held):
                other = np.flatnonzero((low[a:b] == own).mean(1) >= least) + a
                other = other[ids[other] != x]
                out.add(np.full(len(other), x), ids[other], False)
                yield from out.take(PAIRS)
    yield from out.take()


def whole_bands(batches):
    """Tables of whole band keys, from batches sorted by band; each batch is held once."""
    held = []
    for batch in batches:
        band = np.asarray(batch.column(0))
        if not len(band):
            continue
        cut = int(np.searchsorted(band, band[-1]))
        if cut or (held and held[-1].column(0)[0].as_py() != band[0]):
            if cut:
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def candidate_pairs(batches, least: float, clear: float):
    """Batches sorted by (band, node) to pairs."""
    out = PairWriter()
    for table in whole_bands(batches):
        band, ids = np.asarray(table.column(0)), np.asarray(table.column(1))
        low = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
        edge = runs(band)
        for g in np.flatnonzero(np.diff(edge) > 1):
            a, b = edge[g], edge[g + 1]
            yield from bucket_pairs(ids[a:b], low[a:b], least, clear, out)
        yield from out.take(PAIRS)
    yield from out.take()


def similarities(left, right, codes: np.ndarray, k: int, hasher: Hasher) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of each pair."""
    (ha, pa_), (hb, pb) = words(left, hasher), words(right, hasher)
    out = np.zeros(len(left))
    for i in range(0, len(left), DOC_LIMIT):
        j = min(i + DOC_LIMIT, len(left))
        ka, ca, _ = shingles(ha, pa_[i : j + 1], codes, k)
        kb, cb, _ = shingles(hb, pb[i : j + 1], codes, k)
        wa, wb = weights(ka, ca).astype(np.float64), weights(kb, cb).astype(np.float64)
        at = np.minimum(np.searchsorted(kb, ka), max(len(kb) - 1, 0))
        both = kb[at] == ka if len(kb) else np.zeros(len(ka), bool)
        pair = (ka >> np.uint64(52)).astype(np.int64)
        common = np.bincount(pair[both], np.minimum(wa[both], wb[at[both]]), minlength=j - i)
        total = np.bincount(pair, wa, minlength=j - i) + np.bincount((kb >> np.uint64(52)).astype(np.int64), wb, minlength=j - i)
        out[i:j] = common / np.maximum(total - common, 1e-30)
    return out


def verified_pairs(docs: DataFrame, pairs: DataFrame, codes, k: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs of nodes that reach the threshold."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-ids")
    known = docs.where("doc_id is not null and text is not null").select(node_of("text"), "text")
    texts = known.join(small(ids)[0], "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    left, right = (texts.withColumnsRenamed({"node": x, "text": f"t{x}"}).hint("merge") for x in "ab")
    both = pairs.join(left, "a").join(right, "b")

    def verify(batches):
        hasher, table = Hasher(), codes.value
        for batch in pieces(batches, 2, 2 << 20):
            s = similarities(batch.column(2), batch.column(3), table, k, hasher)
            good = np.flatnonzero(s >= threshold)
            yield pa.record_batch([batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), pa.array(s[good])], ["a", "b", "similarity"])

    return both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long, similarity double")


def similar_pairs(docs: DataFrame, texts: DataFrame, codes, k: int, threshold: float, bands: int, rows: int, hot: int = HOT) -> DataFrame:
    """(a, b): similar pairs of texts (node, sig), enough of them to connect each group."""
    samples = bands * rows
    error = (threshold * (1 - threshold) / samples) ** 0.5
    least, clear = threshold - 3 * error, threshold + 2 * error
    links, member = "a long, b long, star boolean", "band long, calm boolean, node long, low binary"
    banded = texts.select("node", "sig").mapInArrow(lambda x: band_rows(x, bands, rows), "band long, node long, low binary")
    seek = lambda df: df.repartition("band").sortWithinPartitions("band", "calm").mapInArrow(lambda x: seeking_pairs(x, least), links)
    often = materialize(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("band"), "near-hot")
    calm, pairs = banded, None
    if not often.isEmpty():
        keys = small(often)[0]
        own = banded.join(keys, "band", "left_semi")
        first = materialize(own.groupBy("band").agg(F.min(F.struct("node", "low")).alias("f")).select("band", F.col("f.node").alias("first"), F.col("f.low").alias("first_low")), "near-first")
        own = own.join(F.broadcast(first) if first.count() * 200 <= BROADCAST_BYTES else first, "band").select("band", "node", "low", "first", "first_low")
        spread = own.mapInArrow(lambda x: split_rows(x, SPLITS, clear), member)
        calm = banded.join(keys, "band", "left_anti")
        pairs = seek(spread).unionByName(own.mapInArrow(lambda x: first_pairs(x, clear), links))
    found = calm.repartition("band").sortWithinPartitions("band", "node").mapInArrow(lambda x: candidate_pairs(x, least, clear), links)
    found = (found if pairs is None else found.unionByName(pairs)).groupBy("a", "b").agg(F.max("star").alias("star"))
    pairs = materialize(found, "near-pairs")
    edges = materialize(verified_pairs(docs, pairs, codes, k, threshold).select("a", "b"), "near-edges")
    # members that failed against the first one of a band key were compared with no other there: now they are
    lost = pairs.where("star").join(edges, ["a", "b"], "left_anti")
    lost = materialize(lost.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-lost")
    if lost.isEmpty():
        return edges
    own = small(lost)[0]
    where = banded.join(own, "node", "left_semi").select("band").distinct()
    rest = banded.join(small(materialize(where, "near-lost-bands"))[0], "band", "left_semi")
    again = seek(rest.join(own.withColumn("calm", F.lit(False)), "node", "left").select("band", F.coalesce("calm", F.lit(True)).alias("calm"), "node", "low"))
    more = materialize(again.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "near-more")
    return edges.unionByName(materialize(verified_pairs(docs, more, codes, k, threshold).select("a", "b"), "near-more-edges"))


def near_duplicates(docs: DataFrame, k: int = K, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, hot: int = HOT) -> DataFrame:
    """(doc_id, group_id, copy_of, kept) of the documents that have an exact or near copy.

    group_id is the smallest doc_id of the group, the one that is kept; copy_of is the smallest doc_id with the same text.
    """
    spark = docs.sparkSession
    df, n = document_frequencies(docs)
    codes = spark.sparkContext.broadcast(idf_codes(df, n))
    signed = materialize(signature_rows(docs, codes, k, bands * rows), "near-signatures")
    texts = materialize(signed.groupBy("node").agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("n")), "near-texts")
    edges = similar_pairs(docs, texts, codes, k, threshold, bands, rows, hot)
    # the texts of a repeated doc_id belong together
    several = materialize(signed.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a"), "near-several")
    if not several.isEmpty():
        edges = edges.unionByName(signed.join(small(several)[0], "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct())
    roots = components(edges)
    repeated = texts.where("n > 1").select("node")
    known = materialize(repeated.join(roots, "node", "full_outer").select("node", F.coalesce("root", "node").alias("root")), "near-known")
    listed = materialize(signed.select("doc_id", "node").join(small(known)[0], "node"), "near-listed")
    copies = listed.groupBy("node").agg(F.min("doc_id").alias("copy_of"))
    # a repeated row alone makes no group
    groups = listed.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.max("doc_id").alias("z")).where("group_id <> z").drop("z")
    out = listed.join(copies, "node").join(groups, "root").groupBy("doc_id").agg(F.min("group_id").alias("group_id"), F.min("copy_of").alias("copy_of"))
    return out.withColumn("kept", F.col("doc_id") == F.col("group_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group."""
    (name,) = free_names(docs.columns, "gone")
    gone = materialize(near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias(name)), "near-gone")
    return docs.join(small(gone)[0], F.col("doc_id").cast("long") == F.col(name), "left_anti")

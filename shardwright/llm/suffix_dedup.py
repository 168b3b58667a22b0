"""Passages of min_words words or more that stand in several documents, by suffix arrays.

A suffix array of a whole corpus fits no machine, so the places that can matter are found first. Each document is winnowed: of
every min_words - k + 1 neighbouring runs of k words the one of least hash is an anchor, so equal passages of min_words words have an
anchor of equal hash in both documents. Anchors whose hash stands in one document only are dropped: smallest and largest doc_id of each
hash are aggregated before any row moves. Around each of the others the words that a passage with this anchor can cover go to the owner
of the hash, which builds the suffix array of its windows by two-stage sorting: suffixes smaller than their successors are sorted directly, the
rest are induced by scanning the buckets in symbol order, and neighbours with a common prefix of min_words words give the passages.

An anchor of more than HOT places (text that is everywhere) would fill its owner. Its windows are cut into their suffixes instead, each by its first
min_words words, which is all that the order of suffixes is asked for; equal ones become one (64-bit name, smallest and largest doc_id)
before they move, so no owner holds more than distinct passages, and the answer joins back. Nothing is capped or cut.

Cases: words are runs without ASCII white space, compared as they are (as 32-bit codes in windows of min_words of them). Null,
empty and shorter texts give no rows, nor do rows with a null doc_id. Rows with the same doc_id are one document: passages repeated only within one
doc_id are not reported. Empty tables give empty results. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .text import Hasher, mix, pieces, runs, small, words

MIN_WORDS, K = 50, 25
BATCH_WORDS = 300_000
HOT = 20_000
_Q = 0xD1342543DE82EF95


def sliding(values: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of values[i : i + size] for each i; shorter at the end."""
    op = np.minimum if least else np.maximum
    out, have = values.copy(), 1
    while have < size:
        step = min(have, size - have)
        out[:-step or None] = op(out[:-step], out[step:]) if step < len(out) else out[:0]
        have += step
    return out


def anchors(hashes: np.ndarray, at: np.ndarray, min_words: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions among all words, hashes of k words) of the anchors."""
    n, window = len(hashes), min_words - k + 1
    if n < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power = np.cumprod(np.full(n, _Q, np.uint64))
    inverse = np.cumprod(np.full(n, pow(_Q, -1, 2**64), np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power)])
    gram = mix((total[k:] - total[:-k]) * inverse[: n - k + 1]) | np.uint64(1)
    size = np.diff(at)
    left = np.repeat(at[1:], size) - np.arange(n)
    starts = left >= min_words
    gram = np.concatenate([gram, np.full(k - 1, 2**64 - 1, np.uint64)])
    least = sliding(gram, window, True)
    least[~starts] = 0
    # a run is an anchor if it is the least of some window that holds it
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least])
    chosen = np.flatnonzero(sliding(padded, window, False)[:n] == gram)
    value = gram[chosen]
    if not len(chosen):
        return chosen, value
    # in chains of equal anchors the first and last of each half window do: every window that held one still does
    doc = np.searchsorted(at, chosen, "right")
    link = np.zeros(len(chosen), bool)
    link[1:] = (value[1:] == value[:-1]) & (np.diff(chosen) < window) & (doc[1:] == doc[:-1])
    head = chosen[np.maximum.accumulate(np.where(~link, np.arange(len(chosen)), 0))]
    block = (chosen - head) // max(1, window // 2)
    inner = np.zeros(len(chosen) + 1, bool)
    inner[1:-1] = link[1:] & (block[1:] == block[:-1])
    keep = ~(inner[:-1] & inner[1:])
    return chosen[keep], value[keep]


def sort_directly(x: np.ndarray, at: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """The suffixes at `at` in order of their first `depth` symbols; x is padded."""
    b = np.uint64(bits)
    order = np.argsort((x[at] << b) | x[at + 1])
    at = at[order]
    key = (x[at] << b) | x[at + 1]
    t = 2
    group = np.zeros(len(at), np.uint64)
    edge = runs(key)
    live = np.arange(len(at))
    # group and two symbols may not fit in 64 bits together
    wide = len(at).bit_length() + 2 * bits > 64
    while True:
        size = np.diff(edge)
        tied = np.repeat(size > 1, size)
        group = np.repeat(live[edge[:-1]], size)[tied].astype(np.uint64)
        live = live[tied]
        if t >= depth or not len(live):
            return at
        own = at[live]
        pair = (x[own + t] << b) | x[own + t + 1]
        if wide:
            order = np.lexsort((pair, group))
            pair, group = pair[order], group[order]
            edge = np.concatenate([[0], np.flatnonzero((pair[1:] != pair[:-1]) | (group[1:] != group[:-1])) + 1, [len(pair)]])
        else:
            key = (group << (b + b)) | pair
            order = np.argsort(key)
            edge = runs(key[order])
        at[live] = own[order]
        t += 2


def suffix_array(symbols: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Two-stage suffix sorting of strings that end before `ends`, each closed by a symbol of its own; order is by at least `depth` symbols.

    symbols: any integers. Returns positions in the closed text (see close())."""
    x, bits, n_ends = close(symbols, ends)
    return _two_stage(x, bits, n_ends, depth)


def close(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(text with a least, own symbol behind each string, padded; bits of a symbol; number of strings)."""
    values = np.sort(symbols)
    values = values[runs(values)[:-1]] if len(values) else values
    code = np.searchsorted(values, symbols).astype(np.uint64) + np.uint64(len(ends))
    x = np.insert(code, ends, np.arange(len(ends), dtype=np.uint64))
    return np.concatenate([x, np.zeros(64, np.uint64)]), max(1, int(len(values) + len(ends)).bit_length()), len(ends)


def _two_stage(x: np.ndarray, bits: int, strings: int, depth: int) -> np.ndarray:
    n = len(x) - 64
    text = x[:n]
    # first place behind the run of equal symbols at each place
    change = np.flatnonzero(text[1:] != text[:-1]) + 1
    bound = np.append(change, n)
    behind = bound[np.searchsorted(bound, np.arange(n), "right")]
    small = np.zeros(n, bool)
    inside = behind < n
    small[inside] = text[behind[inside]] > text[inside]
    small[text < strings] = True
    rank = np.full(n, -1, np.int64)
    count = np.bincount(text.astype(np.int64), minlength=int(text.max()) + 1)
    bucket_end = np.cumsum(count)
    closing = text < strings
    rank[closing] = text[closing].astype(np.int64)
    # stage one: suffixes smaller than their successors fill the ends of their buckets
    direct = sort_directly(x, np.flatnonzero(small & ~closing), bits, depth)
    symbol = text[direct].astype(np.int64)
    edge = runs(symbol)
    behind_it = np.repeat(edge[1:], np.diff(edge)) - np.arange(len(direct))
    rank[direct] = bucket_end[symbol] - behind_it
    # stage two: buckets in symbol order; a bucket needs only lower ones, as places in a run go by its length
    rest = np.flatnonzero(~small)
    if len(rest):
        symbol = text[rest].astype(np.int64)
        order = np.argsort(symbol, kind="stable")
        rest, symbol = rest[order], symbol[order]
        length = behind[rest] - rest
        follower = np.where(behind[rest] < n, text[np.minimum(behind[rest], n - 1)].astype(np.int64), -1)
        edge = runs(symbol)
        highest = np.maximum.reduceat(follower, edge[:-1])
        own = symbol[edge[:-1]]
        start = bucket_end - count
        i, total = 0, len(own)
        highest_list, own_list = highest.tolist(), own.tolist()
        while i < total:
            # as many buckets as don't need one another
            j, first = i + 1, own_list[i]
            while j < total and highest_list[j] < first:
                j += 1
            a, b = edge[i], edge[j]
            at, sym = rest[a:b], symbol[a:b]
            after = np.where(behind[at] < n, rank[np.minimum(behind[at], n - 1)], -1)
            at = at[np.lexsort((after, length[a:b], sym))]
            e = edge[i : j + 1] - a
            rank[at] = np.arange(b - a) - np.repeat(e[:-1], np.diff(e)) + np.repeat(start[own[i:j]], np.diff(e))
            i = j
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def common_prefix(x: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, up to depth."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    left, right = order[:-1], order[1:]
    for _ in range(depth):
        same = x[left + out[live]] == x[right + out[live]]
        live, left, right = live[same], left[same], right[same]
        if not len(live):
            break
        out[live] += 1
    return out


def passages(content: np.ndarray, size: np.ndarray, least: np.ndarray, most: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of windows where a passage shared by two documents starts: (window, offset, smallest doc_id of the passage).

    content: word codes of all windows; least, most: smallest and largest doc_id of each."""
    ends = np.cumsum(size)
    x, bits, strings = close(content, ends)
    order = _two_stage(x, bits, strings, min_words)
    begin = ends - size + np.arange(len(size))
    window = np.repeat(np.arange(len(size)), size + 1)[order]
    offset = order - begin[window]
    long = offset + min_words <= size[window]
    order, window, offset = order[long], window[long], offset[long]
    if not len(order):
        return window, offset, np.zeros(0, np.int64)
    head = common_prefix(x, order, min_words) < min_words
    head[0] = True
    edge = np.append(np.flatnonzero(head), len(order))
    low, high = np.minimum.reduceat(least[window], edge[:-1]), np.maximum.reduceat(most[window], edge[:-1])
    shared = np.repeat(low != high, np.diff(edge))
    return window[shared], offset[shared], np.repeat(low, np.diff(edge))[shared]


def spans_of_windows(doc: np.ndarray, start: np.ndarray, content: np.ndarray, size: np.ndarray, min_words: int) -> pa.RecordBatch:
    """(doc_id, later, s, e) in words, from windows of whole anchor groups."""
    # equal windows are sorted once
    edge = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(len(content)) - np.repeat(edge[:-1], size)
    power = np.cumprod(np.full(int(size.max()), _Q, np.uint64))
    name = mix(np.add.reduceat(mix(content.astype(np.uint64) + np.uint64(1)) * power[place], edge[:-1]) + size.astype(np.uint64))
    by = np.argsort(name, kind="stable")
    run = runs(name[by])
    twin = np.empty(len(name), np.int64)
    twin[by] = np.repeat(np.arange(len(run) - 1), np.diff(run))
    one = by[run[:-1]]
    low, high = np.minimum.reduceat(doc[by], run[:-1]), np.maximum.reduceat(doc[by], run[:-1])
    picked = np.repeat(edge[one], size[one]) + np.arange(size[one].sum()) - np.repeat(np.cumsum(size[one]) - size[one], size[one])
    window, offset, first = passages(content[picked], size[one], low, high, min_words)
    o = np.lexsort((offset, window))
    window, offset, first = window[o], offset[o], first[o]
    at = np.searchsorted(window, np.arange(len(one) + 1))
    n = np.diff(at)[twin]
    member = np.repeat(np.arange(len(doc)), n)
    index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[:-1][twin], n)
    d, s, later = doc[member], start[member] + offset[index], first[index] != doc[member]
    o = np.lexsort((s, later, d))
    d, s, later = d[o], s[o], later[o]
    if not len(d):
        return pa.record_batch([pa.array(d), pa.array(later), pa.array(s), pa.array(s)], ["doc_id", "later", "s", "e"])
    fresh = np.ones(len(d), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (later[1:] != later[:-1]) | (s[1:] > s[:-1] + min_words)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(d)) - 1
    return pa.record_batch([pa.array(d[head]), pa.array(later[head]), pa.array(s[head]), pa.array(s[tail] + min_words)], ["doc_id", "later", "s", "e"])


def _whole_groups(batches, least_rows: int):
    """Tables that end with a group of the first column, of at least least_rows rows but at the end."""
    kept, rows = [], 0
    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows >= least_rows:
            table = pa.Table.from_batches(kept)
            key = np.asarray(table.column(0))
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if cut:
                yield table.slice(0, cut)
            kept = table.slice(cut).to_batches()
            rows = table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(kept)


def anchor_rows(docs: DataFrame, min_words: int, k: int) -> DataFrame:
    def find(batches):
        hasher = Hasher()
        for batch in pieces(batches, 1):
            hashes, at = words(batch.column(1), hasher)
            place, value = anchors(hashes, at, min_words, k)
            doc = np.searchsorted(at, place, "right") - 1
            yield pa.record_batch([pa.array(value.view(np.int64)), batch.column(0).take(pa.array(doc)), pa.array((place - at[doc]).astype(np.int32))], ["anchor", "doc_id", "pos"])

    return docs.mapInArrow(find, "anchor long, doc_id long, pos int")


def prefix_names(content: np.ndarray, size: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, offset, 64-bit name of the min_words words from there) of all suffixes of windows that are long enough."""
    n = len(content)
    power = np.cumprod(np.full(n, _Q, np.uint64))
    inverse = np.cumprod(np.full(n, pow(_Q, -1, 2**64), np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(content.astype(np.uint64) + np.uint64(1)) * power)])
    count = np.maximum(size - min_words + 1, 0)
    window = np.repeat(np.arange(len(size)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(size) - size)[window] + offset
    return window, offset, mix((total[at + min_words] - total[at]) * inverse[at])


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, k: int = K, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, n_words, later): maximal runs of words covered by passages that another document has too.

    later: an earlier doc_id has these passages, so a deduplication may cut them; others are first occurrences."""
    source = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = materialize(anchor_rows(source, min_words, k), "suffix-anchors")
    shared = placed.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count(F.lit(1)).alias("n")).where("a <> z")
    shared = materialize(shared.select("anchor", (F.col("n") > hot).alias("hot")), "suffix-shared")
    found = placed.join(small(shared)[0], "anchor")
    places = found.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "anchor", "hot")).alias("at"))
    reach = min_words - k

    def windows(batches):
        hasher = Hasher()
        for batch in pieces(batches, 1):
            hashes, at = words(batch.column(1), hasher)
            code = (hashes >> np.uint64(32)).astype(np.uint32)
            part = batch.column(2)
            number = np.asarray(part.value_lengths()).astype(np.int64)
            doc = np.repeat(np.arange(len(number)), number)
            flat = part.flatten()
            # whatever the length of a text, a batch has so many windows at most
            for lo in range(0, len(doc), 8192):
                own, own_doc = flat.slice(lo, 8192), doc[lo : lo + 8192]
                pos = np.asarray(own.field(0)).astype(np.int64)
                # a repeated doc_id with other texts may be shorter here
                ok = pos + k <= np.diff(at)[own_doc]
                own_doc, pos, anchor, often = own_doc[ok], pos[ok], np.asarray(own.field(1))[ok], np.asarray(own.field(2))[ok]
                a = at[own_doc] + np.maximum(pos - reach, 0)
                b = np.minimum(at[own_doc] + pos + min_words, at[own_doc + 1])
                size = b - a
                index = np.repeat(a, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                offsets = np.zeros(len(size) + 1, np.int32)
                np.cumsum(size * 4, out=offsets[1:])
                content = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(code[index]))])
                yield pa.record_batch(
                    [pa.array(anchor), batch.column(0).take(pa.array(own_doc)), pa.array((a - at[own_doc]).astype(np.int32)), content, pa.array(often)], ["anchor", "doc_id", "start", "content", "hot"]
                )

    def contents(table):
        raw = table.column(3)
        raw = raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw
        raw = pa.concat_arrays(raw.chunks) if isinstance(raw, pa.ChunkedArray) else raw
        offsets = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4).astype(np.int64)
        return np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint32), np.diff(offsets) // 4

    def sort(batches):
        for table in _whole_groups(batches, BATCH_WORDS // (2 * min_words)):
            content, size = contents(table)
            yield spans_of_windows(np.asarray(table.column(1)), np.asarray(table.column(2)).astype(np.int64), content, size, min_words)

    def names(batches):
        for batch in batches:
            if batch.num_rows:
                window, offset, name = prefix_names(*contents(batch), min_words)
                yield pa.record_batch([batch.column(1).take(pa.array(window)), pa.array(np.asarray(batch.column(2)).astype(np.int64)[window] + offset), pa.array(name.view(np.int64))], ["doc_id", "s", "name"])

    cut = source.join(places, "doc_id").select("doc_id", "text", "at").mapInArrow(windows, "anchor long, doc_id long, start int, content binary, hot boolean")
    columns = "anchor", "doc_id", "start", "content"
    if shared.where("hot").isEmpty():
        spans = cut.select(*columns).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sort, "doc_id long, later boolean, s long, e long")
    else:
        cut = materialize(cut, "suffix-windows")
        spans = cut.where("not hot").select(*columns).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sort, "doc_id long, later boolean, s long, e long")
        each = materialize(cut.where("hot").select(*columns).mapInArrow(names, "doc_id long, s long, name long").distinct(), "suffix-names")
        twice = materialize(each.groupBy("name").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("z")).where("first <> z").select("name", "first"), "suffix-twice")
        often = each.join(small(twice)[0], "name").select("doc_id", (F.col("doc_id") != F.col("first")).alias("later"), "s", (F.col("s") + min_words).alias("e"))
        spans = spans.unionByName(often)
    order = Window.partitionBy("doc_id", "later").orderBy("s")
    reached = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reached >= F.col("s"), 0).otherwise(1)).over(order)
    merged = spans.distinct().withColumn("__i", island).groupBy("doc_id", "later", "__i").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return merged.select("doc_id", F.col("s").alias("start_word"), (F.col("e") - F.col("s")).alias("n_words"), "later")

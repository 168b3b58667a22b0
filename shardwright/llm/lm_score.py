"""Language-model scores of all documents by a weighted backoff automaton of the n-grams of all documents.

Model: counts of all n-grams up to `order` of the whole corpus, each document read as <s> words </s>, with Dirichlet smoothing:
P(w | h) = (c(hw) + BETA P(w | h')) / (c(h) + BETA), h' being h without its first word, and P(w) = c(w) / (N + 1), where a word never
seen has c = 1. A document is scored by the counts of all other documents: its own are subtracted, so its text doesn't vouch for itself.

Automaton: each context seen elsewhere is a state, each n-gram seen elsewhere an arc to the state of its longest known suffix, with the
smoothed log probability; the failure arc of h leads to h' with weight log(BETA / (c(h) + BETA)). One pass from left to right
carries the state and adds up the weights. Long documents are cut into lanes that advance together; a lane starts order - 1 words early, as the state depends
on no more than these.

Distribution: documents are hashed to blocks (equal rows of different partitions apart). A block sends its distinct n-grams with counts to the
owners of their hashes and gets back, in the same order, how often they stand in other blocks, so the part of the model that a block needs
comes to it, whatever the corpus. A block is cut into at most FAN pieces; with more blocks than that, pieces of FAN blocks are merged first and
cut again, and the answer takes the same way back, so the rows exchanged are in proportion to the blocks. No model is broadcast or collected;
only the number of words and bytes reaches the driver.

An n-gram's name has SPARE bits more than the number of n-grams of the corpus takes (64 at most), so whatever the size
of the corpus one n-gram in 2 ** SPARE shares its name, and with it its count.

Cases: documents without a word (null, empty, blank) have null scores and don't count. Each row is a document, also with a null or repeated doc_id. Empty
tables give empty results. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Hasher, flat, groups, mix, release, runs, word_counts, words

ORDER, BETA = 3, 8.0
BLOCK_BYTES = 12 << 20
SLICE_WORDS = 200_000
LANE = 64
FAN = 4096
SPARE = 20
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
ROOT = np.uint64(0x2545F4914F6CDD1D)
STEP = np.uint64(0xD6E8FEB86659FD93)


def sequences(column, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens with <s> and </s>, pointer of each document with a word, rows of these documents)."""
    hashes, at = words(column, hasher)
    n = np.diff(at)
    rows = np.flatnonzero(n)
    n = n[rows]
    edge = np.concatenate([[0], np.cumsum(n + 2)])
    tokens = np.empty(edge[-1], np.uint64)
    tokens[edge[:-1]], tokens[edge[1:] - 1] = START, END
    tokens[np.arange(len(hashes)) + 2 * np.repeat(np.arange(len(n)), n) + 1] = hashes
    return tokens, edge, rows


def name_bits(n_words: int, order: int) -> int:
    return min(64, (n_words * order).bit_length() + SPARE)


def grams(tokens: np.ndarray, edge: np.ndarray, order: int, bits: int = 64) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each length the names of the n-grams that end at each place, and which places have one."""
    place = np.arange(len(tokens)) - np.repeat(edge[:-1], np.diff(edge))
    key, cut = mix(tokens + ROOT), np.uint64(64 - bits)
    keys, valid = [key >> cut], [np.ones(len(tokens), bool)]
    for m in range(2, order + 1):
        longer = np.zeros(len(tokens), np.uint64)
        longer[1:] = mix(key[:-1] * STEP + tokens[1:])
        key = longer
        keys.append(key >> cut)
        valid.append(place >= m - 1)
    return keys, valid


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    edge = runs(keys)
    return keys[edge[:-1]] if len(keys) else keys, np.diff(edge)


def indexed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts of the distinct keys in their order, a place of each, index of each key among them)."""
    by = np.argsort(keys)
    edge = runs(keys[by])
    index = np.empty(len(keys), np.int64)
    index[by] = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    return np.diff(edge), by[edge[:-1]] if len(keys) else by, index


def packed_keys(keys: np.ndarray, base: int) -> bytes:
    """Sorted keys as differences of as few whole bytes as all of them fit; the first byte says how many."""
    step = np.diff(keys, prepend=np.uint64(base))
    size = max(1, (int(step.max()).bit_length() + 7) // 8)
    return bytes([size]) + np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def unpacked_keys(raw: bytes, base: int) -> np.ndarray:
    step = np.zeros(((len(raw) - 1) // raw[0], 8), np.uint8)
    step[:, : raw[0]] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, raw[0])
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64) + np.uint64(base)


def packed_counts(counts: np.ndarray) -> bytes:
    """A byte each; those of 255 and more stand behind all of them."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def unpacked_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=n)
    return out


def cut_pieces(known: np.ndarray, lows: np.ndarray):
    """(piece, start, end) of the pieces that hold a key; lows: where each piece's range begins."""
    at = np.append(np.searchsorted(known, lows), len(known))
    return [(i, a, b) for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())) if b > a]


class Merged:
    """Pieces of one key range, added up."""

    def __init__(self, table: pa.Table, base: int) -> None:
        keys = [unpacked_keys(x.as_py(), base) for x in table.column("keys")]
        self.sizes = [len(k) for k in keys]
        self.own = np.concatenate([unpacked_counts(x.as_py(), n) for x, n in zip(table.column("counts"), self.sizes)])
        keys = np.concatenate(keys)
        self.by = np.argsort(keys)
        keys = keys[self.by]
        edge = runs(keys)
        self.keys, self.repeats = keys[edge[:-1]], np.diff(edge)
        self.counts = np.add.reduceat(self.own[self.by], edge[:-1])

    def others(self, total: np.ndarray) -> list[bytes]:
        """For each piece what the totals of its keys have besides the piece itself."""
        whole = np.empty(len(self.by), np.int64)
        whole[self.by] = np.repeat(total, self.repeats)
        return [packed_counts(x) for x in np.split(whole - self.own, np.cumsum(self.sizes)[:-1])]


class Automaton:
    """Backoff automaton of the documents of a block, each by the counts of the others; -1 is the root.

    reads[m, i] is the arc from a state of length m that stands before place i to the n-gram of length m + 1 that ends there."""

    def __init__(self, edge, names: list, valid, totals: np.ndarray, n_words: int, beta: float) -> None:
        order, n = len(names), int(edge[-1])
        doc = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        places = [np.flatnonzero(v) for v in valid]
        name = np.concatenate([k[p] for k, p in zip(names, places)]).astype(np.int64)
        at = np.concatenate(places)
        length = np.repeat(np.arange(1, order + 1), [len(p) for p in places])
        own, one, index = indexed(doc[at] * len(totals) + name)
        place, self.length = at[one], length[one]
        self.reads, seen = np.full((order, n), -1, np.int32), 0
        for m, p in enumerate(places):
            self.reads[m, p] = index[seen : seen + len(p)]
            seen += len(p)
        self.count = totals[name[one]] - own
        rest = n_words - (np.diff(edge) - 1)[doc[place]]
        chance = np.empty(len(own))
        first = self.length == 1
        chance[first] = np.maximum(self.count[first], 1) / (rest[first] + 1.0)
        self.fail = np.full(len(own), -1, np.int64)
        for m in range(2, order + 1):
            own_m = np.flatnonzero(self.length == m)
            self.fail[own_m] = self.reads[m - 2, place[own_m]]
            context = self.reads[m - 2, place[own_m] - 1]
            chance[own_m] = (self.count[own_m] + beta * chance[self.fail[own_m]]) / (self.count[context] + beta)
        self.weight = np.log(chance)
        self.fail_weight = np.log(beta / (np.maximum(self.count, 0) + beta))
        # an arc of full length leads to its longest suffix, any other to itself, a word of no other document to the root
        self.to = np.where(self.length == order, self.fail if order > 1 else -1, np.arange(len(own)))
        self.to[(self.count <= 0) & first] = -1
        self.first_state = self.reads[0].astype(np.int64) if order > 1 else np.full(n, -1, np.int64)

    def step(self, state: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and log probabilities; failure arcs are followed until an arc reads the token."""
        score, out, live = np.zeros(len(state)), np.full(len(state), -1, np.int64), None
        while True:
            now, here = (state, place) if live is None else (state[live], place[live])
            size = np.where(now < 0, 0, self.length[now])
            arc = self.reads[size, here]
            good = (size == 0) | ((arc >= 0) & (self.count[arc] > 0))
            hit = np.flatnonzero(good) if live is None else live[good]
            score[hit] += self.weight[arc[good]]
            out[hit] = self.to[arc[good]]
            live = np.flatnonzero(~good) if live is None else live[~good]
            if not len(live):
                return out, score
            now = now[~good]
            score[live] += self.fail_weight[now]
            state[live] = self.fail[now]


def traverse(auto: Automaton, edge: np.ndarray, order: int) -> np.ndarray:
    """Log probability of each document."""
    size = np.diff(edge) - 1
    lanes = -(-size // LANE)
    doc = np.repeat(np.arange(len(size)), lanes)
    part = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = edge[doc] + 1 + part * LANE
    end = np.minimum(begin + LANE, edge[doc + 1])
    warm = np.where(part > 0, np.minimum(order - 1, begin - edge[doc] - 1), 0)
    # the first lane starts in the state of <s>
    state = np.where(part == 0, auto.first_state[edge[doc]], -1)
    state = np.where((state >= 0) & (auto.count[state] > 0), state, -1)
    at = begin - warm
    by = np.argsort(-(end - at), kind="stable")
    doc, at, begin, state, left = doc[by], at[by], begin[by], state[by], (end - at)[by]
    total = np.zeros(len(doc))
    live = len(doc)
    for t in range(int(left[0]) if len(left) else 0):
        while live and left[live - 1] <= t:
            live -= 1
        here = at[:live] + t
        nxt, score = auto.step(state[:live].copy(), here)
        state[:live] = nxt
        total[:live] += np.where(here >= begin[:live], score, 0.0)
    return np.bincount(doc, total, minlength=len(size))


def lm_scores(docs: DataFrame, order: int = ORDER, beta: float = BETA, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity); log_prob is natural and counts </s>. fan is a power of two."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches):
        size = np.zeros(2, np.int64)
        for batch in batches:
            n = word_counts(batch.column(0))
            size += [len(flat(batch.column(0))[0]), n.sum() + (n > 0).sum()]
        yield pa.record_batch([pa.array(size[:1]), pa.array(size[1:])], ["bytes", "words"])

    total = docs.select("text").mapInArrow(measure, "bytes long, words long").agg(F.sum("bytes").alias("bytes"), F.sum("words").alias("words")).first()
    blocks = max(1, -(-(total.bytes or 0) // block_bytes))
    n_words = total.words or 0
    bits = name_bits(n_words, order)
    # owners hold even ranges of the names: the leading bits say which
    lead = min(bits, min(blocks - 1, fan - 1).bit_length())
    sub = min(bits - lead, (-(-blocks // fan) - 1).bit_length()) if blocks > fan else 0
    lows = lambda n, base=0, width=bits: np.array([base + (i << (width - n)) for i in range(1 << n)], np.uint64)
    salt = F.xxhash64("doc_id", "text", F.spark_partition_id())
    blocked = docs.select(F.pmod(salt, F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")
    pieces_of = lambda known, counts, own, names, base: {
        names: pa.array([i for i, _, _ in own], pa.int32()),
        "keys": pa.array([packed_keys(known[a:b], base(i)) for i, a, b in own], pa.binary()),
        "counts": pa.array([packed_counts(counts[a:b]) for _, a, b in own], pa.binary()),
    }
    low_of = lambda part: part << (bits - lead)

    def gather(table: pa.Table) -> pa.Table:
        tokens, edge, _ = sequences(table.column("text"), Hasher())
        keys, valid = grams(tokens, edge, order, bits)
        known, count = distinct(np.concatenate([k[v] for k, v in zip(keys, valid)]))
        del tokens, edge, keys, valid
        release()
        own = cut_pieces(known, lows(lead))
        return pa.table({"block": pa.array([table.column("block")[0].as_py()] * len(own), pa.int32()), **pieces_of(known, count, own, "part", low_of)})

    def add(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        whole = Merged(table, low_of(part))
        return pa.table({"block": table.column("block"), "part": table.column("part"), "others": pa.array(whole.others(whole.counts), pa.binary())})

    # more blocks than fan: pieces of `fan` blocks are merged and cut again

    def merge(table: pa.Table) -> pa.Table:
        part, team = table.column("part")[0].as_py(), table.column("team")[0].as_py()
        whole = Merged(table, low_of(part))
        low = lows(sub, low_of(part), bits - lead)
        own = cut_pieces(whole.keys, low)
        each = pa.array([part] * len(own), pa.int32()), pa.array([team] * len(own), pa.int32())
        return pa.table({"part": each[0], "team": each[1], **pieces_of(whole.keys, whole.counts, own, "sub", lambda i: int(low[i]))})

    def add_merged(table: pa.Table) -> pa.Table:
        part, at = table.column("part")[0].as_py(), table.column("sub")[0].as_py()
        whole = Merged(table, int(lows(sub, low_of(part), bits - lead)[at]))
        return pa.table({"part": table.column("part"), "team": table.column("team"), "sub": table.column("sub"), "others": pa.array(whole.others(whole.counts), pa.binary())})

    def share(left: pa.Table, right: pa.Table) -> pa.Table:
        part = left.column("part")[0].as_py()
        whole = Merged(left, low_of(part))
        own, answers = cut_pieces(whole.keys, lows(sub, low_of(part), bits - lead)), dict(zip(right.column("sub").to_pylist(), right.column("others")))
        total = whole.counts + np.concatenate([unpacked_counts(answers[i].as_py(), b - a) for i, a, b in own])
        return pa.table({"block": left.column("block"), "part": left.column("part"), "others": pa.array(whole.others(total), pa.binary())})

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        n = word_counts(left.column("text"))
        tokens, edge, rows = sequences(left.column("text"), Hasher())
        keys, valid = grams(tokens, edge, order, bits)
        del tokens
        count, one, index = indexed(np.concatenate([k[v] for k, v in zip(keys, valid)]))
        # keys give way to their index among the distinct ones
        names, seen = [], 0
        known = np.concatenate([k[v] for k, v in zip(keys, valid)])[one] if len(one) else np.zeros(0, np.uint64)
        for i, v in enumerate(valid):
            own = np.zeros(len(v), np.int32)
            own[v] = index[seen : (seen := seen + int(v.sum()))]
            names.append(own)
            keys[i] = None
        del index, one
        answers = dict(zip(right.column("part").to_pylist(), right.column("others")))
        total = count
        for part, a, b in cut_pieces(known, lows(lead)):
            total[a:b] += unpacked_counts(answers.pop(part).as_py(), b - a)
        if answers:
            raise RuntimeError("a block changed between its two readings")
        out = np.full(len(n), np.nan)
        # an automaton serves its own documents only, so a slice of the block at a time is enough
        for i, j in groups(edge, SLICE_WORDS):
            a, b = edge[i], edge[j]
            own_edge = edge[i : j + 1] - a
            auto = Automaton(own_edge, [x[a:b] for x in names], [v[a:b] for v in valid], total, n_words, beta)
            out[rows[i:j]] = traverse(auto, own_edge, order)
        none = np.isnan(out)
        release()
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(n), "log_prob": pa.array(out, mask=none), "perplexity": pa.array(np.exp(np.minimum(-out / (n + 1), 700.0)), mask=none)})

    sent = blocked.groupBy("block").applyInArrow(gather, "block int, part int, keys binary, counts binary")
    if sub:
        teams = sent.withColumn("team", F.floor(F.col("block") / fan).cast("int"))
        merged = teams.groupBy("part", "team").applyInArrow(merge, "part int, team int, sub int, keys binary, counts binary")
        answered = merged.groupBy("part", "sub").applyInArrow(add_merged, "part int, team int, sub int, others binary")
        back = teams.groupBy("part", "team").cogroup(answered.groupBy("part", "team")).applyInArrow(share, "block int, part int, others binary")
    else:
        back = sent.groupBy("part").applyInArrow(add, "block int, part int, others binary")
    return blocked.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, f"doc_id {kind}, n_words long, log_prob double, perplexity double")

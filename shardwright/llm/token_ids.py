"""Token ids in binary columns: ids of a public tokenizer, renumbered by corpus frequency, in byte-aligned variable-length coding.

Ids count from 0 by falling frequency over all documents (equal ones by the tokenizer's id), so frequent tokens take one byte.
Four numbers share a control byte (two bits each, low bits first: bytes of the number less one); control bytes and data bytes are
apart. Decoding is by table: each control byte names how many data bytes follow and where each byte of the four numbers lies.

Decoding to text takes the token of each rank, which `token_ranks` lists as a table of its own.

The tokenizer's files are not part of this package; their path is a parameter. Its vocabulary has a fixed size, so its counts and ranks are broadcast.

Cases: a null text gives nulls, an empty one no tokens and empty columns. Special tokens' strings in a text are ordinary text. Rows are
coded one by one, also with null or repeated doc_ids. Empty tables give empty results. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import importlib.util

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .text import pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_tokenizer(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def control_tables() -> tuple[np.ndarray, np.ndarray]:
    """(data bytes of each control byte, place of each of the 16 bytes of its four numbers, -1 where it is zero)."""
    size = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
    size += 1
    start = np.cumsum(size, 1) - size
    byte = np.arange(4)
    place = np.where(byte < size[:, :, None], start[:, :, None] + byte, -1)
    return size.sum(1), place.reshape(256, 16)


def encode(numbers: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(control bytes, their edges, data bytes, their edges) of many lists at once; edge has the ends of the lists in numbers, with a leading 0."""
    numbers = np.ascontiguousarray(numbers, "<u4")
    code = (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    size = np.diff(edge)
    control_edge = np.concatenate([[0], np.cumsum(-(-size // 4))])
    slots = np.zeros(control_edge[-1] * 4, np.uint8)
    slots[np.arange(len(numbers)) + np.repeat(control_edge[:-1] * 4 - edge[:-1], size)] = code
    slots = slots.reshape(-1, 4)
    control = slots[:, 0] | slots[:, 1] << 2 | slots[:, 2] << 4 | slots[:, 3] << 6
    data = numbers.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    total = np.concatenate([[0], np.cumsum(code.astype(np.int64) + 1)])
    return control.astype(np.uint8), control_edge, data, total[edge]


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers of one list."""
    sizes, places = control_tables()
    control = np.frombuffer(control, np.uint8)
    each = sizes[control]
    start = np.cumsum(each) - each
    raw = np.frombuffer(data, np.uint8)
    raw = np.concatenate([raw, np.zeros(17, np.uint8)])  # the last control byte may name numbers that aren't there
    place = places[control]
    out = np.where(place < 0, 0, raw[np.minimum(start[:, None] + place, len(raw) - 1)]).astype(np.uint8)
    return out.reshape(-1, 4).copy().view("<u4").ravel()[:n]


def binaries(raw: np.ndarray, edge: np.ndarray, mask: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer(edge.astype(np.int64))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edge) - 1, [pa.array(~mask).buffers()[1], offsets, pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())


def tokenized(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the tokenizer's ids as little-endian uint32, or uint16 if the vocabulary allows."""

    def split(batches):
        tokenizer = load_tokenizer(path, pattern)
        width = "<u2" if tokenizer.n_vocab <= 1 << 16 else "<u4"
        for batch in batches:
            for own in pieces([batch], 1, 1 << 20):
                ids = [None if x is None else np.array(tokenizer.encode_ordinary(x), width) for x in own.column(1).to_pylist()]
                n = pa.array([None if x is None else len(x) for x in ids], pa.int64())
                yield pa.record_batch([own.column(0), n, pa.array([None if x is None else x.tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(split, f"doc_id {kind}, n_tokens long, ids binary")


def token_counts(ids: DataFrame, width: int, size: int) -> np.ndarray:
    """Occurrences of each token in all documents."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                if x.is_valid:
                    total += np.bincount(np.frombuffer(x.as_buffer(), f"<u{width}"), minlength=size)
        own = np.flatnonzero(total)
        yield pa.record_batch([pa.array(own), pa.array(total[own])], ["token", "n"])

    out = np.zeros(size, np.int64)
    for r in ids.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.token] = r.n
    return out


def ranked(counts: np.ndarray) -> np.ndarray:
    """Token by rank."""
    return np.lexsort((np.arange(len(counts)), -counts))


def token_columns(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> tuple[DataFrame, np.ndarray]:
    """((doc_id, n_tokens, control, data), token of each rank). rank_rows makes a table of the latter."""
    if importlib.util.find_spec("tiktoken") is None:
        raise ModuleNotFoundError("tiktoken is needed to read byte-pair vocabularies")
    size = load_tokenizer(path, pattern).n_vocab
    width = 2 if size <= 1 << 16 else 4
    ids = materialize(tokenized(docs, path, pattern), "token-ids")
    by_rank = ranked(token_counts(ids, width, size))
    rank_of = np.empty(size, np.uint32)
    rank_of[by_rank] = np.arange(size)
    shared = docs.sparkSession.sparkContext.broadcast(rank_of)

    def code(batches):
        table = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                own = batch.slice(i, 1024)
                column = own.column(2)
                mask = np.asarray(column.is_null())
                raw = column.to_pylist()
                numbers = np.frombuffer(b"".join(x or b"" for x in raw), f"<u{width}")
                edge = np.concatenate([[0], np.cumsum([len(x or b"") // width for x in raw])]).astype(np.int64)
                control, control_edge, data, data_edge = encode(table[numbers], edge)
                yield pa.record_batch([own.column(0), own.column(1), binaries(control, control_edge, mask), binaries(data, data_edge, mask)], ["doc_id", "n_tokens", "control", "data"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ids.mapInArrow(code, f"doc_id {kind}, n_tokens long, control binary, data binary"), by_rank


def rank_rows(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(rank, token, n, bytes) of the tokens that occur: the id of token_columns, the tokenizer's id, how often it occurs, its bytes."""
    tokenizer = load_tokenizer(path, pattern)
    counts = token_counts(materialize(tokenized(docs, path, pattern).select("ids"), "rank-ids"), 2 if tokenizer.n_vocab <= 1 << 16 else 4, tokenizer.n_vocab)
    by_rank = ranked(counts)
    rows = [(rank, int(t), int(counts[t]), bytearray(tokenizer.decode_single_token_bytes(int(t)))) for rank, t in enumerate(by_rank[: int((counts > 0).sum())])]
    return docs.sparkSession.createDataFrame(rows, "rank long, token long, n long, bytes binary")

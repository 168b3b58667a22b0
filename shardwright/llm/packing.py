"""Length buckets of least padding, and token-budget batches in each.

Dynamic programming over the global histogram of lengths chooses `buckets` upper bounds so that the padding of all documents to
the bound of their bucket is least (of equal choices that with the smallest bounds, from the last bucket down). A batch of a bucket with bound b
holds max(1, budget // b) documents, in random order; a document longer than the budget is a batch of its own.

Cases: documents without a word (null, empty, blank) have length 0, count in the histogram and are packed like others, with a bound of
at least 1 for the batch size. Repeated rows are packed one by one. Rows with one doc_id and other texts, or without a doc_id, have
keys by their text, so the order is the same in every run and no key gathers many rows but equal ones. With fewer lengths than buckets each length is a bucket. Empty tables give empty results. Only doc_id and
text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .ranges import digits_for, random_key, token_counts, with_position

BUCKETS, BUDGET, SEED = 8, 32_768, "pack"


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of least total padding; lengths ascend. O(buckets n log n): the cost has the Monge property."""
    n = len(lengths)
    if n == 0:
        return []
    total = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    # padding of lengths i..j-1 to lengths[j-1], up to a constant: bound times documents; the sum of all lengths is the same for any choice
    cost = lambda i, j: lengths[j - 1] * (total[j] - total[i])
    best = np.array([0, *cost(0, np.arange(1, n + 1))], np.int64)
    choice = [np.zeros(n + 1, np.int64)]
    for k in range(2, min(buckets, n) + 1):
        now, own = best.copy(), np.zeros(n + 1, np.int64)
        todo = [(k, n, k - 1, n - 1)]
        while todo:
            a, b, lo, hi = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(max(lo, k - 1), min(hi, j - 1) + 1)
            each = best[i] + cost(i, j)
            at = int(np.argmin(each))
            now[j], own[j] = each[at], i[at]
            todo += [(a, j - 1, lo, int(i[at])), (j + 1, b, int(i[at]), hi)]
        best = now
        choice.append(own)
    bounds, j = [], n
    for own in reversed(choice):
        bounds.append(int(lengths[j - 1]))
        j = int(own[j])
    return bounds[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, seed: str = SEED) -> DataFrame:
    """(doc_id, n_tokens, bucket, bound, batch): bucket counts from 0, batch from 0 in its bucket."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", random_key(seed, F.col("doc_id"), F.md5("text")).alias("key"))
    counts = materialize(token_counts(keyed, "doc_id", "key"), "pack-counts")
    histogram = sorted((r.n_tokens, r["count"]) for r in counts.groupBy("n_tokens").count().toLocalIterator())
    lengths, numbers = (np.array([h[i] for h in histogram], np.int64) for i in (0, 1))
    bounds = best_bounds(lengths, numbers, buckets)
    rows = int(numbers.sum()) if len(numbers) else 0
    bound_list = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    # bounds ascend: the bucket is the number of bounds below the length
    bucket = F.size(F.filter(bound_list, lambda b: b < F.col("n_tokens")))
    placed = counts.withColumn("bucket", bucket).withColumn("bound", F.get(bound_list, F.col("bucket")))
    placed = with_position(placed, "bucket", "key", digits_for(rows), "position")
    per_batch = F.greatest(F.lit(1).cast("long"), F.expr(f"{int(budget)}L div greatest(bound, 1L)"))
    return placed.withColumn("per", per_batch).select("doc_id", "n_tokens", "bucket", "bound", F.expr("position div per").alias("batch"))

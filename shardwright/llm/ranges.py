"""Ordered positions without one big sort: keys are random hex strings, so their prefixes cut the key range into even pieces.

Totals per piece give each piece its offset; only rows of one piece are sorted together.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import word_counts

ROWS_PER_PIECE = 250_000


def random_key(seed: str, *parts: Column) -> Column:
    """32 hex digits, the same in other engines: md5 of the parts joined by ':', null as ''."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def digits_for(rows: int) -> int:
    """Hex digits of the prefix, so that a piece has about ROWS_PER_PIECE rows."""
    digits = 1
    while rows > ROWS_PER_PIECE * 16**digits:
        digits += 1
    return digits


def token_counts(docs: DataFrame, *columns: str) -> DataFrame:
    """(columns..., n_tokens): words of each text, no text leaves the scan."""

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(word_counts(batch.column(0)))], names=[*batch.schema.names[1:], "n_tokens"])

    source = docs.select("text", *columns)
    return source.mapInArrow(count, source.drop("text").withColumn("n_tokens", F.lit(0).cast("long")).schema)


def with_position(df: DataFrame, group: str, key: str, digits: int, name: str) -> DataFrame:
    """df with the 0-based position of each row in its group (not null), in the order of key.

    Rows that are equal in all columns count as one with a multiplicity until they have their places, so that many equal ones fill no task."""
    own, weight = df.columns, "__times"
    df = df.groupBy(*own).agg(F.count(F.lit(1)).alias(weight))
    piece = F.substring(F.col(key), 1, digits)
    sizes = df.groupBy(F.col(group).alias("__g"), piece.alias("__p")).agg(F.sum(weight).alias("__n"))
    before = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    # rows of one key that differ elsewhere have an order, too
    within = Window.partitionBy(F.col(group), F.col("__p")).orderBy(key, *[c for c in own if c != key]).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("__p", piece).withColumn("__r", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    offsets = offsets.withColumnRenamed("__p", "__q")
    joined = placed.join(offsets, (placed[group] == offsets["__g"]) & (placed["__p"] == offsets["__q"]))
    first = F.col("__r") + F.col("__o")
    return joined.select(*own, F.explode(F.sequence(first, first + F.col(weight) - 1)).alias(name))

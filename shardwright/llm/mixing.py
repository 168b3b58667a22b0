"""Mix sources to target weights: each source gives its share of the token budget, whole documents in random order.

Every row has a random key. A source with budget b and t tokens gives all its documents b // t times, and from a last epoch, in
the order of that epoch's keys, those before which fewer than b mod t tokens stand; take_tokens of the last one counts only
what is left of the budget, so the sum is the budget to the token; mix_documents cuts that document's text behind its last word
that counts. Prefix sums come from totals per key range, so no source is sorted as a whole.

Weights are those given, else proportional to tokens ** temperature. The budget is that given, else all tokens there are.

Cases: a null source is a source of its own, ''. Documents without a word have no tokens and are left out. Sources without tokens give
nothing and their weight is shared by the others. Rows with equal keys (repeated doc_ids of one source) enter together or not at all. A null doc_id
counts as ''. Empty tables give empty results. Columns epoch, prefix_tokens and take_tokens of the report replace those of docs; mix_documents
passes all columns on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .ranges import digits_for, random_key, token_counts
from .text import free_names

SEED, TEMPERATURE = "mix", 0.7
BROADCAST_SOURCES = 100_000
SPACE, WORD = r"[\t-\r ]", r"[^\t-\r ]"


def source_plan(counts: DataFrame, weights: dict[str, float] | None, budget: int | None, temperature: float) -> DataFrame:
    """(src, whole, rest): whole epochs and tokens of the last epoch of each source that gives any; a small table, written, never on the driver."""
    spark = counts.sparkSession
    totals = materialize(counts.groupBy("src").agg(F.sum("n_tokens").alias("t")).where("t > 0"), "mix-totals")
    if weights:
        given = spark.createDataFrame([(k, float(v)) for k, v in sorted(weights.items())], "src string, share double")
        shared = totals.join(given, "src").where("share > 0")
    else:
        shared = totals.withColumn("share", F.pow(F.col("t").cast("double"), F.lit(float(temperature))))
    # sums in the order of the sources, so that rounding is the same everywhere
    ordered = F.aggregate(F.array_sort(F.collect_list(F.struct("src", "share"))), F.lit(0.0), lambda a, x: a + x.share)
    whole = shared.agg(ordered.alias("w")).first()[0] if totals.count() <= BROADCAST_SOURCES else shared.agg(F.sum("share")).first()[0]
    total = budget if budget is not None else totals.agg(F.sum("t")).first()[0] or 0
    tokens = F.floor(F.lit(int(total)) * F.col("share") / F.lit(float(whole or 1.0))).cast("long").alias("b")
    return shared.select("src", "t", tokens).select("src", F.expr("b div t").alias("whole"), F.expr("b % t").alias("rest"))


def _source(docs: DataFrame) -> DataFrame:
    return docs.withColumn("src", F.coalesce(F.col("source").cast("string"), F.lit("")))


def first_words(text: Column, n: Column) -> Column:
    """text up to the end of its n-th word; all of it if it has no more words than n."""
    # a word with the white space behind it is a part, and so is white space before the first word
    parts = F.split(text, rf"(?<={SPACE})(?={WORD})", -1)
    n = n + F.when(text.rlike(f"^{SPACE}"), 1).otherwise(0)
    return F.when(F.size(parts) <= n, text).otherwise(F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), n.cast("int")), ""), rf"{SPACE}+\z", ""))


def selection(docs: DataFrame, weights=None, budget=None, temperature: float = TEMPERATURE, seed: str = SEED):
    """(one row per document, source plan, prefix sums of the last epochs by key)."""
    slim = _source(docs.select("doc_id", "source", "text")).select("doc_id", "src", "text")
    counts = materialize(token_counts(slim, "doc_id", "src").where("n_tokens > 0"), "mix-counts")
    plan = materialize(source_plan(counts, weights, budget, temperature), "mix-plan")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    n = counts.count()
    keyed = counts.join(plan, "src").withColumn("key", random_key(seed, F.col("whole"), F.col("src"), F.col("doc_id")))
    # rows with equal keys count as one
    sums = keyed.groupBy("src", "rest", "key").agg(F.sum("n_tokens").alias("t")).withColumn("piece", F.substring("key", 1, digits_for(n)))
    totals = sums.groupBy("src", "piece").agg(F.sum("t").alias("s"))
    before = Window.partitionBy("src").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("o", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    # pieces behind the cut are never sorted
    live = sums.join(offsets, ["src", "piece"]).where("o < rest")
    inside = Window.partitionBy("src", "piece").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    prefix = live.withColumn("prefix_tokens", F.col("o") + F.coalesce(F.sum("t").over(inside), F.lit(0))).where("prefix_tokens < rest")
    return keyed, plan, prefix.select("src", "key", "prefix_tokens", "t")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, prefix_tokens, take_tokens): a row for each time a document is used.

    prefix_tokens is -1 in whole epochs, where the order plays no part."""
    keyed, _, prefix = selection(docs, **options)
    whole = keyed.where("whole > 0").select("doc_id", "src", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"), F.lit(-1).cast("long").alias("prefix_tokens"), F.col("n_tokens").alias("take_tokens"))
    last = keyed.join(prefix, ["src", "key"]).select("doc_id", "src", "n_tokens", F.col("whole").alias("epoch"), "prefix_tokens", F.least("n_tokens", F.col("rest") - F.col("prefix_tokens")).alias("take_tokens"))
    return whole.unionByName(last).withColumnRenamed("src", "source")


def mix_documents(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The rows of docs, each as often as it is used. Only a cut per source reaches the scan; no text is shuffled.

    The text of the last document of a source ends where its budget does, and n_chars is counted anew where it exists."""
    names = docs.columns
    source, own_source, w, k, left, epoch, cut = free_names(names, "src", "own", "whole", "key", "left", "epoch", "cut")
    _, plan, prefix = selection(docs, seed=seed, **options)
    last = prefix.groupBy("src").agg(F.max(F.struct("key", "prefix_tokens")).alias("m"))
    cuts = plan.join(last, "src", "left").select(F.col("src").alias(source), F.col("whole").alias(w), F.col("m.key").alias(k), (F.col("rest") - F.col("m.prefix_tokens")).alias(left))
    cuts = materialize(cuts, "mix-cuts")
    own = docs.withColumn(own_source, F.coalesce(F.col("source").cast("string"), F.lit("")))
    key = random_key(seed, F.col(w), F.col(source), F.col("doc_id"))
    used = F.col(w) + F.when(key <= F.col(k), 1).otherwise(0)
    blank = F.trim(F.translate("text", "\n\t\r\v\f", "     ")) == ""
    # a row per source of the plan; with very many sources the join is left to the optimizer
    joined = own.join(F.broadcast(cuts) if cuts.count() <= BROADCAST_SOURCES else cuts, F.col(own_source) == F.col(source)).where(~F.coalesce(blank, F.lit(True)) & (used > 0))
    each = joined.withColumn(epoch, F.explode(F.sequence(F.lit(1), used))).withColumn(cut, F.coalesce((key == F.col(k)) & (F.col(epoch) > F.col(w)), F.lit(False)))
    text = F.when(F.col(cut), first_words(F.col("text"), F.col(left))).otherwise(F.col("text"))
    out = each.select(*[text.alias(n) if n == "text" else F.col(f"`{n}`") for n in names], cut)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(cut), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(cut)

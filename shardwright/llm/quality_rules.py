"""Quality rules whose cutoff limits the share of good documents rejected.

Each rule is a share of a text in steps of 1/SCALE; high values are bad. Half of the labelled documents (by a hash of doc_id) trains, the
other half is the holdout. In each stratum (lang) training turns a rule's value v into a score: the highest share, in steps of 1/1000, of
bad ones among the training documents whose value is at least u, over all u <= v. A document's score is the highest one of
its rules, so all rules together are one scale, and a cutoff c rejects the documents of a higher score.

On the holdout good documents above c are binomial, so with n good documents of which k lie above c the rejection rate is below ALPHA with
confidence 1 - d if P(Bin(n, ALPHA) <= k) <= d. Cutoffs are tested from the highest down, until one fails (fixed sequence, which
needs no correction within a stratum), and d is DELTA over the number of strata (Bonferroni): with confidence 1 - DELTA no stratum loses ALPHA of
its good documents or more. Among the cutoffs certified, that with the most bad documents less COST times the good ones rejected is taken,
the highest of equals; where none is certified or gains anything, all stay. COST is (1 - ALPHA) / ALPHA: a lower cutoff is worth it only if at least
1 - ALPHA of the documents that it rejects in addition are bad.

Only histograms by value and stratum reach the driver, never rows; all labelled documents count.

Cases: null and empty texts have the value 0 in every rule. A null lang is the stratum ''. Strata without labels keep everything. Labels with a
null doc_id or quality don't count; a document with several labels is good if one of them says so. Rows of docs with a repeated or
null doc_id are judged by their own text. Empty tables give empty results. Other columns are passed on; only the result of op8 adds
columns, and these replace columns of the same name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .text import Hasher, flat, free_names, groups, lines, pieces, runs, small, space_table, words

SCALE, STEPS = 10_000, 1000
ALPHA, DELTA = 0.05, 0.05
COST = 19
LONG_WORD = 24
SYMBOLS = b"#$%&*|!<>{}[]^~=+_\\@/"
RULES = ("symbol_share", "upper_share", "repeat_share", "digit_share", "line_repeat_share", "long_word_share")


def rule_values(column, hasher: Hasher) -> np.ndarray:
    """int [documents, rules].

    Of bytes that aren't white space: symbols, ASCII capitals, ASCII digits. Of words: those equal to the one before, those
    of more than LONG_WORD bytes. Of lines that aren't blank: those that stood in the document before."""
    raw, offsets = flat(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(RULES)), np.int64)
    kind = np.zeros(256, np.uint64)
    kind[~space_table()] += np.uint64(1)
    # three counters of 21 bits fit a group, as long as it has less than 2 MB; larger documents are counted apart
    one, two = np.uint64(1 << 21), np.uint64(1 << 42)
    kind[list(SYMBOLS)] += one
    kind[65:91] += two
    digit = np.zeros(256, bool)
    digit[48:58] = True
    low = np.uint64((1 << 21) - 1)
    for i, j in groups(offsets):
        x = raw[offsets[i] : offsets[j]]
        edges = offsets[i : j + 1] - offsets[i]
        if len(x) < 1 << 21:
            total = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(kind[x], out=total[1:])
            own = total[edges[1:]] - total[edges[:-1]]
            ink, symbol, upper = (((own >> np.uint64(s)) & low).astype(np.int64) for s in (0, 21, 42))
        else:
            own = kind[x]
            ink, symbol, upper = (np.array([int(((own >> np.uint64(s)) & low).sum())]) for s in (0, 21, 42))
        digits = np.zeros(len(x) + 1, np.int64)
        np.cumsum(digit[x], out=digits[1:])
        for r, v in ((0, symbol), (1, upper), (3, digits[edges[1:]] - digits[edges[:-1]])):
            out[i:j, r] = v * SCALE // np.maximum(ink, 1)
    hashes, at, start, end = words(column, hasher, spans=True)
    n_words = np.maximum(np.diff(at), 1)
    equal = np.zeros(len(hashes) + 1, np.int64)
    long = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes):
        same = np.zeros(len(hashes), bool)
        same[1:] = hashes[1:] == hashes[:-1]
        heads = at[:-1]
        same[heads[heads < len(hashes)]] = False
        np.cumsum(same, out=equal[1:])
        np.cumsum(end - start > LONG_WORD, out=long[1:])
    out[:, 2] = (equal[at[1:]] - equal[at[:-1]]) * SCALE // n_words
    out[:, 5] = (long[at[1:]] - long[at[:-1]]) * SCALE // n_words
    hashes, doc, *_ = lines(column, hasher)
    by = np.lexsort((hashes, doc))
    again = np.zeros(len(by), bool)
    again[1:] = (hashes[by][1:] == hashes[by][:-1]) & (doc[by][1:] == doc[by][:-1])
    repeated, total = np.bincount(doc[by][again], minlength=n), np.bincount(doc, minlength=n)
    out[:, 4] = repeated * SCALE // np.maximum(total, 1)
    return out


@dataclass(frozen=True)
class Scale:
    """What training found: by stratum and rule the values where the score rises, and the scores from there on; and the cutoffs by stratum."""

    steps: dict[str, list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=dict)
    cutoffs: dict[str, int] = field(default_factory=dict)

    def scores(self, values: np.ndarray, strata: pa.DictionaryArray) -> np.ndarray:
        out, code = np.zeros(len(values), np.int64), np.asarray(strata.indices)
        for i, name in enumerate(strata.dictionary.to_pylist()):
            own = np.flatnonzero(code == i)
            for r, (at, score) in enumerate(self.steps.get(name, ())):
                place = np.searchsorted(at, values[own, r], "right")
                out[own] = np.maximum(out[own], np.append(0, score)[place])
        return out

    def kept(self, scores: np.ndarray, strata: pa.DictionaryArray) -> np.ndarray:
        limit = np.array([self.cutoffs.get(s, STEPS) for s in strata.dictionary.to_pylist()] or [STEPS])
        return scores <= limit[np.asarray(strata.indices)]


def with_values(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, rules...)."""

    def value(batches):
        hasher = Hasher()
        for batch in pieces(batches, 2):
            v = rule_values(batch.column(2), hasher)
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(v[:, r].astype(np.int32)) for r in range(len(RULES)))], ["doc_id", "stratum", *RULES])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), "text")
    return source.mapInArrow(value, "doc_id long, stratum string, " + ", ".join(f"{r} int" for r in RULES))


def most_rejected(n: int, alpha: float, delta: float) -> int:
    """The largest k with P(Bin(n, alpha) <= k) <= delta, -1 if there is none."""
    tail, k = 0.0, -1
    while k < n:
        i = k + 1
        tail += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(alpha) + (n - i) * math.log1p(-alpha))
        if tail > delta:
            return k
        k = i
    return k


def rising_scores(value: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values where the score rises, scores) from training counts by ascending value."""
    g, b = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    score = np.maximum.accumulate(b * STEPS // (b + g + 1)) if len(value) else np.zeros(0, np.int64)
    head = runs(score)[:-1] if len(value) else np.zeros(0, np.int64)
    return value[head], score[head]


def choose_cutoff(good: np.ndarray, bad: np.ndarray, alpha: float, delta: float) -> int | None:
    """Cutoff from the holdout's histograms of good and bad documents by score, None if nothing is certified or gained."""
    n, m = int(good.sum()), int(bad.sum())
    k = most_rejected(n, alpha, delta) if n else -1
    if k < 0 or not m:
        return None
    good_above = n - np.cumsum(good)
    bad_above = m - np.cumsum(bad)
    gain = bad_above - COST * good_above
    best = None
    for c in range(len(good) - 1, -1, -1):
        if good_above[c] > k:
            break
        if gain[c] > 0 and (best is None or gain[c] > gain[best]):
            best = c
    return best


def fit_cutoffs(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> Scale:
    """Scores from the training half, cutoffs from the holdout half of all labelled documents."""
    truth = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    # where the ids fit in a broadcast, only labelled texts are valued; no text is shuffled in either case
    ids, fits = small(truth.select("doc_id"))
    source = docs.select("doc_id", "lang", "text")
    if fits:
        source = source.join(ids, source["doc_id"].cast("long") == ids["doc_id"], "left_semi")
    train = F.substring(F.md5(F.concat(F.lit("quality:"), F.col("doc_id").cast("string"))), 1, 1) < "8"
    seen = materialize(with_values(source).join(truth, "doc_id").select("stratum", (F.col("quality") > 0).alias("good"), train.alias("train"), *RULES), "quality-values")
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.col(r).alias("value")) for i, r in enumerate(RULES)])).alias("p")
    counts = seen.where("train").select("stratum", "good", pairs).groupBy("stratum", "p.rule", "p.value").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    found: dict[str, list[list]] = {}
    for r in counts.toLocalIterator():
        found.setdefault(r.stratum, [[] for _ in RULES])[r.rule].append((r.value, r.g, r.b))
    steps = {s: [rising_scores(*np.array(sorted(x), np.int64).reshape(-1, 3).T) for x in each] for s, each in found.items()}
    scale = Scale(steps)

    def score(batches):
        for batch in batches:
            v = np.stack([np.asarray(c) for c in batch.columns[2:]], 1) if batch.num_rows else np.zeros((0, len(RULES)), np.int32)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scale.scores(v, batch.column(0).dictionary_encode()).astype(np.int32))], ["stratum", "good", "score"])

    held = seen.where("not train").select("stratum", "good", *RULES).mapInArrow(score, "stratum string, good boolean, score int").groupBy("stratum", "score").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    by: dict[str, np.ndarray] = {}
    for r in held.toLocalIterator():
        by.setdefault(r.stratum, np.zeros((2, STEPS + 1), np.int64))[:, r.score] += [r.g, r.b]
    cutoffs = {s: c for s, h in by.items() if (c := choose_cutoff(h[0], h[1], alpha, delta / len(by))) is not None}
    return Scale(steps, cutoffs)


def apply_rules(docs: DataFrame, scale: Scale, values: bool = False) -> DataFrame:
    """The documents that are not rejected; with `values` as (doc_id, lang, rules..., score)."""
    names = docs.columns
    (stratum,) = free_names(names, "stratum")
    own = docs.select(*[F.col(f"`{n}`") for n in names], F.coalesce(F.col("lang").cast("string"), F.lit("")).alias(stratum))
    text, ident, lang = (names.index(n) for n in ("text", "doc_id", "lang"))

    def keep(batches):
        hasher = Hasher()
        for batch in pieces(batches, text):
            v = rule_values(batch.column(text), hasher)
            strata = batch.column(batch.num_columns - 1).dictionary_encode()
            score = scale.scores(v, strata)
            if values:
                out = pa.record_batch([batch.column(ident), batch.column(lang), *(pa.array(v[:, r].astype(np.int32)) for r in range(len(RULES))), pa.array(score.astype(np.int32))], ["doc_id", "lang", *RULES, "score"])
            else:
                out = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
            yield out.filter(pa.array(scale.kept(score, strata)))

    schema = docs.select("doc_id", "lang", *[F.lit(0).alias(r) for r in (*RULES, "score")]).schema if values else docs.schema
    return own.mapInArrow(keep, schema)

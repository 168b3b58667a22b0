"""Each operator against a plain brute-force version, on a small corpus with awkward rows."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardwright.llm import license_scan, line_dedup, lm_score, media, mixing, near_dedup, packing, quality_rules, queries, suffix_dedup, token_ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, line string, src string, key string, h string, epoch string"


def build_corpus():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 7))) for _ in range(1500)]
    sentence = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = sentence(70)
    docs = []
    for i in range(90):
        parts = [sentence(r.randint(3, 40)) for _ in range(r.randint(1, 8))]
        if i % 9 == 0:
            parts.insert(1, passage)
        docs.append("\n".join(parts))
    docs += [docs[3], docs[3], docs[4]]  # exact copies
    for i in (5, 6, 7, 5):  # near copies
        w = docs[i].split(" ")
        for k in range(0, len(w), 25):
            w[k] = r.choice(vocabulary)
        docs.append(" ".join(w))
    docs += ["", " \n\t ", None, "one", "two words", "é ü ñ\n x", "und " * 400, "und " * 300, sentence(9000), "x" * 60_000, "a\nb\na\n\nb"]
    langs = ["en", "fr", None, ""]
    rows = [(i, t, langs[i % 4], f"s{i % 3}" if i % 7 else None, len(t or ""), "c", "c", "c", "c", "c", "c") for i, t in enumerate(docs)]
    return rows


ROWS = build_corpus()


@pytest.fixture(scope="module")
def docs(spark):
    # repeated rows, and a null doc_id
    return spark.createDataFrame([*ROWS, ROWS[10], (None, "nobody owns this text", "en", "s1", 21, "c", "c", "c", "c", "c", "c")], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def unique(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]


def roots(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# 1


@pytest.mark.parametrize("order,fan", [(1, 4096), (2, 4096), (3, 4096), (3, 4), (2, 2)])
def test_lm_scores(docs, order, fan):
    """Blocks of 20 kB; with a small fan pieces are merged on the way."""
    got = defaultdict(list)
    for row in lm_score.lm_scores(docs, order=order, block_bytes=20_000, fan=fan).collect():
        got[row.doc_id].append(row)
    rows = [(r.doc_id, split(r.text)) for r in docs.collect()]
    grams = lambda s: Counter(tuple(s[i - m + 1 : i + 1]) for m in range(1, order + 1) for i in range(m - 1, len(s)))
    seqs = [(i, ["<s>", *w, "</s>"]) for i, w in rows if w]
    total = Counter()
    for _, s in seqs:
        total.update(grams(s))
    n = sum(len(s) - 1 for _, s in seqs)

    def chance(g, own, rest):
        c = total[g] - own[g]
        if len(g) == 1:
            return max(c, 1) / (rest + 1)
        return (c + lm_score.BETA * chance(g[1:], own, rest)) / (total[g[:-1]] - own[g[:-1]] + lm_score.BETA)

    for i, s in seqs:
        own = grams(s)
        want = sum(math.log(chance(tuple(s[max(0, j - order + 1) : j + 1]), own, n - len(s) + 1)) for j in range(1, len(s)))
        assert got[i][0].log_prob == pytest.approx(want, rel=1e-9)
        assert got[i][0].perplexity == pytest.approx(math.exp(min(700, -want / (len(s) - 1))), rel=1e-6)
    assert all(r.log_prob is None and r.n_words == 0 for i, w in rows if not w for r in got[i])
    assert len(got[10]) == 2 and got[10][0].log_prob == got[10][1].log_prob


def test_registered_order(spark, unique, tmp_path):
    """The query scores with trigram states, not with neighbours alone."""
    unique.write.parquet(f"{tmp_path}/documents.parquet")
    scores = lambda df: {r.doc_id: r.log_prob for r in df.where("n_words > 0").collect()}
    got = scores(queries.op1_lm_score(spark, str(tmp_path)))
    want, less = (scores(lm_score.lm_scores(unique, order=order)) for order in (3, 2))
    assert got == pytest.approx(want, rel=1e-9) and got[3] != pytest.approx(less[3], rel=1e-6)


def test_empty_tables(empty):
    assert lm_score.lm_scores(empty).count() == 0 and suffix_dedup.repeated_passages(empty).count() == 0


def test_key_packing():
    r = np.random.default_rng(0)
    for n, high in ((1, 2**64 - 1), (5, 9), (1000, 2**64 - 1), (300, 2**40)):
        keys = np.sort(r.integers(0, high, n, dtype=np.uint64, endpoint=True))
        for base in (0, int(keys[0])):
            assert (lm_score.unpacked_keys(lm_score.packed_keys(keys, base), base) == keys).all()


def test_count_packing():
    for counts in ([0], [254, 255, 256, 0, 1], [1 << 40, 3]):
        raw = lm_score.packed_counts(np.array(counts))
        assert lm_score.unpacked_counts(raw, len(counts)).tolist() == counts


def test_repeated_rows_spread(spark):
    """Half of all rows are one row; it doesn't gather in one block, and each of its rows scores alike."""
    rows = [(1, "one two three four five six")] * 400 + [(i, f"one two w{i} four v{i}") for i in range(2, 402)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = lm_score.lm_scores(df, block_bytes=2000).collect()
    assert len(got) == 800 and len({round(r.log_prob, 9) for r in got if r.doc_id == 1}) == 1


def test_lm_is_a_distribution():
    """What the arcs of a state give, and its failure arc gives to all others, adds up to 1, each other document's words counted."""
    import pyarrow as pa

    from shardwright.llm.text import Hasher

    texts, others = ["a b a c", "a b d", "b a b a"], ["a b c a b d", "b a c"]
    tokens, edge, _ = lm_score.sequences(pa.array(texts + others), Hasher())
    keys, valid = lm_score.grams(tokens, edge, 2, 64)
    count, one, index = lm_score.indexed(np.concatenate([k[v] for k, v in zip(keys, valid)]))
    names, seen = [], 0
    for v in valid:
        own = np.zeros(len(v), np.int32)
        own[v] = index[seen : (seen := seen + int(v.sum()))]
        names.append(own)
    n = int((np.diff(edge) - 1).sum())
    auto = lm_score.Automaton(edge, names, valid, count, n, 8.0)
    assert np.isfinite(auto.weight).all() and (auto.weight <= 1e-12).all() and (auto.fail_weight <= 0).all()
    # the unigrams that the last document sees elsewhere, and the share of one unseen word
    rest = n - (edge[-1] - edge[-2] - 1)
    seen = {g: c for g, c in zip(names[0][edge[-2] :].tolist(), auto.count[auto.reads[0, edge[-2] :]].tolist())}
    assert all(np.exp(auto.weight[auto.reads[0, edge[-2] + i]]) == pytest.approx(max(seen[g], 1) / (rest + 1)) for i, g in enumerate(names[0][edge[-2] :].tolist()))


# 2


def brute_passages(rows, n):
    where = defaultdict(list)
    for i, text in rows:
        w = split(text)
        for p in range(len(w) - n + 1):
            where[tuple(w[p : p + n])].append((i, p))
    hits = defaultdict(set)
    for places in where.values():
        ids = {i for i, _ in places}
        if len(ids) > 1:
            for i, p in places:
                hits[i, i != min(ids)].add(p)
    out = set()
    for (i, later), starts in hits.items():
        run = None
        for p in sorted(starts):
            if run and p <= run[1]:
                run[1] = p + n
            else:
                if run:
                    out.add((i, run[0], run[1] - run[0], later))
                run = [p, p + n]
        out.add((i, run[0], run[1] - run[0], later))
    return out


@pytest.mark.parametrize(("n", "k", "hot"), [(50, 25, suffix_dedup.HOT), (20, 7, 5), (20, 7, 0), (12, 12, suffix_dedup.HOT)])
def test_suffix_passages(docs, n, k, hot):
    """Anchors of more than `hot` places go the other way, to the same answer."""
    got = {tuple(r) for r in suffix_dedup.repeated_passages(docs, n, k, hot).collect()}
    assert got == brute_passages([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], n)
    assert got


def test_suffix_array_is_sorted():
    for seed in range(150):
        r = random.Random(seed)
        strings = [[r.randint(0, r.choice([1, 2, 6])) for _ in range(r.randint(1, 14))] for _ in range(r.randint(1, 7))]
        symbols, ends = np.array([v for s in strings for v in s], np.uint32), np.cumsum([len(s) for s in strings])
        text = suffix_dedup.close(symbols, ends)[0][:-64].tolist()
        order = suffix_dedup.suffix_array(symbols, ends, 64)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        lcp = suffix_dedup.common_prefix(suffix_dedup.close(symbols, ends)[0], order, 30)
        for i in range(1, len(order)):
            a, b = text[order[i - 1] :], text[order[i] :]
            assert lcp[i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_wide_sort_keys():
    """Groups and symbols that take more than 64 bits together are still sorted as a whole."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.integers(1, 4, 3000, dtype=np.uint64), np.zeros(64, np.uint64)])
    at = np.arange(3000)
    for bits in (2, 30, 32):
        got = suffix_dedup.sort_directly(x, at.copy(), bits, 40)
        assert got.tolist() == sorted(range(3000), key=lambda i: x[i : i + 64].tolist())


def test_winnowing_keeps_every_window():
    for seed in range(30):
        r = random.Random(seed)
        hashes = np.array([r.choice([1, 1, 1, r.getrandbits(60)]) for _ in range(200)], np.uint64)
        place, _ = suffix_dedup.anchors(hashes, np.array([0, 90, 90, 200]), 20, 8)
        chosen = set(place.tolist())
        for lo, hi in ((0, 90), (90, 200)):
            assert all(chosen & set(range(p, p + 13)) for p in range(lo, hi - 19))


# 3


def test_media_round_trip(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, r.randbytes(r.choice([0, 10, 5000]))) for i in range(200)] + [(None, b"x"), (7, None)]
    df = spark.createDataFrame(rows, "page_id long, html binary")
    n, _ = media.write_archives(df.repartition(3), str(tmp_path / "a"), "page_id", "html", archive_bytes=60_000)
    got = media.read_archives(spark, str(tmp_path / "a"), range_bytes=7_000, batch_bytes=10_000).collect()
    assert n == len(got) == 201 and all(g.error is None and g.attempts == 1 for g in got)
    assert sorted(bytes(g.payload) for g in got) == sorted(b for _, b in rows if b is not None)
    assert sum(g.member.endswith("-7") for g in got) == 1


def test_media_members_fail_alone(spark, tmp_path):
    df = spark.createDataFrame([(i, bytes([i]) * 1000) for i in range(20)], "page_id long, html binary").coalesce(1)
    media.write_archives(df, str(tmp_path / "a"), "page_id", "html")
    path = next((tmp_path / "a").glob("*.zip"))
    good = media.read_archives(spark, str(tmp_path / "a")).orderBy("offset").collect()
    raw = bytearray(path.read_bytes())
    raw[good[5].offset] = 0  # its header
    raw[good[9].offset + 40 : good[9].offset + 44] = b"\xff\xff\xff\xff"  # its data
    path.write_bytes(raw)
    (tmp_path / "a" / "bad.zip").write_bytes(b"no archive")
    got = media.read_archives(spark, str(tmp_path / "a"), retries=2).collect()
    failed = {g.member: g for g in got if g.error}
    assert set(failed) == {good[5].member, good[9].member, None} and all(g.attempts == 3 and g.payload is None for g in failed.values())
    assert len(got) == 21


def test_media_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, html binary")
    assert media.write_archives(df, str(tmp_path / "a"), "page_id", "html") == (0, 0)
    assert media.read_archives(spark, str(tmp_path / "none")).count() == 0
    assert media.page_media(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_media_ids(spark):
    """Negative, text and null ids come back as they were, in the type of the column."""
    import hashlib

    for kind, ids in (("long", [-5, 12, None, 2**40]), ("string", ["ab-12", "xy", None, "-7"])):
        df = spark.createDataFrame([(i, f"u{k}", f"<html>{k}") for k, i in enumerate(ids)], f"page_id {kind}, url string, html string")
        got = media.page_media(df)
        assert dict(got.dtypes)["page_id"] == dict(df.dtypes)["page_id"]
        assert {(r.page_id, r.digest) for r in got.collect()} == {(i, hashlib.sha256(f"<html>{k}".encode()).hexdigest()) for k, i in enumerate(ids)}


def test_media_without_payload(spark, tmp_path):
    df = spark.createDataFrame([(i, bytes([i]) * 100) for i in range(5)], "page_id long, html binary")
    media.write_archives(df, str(tmp_path / "a"), "page_id", "html")
    got = media.read_archives(spark, str(tmp_path / "a"), payload="false").collect()
    assert len(got) == 5 and all(g.size == 100 and g.payload is None and g.attempts == 0 for g in got)


# 4


def test_license_notices(spark, docs, empty):
    templates = license_scan.TEMPLATES
    by = {t.license: t for t in templates}
    texts = [
        f"x y {by['MIT-text'].text} z", by["GPL-header"].text.upper(), "foo. Licensed under CC BY-NC 4.0. bar", "the MIT License and the mit  license", "MIT is a school; License to kill", "All\nrights,\treserved",
        by["BSD"].text.replace("Redistributions", "Redistribution"), by["BSD"].text, "Apache License, Version 2.0 " + "w " * 40 + "you may not use this file except in compliance with the License", None, "",
        by["BSD-3-Clause"].text, by["Zlib"].text,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in license_scan.license_notices(df).collect()}
    want = set()
    for i, text in enumerate(texts):
        w = license_scan.fold(text or "")
        find = lambda own, w=w: [p for p in range(len(w) - len(own) + 1) if w[p : p + len(own)] == own]
        for t in templates:
            full = license_scan.fold(t.text)
            keys = [license_scan.fold(k) for k in t.keys]
            at = [next(p for p in range(len(full)) if full[p : p + len(k)] == k) for k in keys]
            for p in find(keys[0]):
                if all(any(abs((q - p) - (a - at[0])) <= license_scan.SLACK for q in find(k)) for k, a in zip(keys[1:], at[1:])):
                    want.add((i, t.license, p))
    assert {x for i, x, _ in got if i == 7} == {"BSD"} and {x for i, x, _ in got if i == 11} >= {"BSD", "BSD-3-Clause"} and {x for i, x, _ in got if i == 12} == {"Zlib"}
    assert got == want and {(0, "MIT-text", 2), (2, "CC-BY-NC-4.0", 3), (5, "all-rights-reserved", 0)} <= got
    assert not {r for r in got if r[0] in (4, 6, 9, 10)} and not [r for r in got if r[1] == "Apache-2.0-header"]
    assert license_scan.license_notices(docs).count() == 0 and license_scan.license_notices(empty).count() == 0


# 5


def test_token_columns(docs, empty):
    df, by_rank = token_ids.token_columns(docs)
    tokenizer = token_ids.load_tokenizer(token_ids.VOCABULARY)
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    counts, back = Counter(), Counter()
    for r in df.collect():
        if r.n_tokens is None:
            assert r.control is None and r.data is None
            back[r.doc_id, None] += 1
            continue
        ids = by_rank[token_ids.decode(r.control, r.data, r.n_tokens)].tolist()
        counts.update(ids)
        back[r.doc_id, tokenizer.decode(ids)] += 1
    assert back == texts
    assert [t for t, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))] == by_rank[: len(counts)].tolist()
    ranks = token_ids.rank_rows(docs).orderBy("rank").collect()
    assert [r.token for r in ranks] == by_rank[: len(counts)].tolist() and all(counts[r.token] == r.n and bytes(r.bytes) == tokenizer.decode_single_token_bytes(r.token) for r in ranks)
    assert token_ids.token_columns(empty)[0].count() == 0 and token_ids.rank_rows(empty).count() == 0


def test_byte_coding():
    r = np.random.default_rng(3)
    lists = [r.integers(0, 1 << b, n, dtype=np.uint64).astype(np.uint32) for b, n in ((3, 0), (8, 1), (9, 4), (17, 5), (25, 999), (32, 4000))]
    edge = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    control, control_edge, data, data_edge = token_ids.encode(np.concatenate(lists), edge)
    for i, x in enumerate(lists):
        c, d = control[control_edge[i] : control_edge[i + 1]].tobytes(), data[data_edge[i] : data_edge[i + 1]].tobytes()
        assert len(c) == -(-len(x) // 4) and len(d) == sum(max(1, (int(v).bit_length() + 7) // 8) for v in x)
        assert token_ids.decode(c, d, len(x)).tolist() == x.tolist()


# 6


def brute_lines(rows):
    seen, out = {}, []
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        kept = []
        for line in (text or "").split("\n"):
            if line.strip(" \t\r\n\v\f"):
                if line in seen:
                    continue
                seen[line] = i
            kept.append(line)
        out.append((i, "\n".join(kept) if text is not None else None))
    return out


@pytest.mark.parametrize("broadcast", [1 << 26, 0])
def test_line_dedup(docs, empty, broadcast):
    got = line_dedup.dedup_lines(docs, broadcast_bytes=broadcast)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    rows = got.collect()
    want = Counter(dict.fromkeys(brute_lines([(r.doc_id, r.text) for r in docs.collect()]), 1))
    want[next(k for k in want if k[0] == 10)] += 1  # the repeated row
    assert Counter((r.doc_id, r.text) for r in rows) == want
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    dropped = {r.doc_id for r in rows} - {r.doc_id for r in line_dedup.dedup_lines(docs, drop_emptied=True, broadcast_bytes=broadcast).collect()}
    assert {90, 91, 92} <= dropped and not dropped & {97, 98, 99}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_names_and_blanks(spark):
    """Columns named like internal ones pass; a document left with ASCII white space only goes with drop_emptied; a line in every row fills no owner."""
    rows = [(1, "same\nown one", 8, "a", "b"), (2, "same\n\f \v", 9, "c", "d"), (3, "\f", 1, "e", "f"), (4, None, 0, "g", "h"), *[(i, "same\nsame", 9, "x", "y") for i in range(5, 300)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, __own string, __gone string")
    for limit in (1 << 26, 0):
        got = line_dedup.dedup_lines(df, drop_emptied=True, broadcast_bytes=limit)
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect())) == [(1, "same\nown one", 12, "a", "b"), (3, "\f", 1, "e", "f"), (4, None, None, "g", "h")]


# 7


def brute_bounds(lengths, counts, k):
    best = None
    n = len(lengths)
    for cut in combinations(range(n - 1), min(k, n) - 1):
        ends = [*cut, n - 1]
        cost, start = 0, 0
        for e in ends:
            cost += sum(counts[i] * (lengths[e] - lengths[i]) for i in range(start, e + 1))
            start = e + 1
        best = cost if best is None else min(best, cost)
    return best


def test_bounds_are_optimal():
    for seed in range(40):
        r = random.Random(seed)
        lengths = sorted(r.sample(range(60), r.randint(1, 10)))
        counts = [r.randint(1, 9) for _ in lengths]
        for k in (1, 2, 3, 4):
            bounds = packing.best_bounds(np.array(lengths), np.array(counts), k)
            assert len(bounds) == min(k, len(lengths)) and bounds == sorted(set(bounds))
            cost = sum(c * (next(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))
            assert cost == brute_bounds(lengths, counts, k)


def test_packing(docs, empty):
    rows = packing.pack(docs, buckets=4, budget=500).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((r.doc_id, len(split(r.text))) for r in docs.collect())
    bounds = sorted({r.bound for r in rows})
    batches = defaultdict(list)
    for r in rows:
        assert r.bound == next(b for b in bounds if b >= r.n_tokens) and bounds[r.bucket] == r.bound
        batches[r.bucket, r.batch].append(r)
    for (bucket, batch), own in batches.items():
        cap = max(1, 500 // max(1, bounds[bucket]))
        last = batch == max(b for k, b in batches if k == bucket)
        assert len(own) == cap or last and 0 < len(own) < cap
    assert packing.pack(empty).count() == 0


def test_packing_ties(spark):
    """Rows without a doc_id, or with one doc_id and other texts, are packed alike however the table is cut; equal rows count each."""
    r = random.Random(8)
    rows = [(None if i % 3 else 7, "w " * r.randint(1, 30)) for i in range(300)] + [(9, "a b c")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (Counter(map(tuple, packing.pack(df.repartition(n), buckets=3, budget=60).collect())) for n in (1, 7))
    assert one == two and sum(one.values()) == 500 and sum(n for k, n in one.items() if k[0] == 9) == 200


# 8


def test_binomial_bound():
    for n, alpha, delta in ((0, 0.1, 0.05), (20, 0.1, 0.05), (100, 0.05, 0.01), (3000, 0.0125, 0.003)):
        k = quality_rules.most_rejected(n, alpha, delta)
        pmf = lambda i, n=n, a=alpha: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(a) + (n - i) * math.log(1 - a))
        assert sum(map(pmf, range(k + 1))) <= delta and (k == n or sum(map(pmf, range(k + 2))) > delta)


def test_quality_rules(spark, docs, empty):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(3000):
        lang = ["en", "fr", None][i % 3]
        bad = i % 5 == 0
        words = ["word" + str(r.randint(0, 9)) * bad for _ in range(30)]
        text = " ".join(w + "$$" for w in words) if bad else " ".join(r.choice(["calm", "tree", "Rain"]) for _ in range(30))
        rows.append((i, text, lang, "extra"))
        labels.append((i, int(not bad), 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, symbol_share string")
    known = spark.createDataFrame([*labels, labels[0], (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    scale = quality_rules.fit_cutoffs(df, known)
    assert set(scale.cutoffs) == {"en", "fr", ""}
    kept = quality_rules.apply_rules(df, scale)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {i for i in range(3000) if i % 5}
    # too few labels certify nothing
    assert not quality_rules.fit_cutoffs(df, known.where("doc_id < 60")).cutoffs
    # texts without a bad sign stay; a column that has the name of an internal one is passed on
    odd = docs.withColumn("__stratum", F.lit("x"))
    fitted = quality_rules.fit_cutoffs(odd, known)
    assert quality_rules.apply_rules(odd, fitted, values=True).count() == docs.count() and quality_rules.apply_rules(odd, fitted).columns == odd.columns
    assert not quality_rules.fit_cutoffs(empty, known).cutoffs and quality_rules.apply_rules(empty, quality_rules.Scale()).count() == 0


def test_quality_oracle_rejects(spark):
    """The registered query's SQL, on labels enough to certify, rejects the same documents; and it rejects some."""
    import duckdb

    from shardwright.llm.oracles import ORACLES

    r = random.Random(9)
    rows, labels = [], []
    for i in range(2400):
        w = [r.choice(["calm", "tree", "Rain", "of", "a1"]) for _ in range(20)]
        if i % 4 == 0:
            kind = i // 4 % 3
            w = [x + "##" for x in w] if kind == 0 else [w[0]] * 20 if kind == 1 else [x.upper() for x in w]
        rows.append((i, "\n".join([" ".join(w[:9]), " ".join(w[9:])]), "en" if i % 3 else None))
        if i % 8 < 6:
            labels.append((i, int(i % 4 != 0 or r.random() < 0.02), 0))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_rules.apply_rules(docs, quality_rules.fit_cutoffs(docs, known), values=True).toPandas()
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    c.register("labels", known.toPandas())
    want = c.execute(ORACLES["op8_quality_rules"]).df()
    key = lambda df: sorted(map(tuple, df[["doc_id", *quality_rules.RULES, "score"]].values.tolist()))
    assert key(got) == key(want) and len(got) < 2400 - 300


def test_rising_scores():
    value, score = quality_rules.rising_scores(np.array([0, 3, 7, 9]), np.array([90, 10, 1, 0]), np.array([5, 0, 4, 6]))
    assert value.tolist() == [0, 3, 7, 9] and score.tolist() == [15 * 1000 // 117, 10 * 1000 // 22, 10 * 1000 // 12, 857]


def test_rule_values():
    import pyarrow as pa

    from shardwright.llm.text import Hasher

    texts = ["ab$ CD 12", "a a a b", "a b\nc\n\na b\na b " + "z" * 25, "", None, "é" * 10, "X" * 3_000_000, "$ " * 1_200_000]
    got = quality_rules.rule_values(pa.array(texts), Hasher())
    for t, v in zip(texts, got.tolist()):
        raw, w = (t or "").encode(), split(t)
        ink = max(1, sum(b not in b" \t\n\r\v\f" for b in raw))
        want = [sum(b in quality_rules.SYMBOLS for b in raw) * 10_000 // ink, sum(65 <= b <= 90 for b in raw) * 10_000 // ink, sum(a == b for a, b in zip(w, w[1:])) * 10_000 // max(1, len(w)), sum(48 <= b <= 57 for b in raw) * 10_000 // ink]
        rows = [x for x in (t or "").split("\n") if split(x)]
        want += [(len(rows) - len(set(rows))) * 10_000 // max(1, len(rows)), sum(len(x.encode()) > 24 for x in w) * 10_000 // max(1, len(w))]
        assert v == want


def test_guarantee_holds():
    """Over many draws, cutoffs reject more than alpha of the good documents in at most a delta share of them."""
    r = np.random.default_rng(4)
    alpha, delta, wrong = 0.05, 0.1, 0
    share = np.arange(101) / 5050
    for _ in range(300):
        good, bad = np.bincount(r.choice(101, 400, p=share[::-1]), minlength=101), np.bincount(r.choice(101, 100, p=share), minlength=101)
        c = quality_rules.choose_cutoff(good, bad, alpha, delta)
        wrong += c is not None and share[::-1][c + 1 :].sum() > alpha
    assert wrong <= 0.15 * 300


# 9


def brute_pairs(rows, k):
    docs = {i: split(t) for i, t in rows if i is not None and split(t)}
    df = Counter(w for x in docs.values() for w in set(x))
    idf = lambda w: math.log((1 + len(docs)) / (1 + df[w])) + 1
    vec = {i: {s: c * sum(map(idf, s)) / len(s) for s, c in Counter(tuple(x[j : j + k]) for j in range(max(1, len(x) - k + 1))).items()} for i, x in docs.items()}
    out = {}
    for a, b in combinations(sorted(vec), 2):
        common = sum(min(w, vec[b][s]) for s, w in vec[a].items() if s in vec[b])
        if common:
            out[a, b] = common / (sum(vec[a].values()) + sum(vec[b].values()) - common)
    return out, list(docs)


def test_near_duplicates(docs, empty):
    pairs, ids = brute_pairs({(r.doc_id, r.text) for r in docs.collect()}, near_dedup.K)
    root = roots([p for p, s in pairs.items() if s >= near_dedup.THRESHOLD], ids)
    size = Counter(root.values())
    want = {i: g for i, g in root.items() if size[g] > 1}
    got = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: r.group_id for r in got} == want and len(got) == len(want) >= 10
    assert all(r.kept == (r.doc_id == r.group_id) for r in got)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in docs.collect() if want.get(r.doc_id, r.doc_id) == r.doc_id)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_samples_estimate_weighted_jaccard():
    r = np.random.default_rng(0)
    hashes = r.integers(0, 2**64, 4000, dtype=np.uint64)
    a, b = np.sort(r.choice(4000, 1500, False)), np.sort(r.choice(4000, 1500, False))
    b[:900] = a[:900]
    sampler = near_dedup.Sampler(400)
    codes = np.full(1 << near_dedup.DF_BITS, int(near_dedup.IDF_STEP), np.uint16)
    words = np.concatenate([hashes[a], hashes[b]])
    key, count, edge = near_dedup.shingles(words, np.array([0, 1500, 3000]), codes, 1)
    sig = sampler.signatures(key, count, edge)
    one, two = Counter(a.tolist()), Counter(b.tolist())
    true = sum((one & two).values()) / sum((one | two).values())
    assert abs((sig[0] == sig[1]).mean() - true) < 0.08


def test_recall_of_pairs(unique):
    pairs, _ = brute_pairs([(r.doc_id, r.text) for r in unique.collect()], near_dedup.K)
    want = [p for p, s in pairs.items() if s >= near_dedup.THRESHOLD]
    group = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(unique).collect()}
    assert sum(group.get(a) is not None and group.get(a) == group.get(b) for a, b in want) >= 0.9 * len(want)


def test_recall_just_above_the_threshold(spark):
    """Lone pairs between 0.5 and 0.55: no third document links them."""
    r = random.Random(11)
    word = lambda: f"w{r.randrange(20_000)}"
    texts = []
    for _ in range(1500):
        n = r.randint(50, 90)
        a = [word() for _ in range(n)]
        same = round(n * r.uniform(0.67, 0.73))
        texts += [a, a[:same] + [word() for _ in range(n - same)]]
    df = Counter(w for x in texts for w in set(x))
    idf = lambda w: math.log((1 + len(texts)) / (1 + df[w])) + 1
    vectors = [{s: c * sum(map(idf, s)) / 2 for s, c in Counter(zip(x, x[1:])).items()} for x in texts]
    want = []
    for i in range(0, len(texts), 2):
        a, b = vectors[i : i + 2]
        common = sum(min(w, b[s]) for s, w in a.items() if s in b)
        if 0.502 <= common / (sum(a.values()) + sum(b.values()) - common) < 0.55:
            want.append(i)
    assert len(want) > 500
    rows = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    group = {x.doc_id: x.group_id for x in near_dedup.near_duplicates(rows).collect()}
    assert sum(group.get(i + 1) == i for i in want) >= 0.9 * len(want)


def joined(pairs, n):
    return roots([(min(x, y), max(x, y)) for b in pairs for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], range(n))


def test_large_band_key_is_complete():
    """All pairs of a band key that may reach the threshold are joined, directly or by the first member; also where members are held and others stream."""
    import pyarrow as pa

    r = np.random.default_rng(1)
    base = r.integers(0, 256, (3, 42), dtype=np.uint8)
    low = base[np.arange(60) % 3].copy()
    low[r.random((60, 42)) < 0.15] = 7
    ids = pa.array(np.arange(60))
    raw = pa.array([x.tobytes() for x in low], pa.binary())
    table = pa.record_batch([pa.array([5] * 60, pa.int64()), ids, raw], ["band", "node", "low"])
    root = joined(near_dedup.candidate_pairs([table.slice(0, 7), table.slice(7, 0), table.slice(7)], 0.3, 0.65), 60)
    calm = np.arange(60) >= 40
    table = pa.record_batch([pa.array([5] * 60, pa.int64()), pa.array(calm), ids, raw], ["band", "calm", "node", "low"])
    got = {(min(x, y), max(x, y)) for b in near_dedup.seeking_pairs([table.slice(0, 13), table.slice(13, 30), table.slice(43)], 0.5) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    for i, j in combinations(range(60), 2):
        if (low[i] == low[j]).mean() >= 0.5:
            assert root[i] == root[j]
            assert ((i, j) in got) == (i < 40)


def test_hot_band_keys(spark):
    """Half of all texts are alike enough to share band keys; hot keys are spread and the groups stay the same."""
    r = random.Random(3)
    word = lambda: f"w{r.randrange(4000)}"
    base = [word() for _ in range(60)]
    rows = []
    for i in range(240):
        w = list(base) if i % 2 else [word() for _ in range(60)]
        for _ in range(r.randint(0, 8)):
            w[r.randrange(60)] = word()
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, ids = brute_pairs(rows, near_dedup.K)
    root = roots([p for p, s in pairs.items() if s >= near_dedup.THRESHOLD], ids)
    size = Counter(root.values())
    want = {i: g for i, g in root.items() if size[g] > 1}
    for hot in (near_dedup.HOT, 10):
        got = {x.doc_id: x.group_id for x in near_dedup.near_duplicates(df, hot=hot).collect()}
        assert set(got) <= set(want) and sum(got.get(i) == g for i, g in want.items()) >= 0.97 * len(want) > 100


def test_repeated_ids_with_other_texts(spark):
    """A doc_id with two texts is one document: copies of either text join its group."""
    long = lambda a: " ".join(f"{a}{i}" for i in range(40))
    rows = [(1, long("a")), (1, long("b")), (2, long("b")), (3, long("a") + " end"), (4, long("c")), (5, long("d")), (5, long("d"))]
    df = spark.createDataFrame([(*x, "g", 1, 2) for x in rows], "doc_id long, text string, __gone string, node int, root int")
    got = {x.doc_id: (x.group_id, x.copy_of) for x in near_dedup.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3)}
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == [1, 1, 4, 5, 5]


# 10


def brute_mix(rows, weights, budget, temperature=mixing.TEMPERATURE):
    import hashlib

    rows = [(i, s or "", len(split(t))) for i, t, s in rows if split(t)]
    totals = Counter()
    for _, s, n in rows:
        totals[s] += n
    share = {s: weights.get(s, 0) if weights else t**temperature for s, t in totals.items()}
    total = budget if budget is not None else sum(totals.values())
    out = Counter()
    for s in totals:
        if not share[s]:
            continue
        whole, rest = divmod(int(total * share[s] / sum(share.values())), totals[s])
        own = defaultdict(list)
        for i, x, n in rows:
            if x == s:
                out.update((i, s, n, e, -1, n) for e in range(whole))
                own[hashlib.md5(f"mix:{whole}:{s}:{'' if i is None else i}".encode()).hexdigest()].append((i, n))
        seen = 0
        for k in sorted(own):
            if seen < rest:
                out.update((i, s, n, whole, seen, min(n, rest - seen)) for i, n in own[k])
            seen += sum(n for _, n in own[k])
    return out


@pytest.mark.parametrize("options", [{}, {"budget": 100}, {"budget": 200_000, "weights": {"s0": 3, "s1": 1, "": 0.5, "none": 9}}, {"budget": 0}])
def test_mixing(docs, options):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want = brute_mix(rows, options.get("weights"), options.get("budget"))
    assert Counter(tuple(r) for r in mixing.mix_report(docs, **options).collect()) == want
    used = mixing.mix_documents(docs, **options)
    assert used.columns == docs.columns
    by_doc = Counter()
    for (i, *_), n in want.items():
        by_doc[i] += n
    assert Counter(r.doc_id for r in used.collect()) == by_doc


def test_mixing_spends_the_budget(unique):
    rows = mixing.mix_report(unique, budget=77_777, weights={"s0": 1, "s1": 2, "s2": 3, "": 4}).collect()
    spent = Counter()
    for r in rows:
        spent[r.source] += r.take_tokens
    assert spent == {s: int(77_777 * w / 10) for s, w in (("s0", 1), ("s1", 2), ("s2", 3), ("", 4))}


@pytest.mark.parametrize("weights", [{"s0": 1, "s1": 2, "s2": 3, "": 4}, {"s1": 1}])
def test_mixed_documents_spend_the_budget(unique, weights):
    """The stage's own texts add up to the budget; all but the last of each source are whole."""
    texts, spent, cut = {r.doc_id: r.text for r in unique.collect()}, Counter(), Counter()
    for r in mixing.mix_documents(unique, budget=77_777, weights=weights).collect():
        spent[r.source or ""] += len(split(r.text))
        if r.text != texts[r.doc_id]:
            cut[r.source or ""] += 1
            assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert spent == {s: int(77_777 * w / sum(weights.values())) for s, w in weights.items()}
    assert cut and max(cut.values()) == 1


def test_first_words(spark):
    texts = ["a b c", " \n a\t\tb  c d\n", "a", "a b ", "é\x0bü\x0cñ ö", "w " * 30_000]
    for n in (1, 2, 3):
        got = spark.createDataFrame([(i, t, n) for i, t in enumerate(texts)], "i int, text string, n long").withColumn("out", mixing.first_words(F.col("text"), F.col("n"))).collect()
        for r in got:
            words = r.text.split()
            assert r.out.split() == words[:n] and r.text.startswith(r.out)
            assert r.out == r.text if len(words) <= n else not r.out[-1].isspace()


def test_mixing_names(unique):
    """Columns named like internal ones come through unchanged."""
    odd = unique.select("doc_id", "text", "source", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in ("__u", "__w", "__s", "__k", "__key", "__cut", "__epoch", "whole", "rest")])
    got = mixing.mix_documents(odd).collect()
    assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in odd.columns[3:])


def test_mixing_empty(empty):
    assert mixing.mix_report(empty).count() == 0 and mixing.mix_documents(empty).count() == 0

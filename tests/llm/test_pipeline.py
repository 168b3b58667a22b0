"""The pipeline's stages, each against brute force on its own input."""

from collections import Counter

import pytest
from test_operators import ROWS, brute_lines, brute_mix, brute_pairs, roots, split

import __spark_entry__
import corpus_pipeline
from shardwright.llm import near_dedup, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs = [(i, t, "en", s, n) for i, t, _, s, n, *_ in ROWS]
    first = len(docs)
    docs += [(first + i, " ".join(f"{w}##" for w in f"bad text number {i} of its kind".split()), "en", "s9", 10) for i in range(60)]
    docs += [(first + 60 + i, f"calm words of page {i} and more of them {i * 7}", "en", "s8", 10) for i in range(1500)]
    labels = [(first + i, 0 if i < 60 else 1, 0) for i in range(1560)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, sf_dir)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = docs.collect()
        ids = Counter(r.doc_id for r in after)
        if name == "quality_rules":
            bad = {r.doc_id for r in before if (r.text or "").startswith("bad## ")}
            assert len(bad) == 60 and ids == Counter(r.doc_id for r in before if r.doc_id not in bad)
        elif name == "line_dedup":
            want = {d: t for d, t in brute_lines([(r.doc_id, r.text) for r in before])}
            had = {r.doc_id: r.text for r in before}
            want = {d: t for d, t in want.items() if t is None or split(t) or t == had[d]}
            assert {r.doc_id: r.text for r in after} == want
        elif name == "near_dedup":
            pairs, known = brute_pairs([(r.doc_id, r.text) for r in before], near_dedup.K)
            root = roots([p for p, s in pairs.items() if s >= near_dedup.THRESHOLD], known)
            assert ids == Counter(r.doc_id for r in before if root.get(r.doc_id, r.doc_id) == r.doc_id)
        elif name == "mixing":
            want = Counter()
            for (d, *_), n in brute_mix([(r.doc_id, r.text, r.source) for r in before], None, None).items():
                want[d] += n
            assert ids == want
        else:
            assert Counter((r.doc_id, r.n_tokens) for r in after) == Counter((r.doc_id, len(split(r.text))) for r in before)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, after))


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert quality_rules.ALPHA <= 0.05

"""The pipeline against its stages done one by one in plain Python, and its contract."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import decontaminate, language_id, near_dedup, pii
from tests.llm.test_dedup import components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "pack"]
    known = language_id.keep_known(spark, docs)
    assert known.columns == names
    texts = [(r.doc_id, r.text) for r in known.collect()]
    assert 0.97 * docs.count() < len(texts) <= docs.count()
    one = near_dedup.keep_one(spark, known)
    want = components(texts, 5, 0.8)
    left = sorted(r.doc_id for r in one.collect())
    assert one.columns == names and left == sorted(i for i, _ in texts if want.get(i, i) == i)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    held = {r.doc_id for r in decontaminate.leaks(one, bench).collect()}
    items = [" ".join(r.text.split()) for r in bench.collect()]
    plain = {i for i, t in texts if i in left and any(x in " ".join(t.split()) for x in items)}
    assert plain <= held
    clean = corpus_pipeline.decontamination(spark, one, SF)
    assert clean.columns == names and {r.doc_id for r in clean.collect()} == set(left) - held
    safe = {r.doc_id: r for r in corpus_pipeline.personal_data(spark, clean, SF).collect()}
    for i, t in texts:
        if i in safe:
            assert not pii.pattern_spans(safe[i].text) and safe[i].n_chars == len(safe[i].text)
            assert safe[i].text == t or re.search("<(EMAIL|IP|CARD|PHONE|SECRET)>", safe[i].text)
    pieces = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(safe)


def test_stages_with_odd_rows(spark, docs):
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
    assert 0 < out.count() < docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, out, SF).count() >= out.count()


@pytest.mark.parametrize("stage", range(5))
def test_stages_with_nothing(spark, stage):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, none, SF).collect() == []

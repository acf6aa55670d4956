"""Labelled samples where short texts, or labels, are missing."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from coppice.llm import langid, quality, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _prose(rng, n, words="the of and to in on at by an it is was for with from".split()):
    return " ".join(rng.choice(words) for _ in range(n))


def _write(spark, folder, texts, labels):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("labels", [[], [(999, 1, 1), (998, 0, 0)], [(i, 0, 1) for i in range(30)]])
def test_no_document_is_toxic_without_examples_of_both_classes(spark, tmp_path, labels):
    rng = random.Random(3)
    docs = _write(spark, str(tmp_path), [_prose(rng, 40) for _ in range(30)] + [None], labels)
    with pytest.warns(UserWarning, match="both classes"):
        kept = corpus_pipeline.toxic_out(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == 31
    assert {r.predicted for r in queries.op9_subword_toxicity(spark, str(tmp_path)).collect()} == {0}


def test_toxicity_is_learnt_from_long_texts_if_there_are_no_others(spark, tmp_path):
    rng = random.Random(4)
    long = [_prose(rng, 9000) for _ in range(24)]
    long = [t + " blargh" * 200 if i % 2 else t for i, t in enumerate(long)]
    assert min(map(len, long)) > toxicity.TRAIN_CHARS
    clean, bad = _prose(rng, 50), _prose(rng, 20) + " blargh blargh " + _prose(rng, 20) + " blargh"
    docs = _write(spark, str(tmp_path), [*long, clean, bad], [(i, 1, i % 2) for i in range(24)])
    kept = {r.doc_id for r in corpus_pipeline.toxic_out(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert 24 in kept and 25 not in kept and len(kept) == 13


def test_a_language_of_long_documents_only_is_learnt(spark):
    rng = random.Random(6)
    words = {"xx": "alba corva denta mirla".split(), "yy": "zukt proff wexx knup".split()}
    data = [(i, _prose(rng, 40 if i % 2 else 8000, words["xx" if i % 2 else "yy"]), "xx" if i % 2 else "yy") for i in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    filters = langid.learn(df, F.lit(True))
    assert filters.languages == ["xx", "yy"]
    assert all(r.lang_pred == r.lang for r in langid.identify(df, filters, ["lang"]).collect())


@pytest.mark.parametrize("lines, words", [(200, 25), (40, 300)])
def test_lines_are_learnt_from_long_documents_if_there_are_no_others(spark, lines, words):
    rng = random.Random(12)
    prose = lambda n: "\n".join(_prose(rng, words) + "." for _ in range(n))
    junk = lambda n: "\n".join(" ".join(w + "%%%" for w in _prose(rng, words).split()) for _ in range(n))
    data = [(i, prose(lines) if i % 2 else junk(lines)) for i in range(20)] + [(20, junk(8)), (21, prose(8))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    share = {r.doc_id: r.content_share for r in quality.judge(df, quality.learn(df, labels)).collect()}
    assert share[20] < 0.5 <= share[21]

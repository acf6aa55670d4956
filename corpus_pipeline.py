"""A corpus made ready for training: toxic, doubled and leaked documents go, personal data is covered, the rest packed."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm import decontaminate, packing, pii, simhash, toxicity
from coppice.llm.common import doc_remainder, documents, fresh, stage, table
from coppice.llm.queries import END_ID, MAX_TOKENS, tokenizer_path


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the model learns as in ``op9``, from the labels of ``docs``.

    Without examples of both classes nothing is known of any document, and all stay.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), doc_remainder("doc_id", 5) != 0)
    if not model.trained:
        warnings.warn("no labelled examples of both classes: no document is taken for toxic", stacklevel=2)
        return docs
    score, columns = fresh(docs, "score"), docs.columns
    scored = toxicity.toxic_scores(docs, model, columns, name=score)
    return scored.filter(F.col(score) < 0.5).select(columns)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that chains of near-equal fingerprints connect, that with the smallest id.

    Fingerprints are those of ``op4``: runs of three words, two bits of 64 may differ.
    """
    return simhash.keep_one(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of tokens."""
    return packing.pack(docs, tokenizer_path(), MAX_TOKENS, END_ID)


STAGES = [
    ("toxicity", toxic_out),
    ("SimHash near-dedup", near_duplicates_out),
    ("benchmark decontamination", benchmark_out),
    ("personal data", personal_data_out),
    ("best-fit packing", packed),
]

#: Models, hashes and tokenizers are beyond SQL; a test holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = documents(spark, sf_dir)
    for name, stage_function in STAGES[:-1]:
        docs = stage(stage_function(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

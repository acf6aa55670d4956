"""Bounded samples of labelled documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, max_chars: int,
    allowed: Column | None = None, usable: Callable[[Column], Column] | None = None,
    id_col: str = "doc_id", text_col: str = "text", long_chars: int | None = None, long_total: int | None = None,
) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``per_class`` labelled documents of each class, chosen by a hash of the id.

    Texts of up to ``max_chars`` characters that are ``usable`` come first. If a class has too few of them it is filled up from its
    other texts, the shortest first, each by its first ``long_chars`` characters (``max_chars``), until these come to
    ``long_total`` (no bound); one is taken in any case. So a class that occurs is never without an example. An id with
    two labels is no example of either; an id that many rows share gives one of its texts. Only ids, labels and
    lengths are ordered; the texts of the chosen ids are fetched afterwards.
    """
    long_chars = long_chars or max_chars
    wanted = (labels if allowed is None else labels.filter(allowed)).filter(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")
    ).dropna()
    wanted = wanted.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high")).filter("label = high")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    short = F.length("text") <= max_chars
    if usable is not None:
        short = short & usable(F.col("text"))
    texts = texts.withColumn("short", short)
    sizes = texts.select("id", "short", F.length("text").alias("size"))
    known = wanted.select("id", "label").join(sizes, "id").groupBy("id", "label").agg(
        F.max("short").alias("short"), F.min("size").alias("size")
    )
    chosen = []
    for label in (0, 1):
        own = known.filter(F.col("label") == label)
        found = own.filter("short").orderBy(F.xxhash64("id"), "id").limit(per_class).collect()
        total = 0
        if len(found) < per_class:
            for r in own.filter("not short").orderBy("size", F.xxhash64("id"), "id").limit(per_class - len(found)).collect():
                total += min(r["size"], long_chars)
                if found and long_total is not None and total > long_total:
                    break
                found.append(r)
        chosen += found
    if not chosen:
        return [], []
    ids = docs.sparkSession.createDataFrame([(r.id, r.label) for r in chosen], known.select("id", "label").schema)
    begun = F.coalesce(F.min(F.when(F.col("short"), F.col("text"))), F.min(F.substring("text", 1, long_chars)))
    rows = texts.join(F.broadcast(ids), "id").groupBy("id", "label").agg(begun.alias("text"))
    rows = rows.orderBy("id").collect()
    return [r.text for r in rows], [r.label for r in rows]

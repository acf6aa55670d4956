"""Storing fitted replicates and loading them for later scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.operators.encode import CategoryEncoder
from coppice.operators.forest import BaggedForest, ModelTable
from coppice.operators.trees import Trees, collected, flatten, tree_scores


def save_forests(spark: SparkSession, forests: Sequence[BaggedForest], path: str) -> None:
    """Write every bag below ``path/iteration=<n>/bag=<b>`` and an index of replicates."""
    for forest in forests:
        for b, model in enumerate(forest.bags):
            model.write().overwrite().save(f"{path}/models/iteration={forest.replicate}/bag={b}")
    index = [(f.replicate, f.seed, len(f.bags), f.features) for f in forests]
    spark.createDataFrame(
        index, "iteration int, seed bigint, bags int, features array<string>"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def load_forests(spark: SparkSession, path: str) -> list[BaggedForest]:
    """Read what ``save_forests`` wrote. The index has one row per replicate."""
    forests = []
    for row in spark.read.parquet(f"{path}/index").orderBy("iteration").collect():
        bags = [
            RandomForestRegressionModel.load(f"{path}/models/iteration={row.iteration}/bag={b}")
            for b in range(row.bags)
        ]
        forests.append(BaggedForest(row.iteration, row.seed, list(row.features), bags))
    return forests


@dataclass(frozen=True)
class Bundle:
    """A stored ensemble: everything that scoring raw rows takes."""

    trees: Trees
    encoder: CategoryEncoder | None
    label: str
    ids: list[str]

    def score(self, rows: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
        """``model, observed, predicted`` and the columns ``kept``, as they were, of every raw row in every replicate."""
        own = {c: f"__keep_{c}" for c in dict.fromkeys(kept)}
        coded = rows.withColumns({n: F.col(c) for c, n in own.items()})
        if self.encoder:
            coded = self.encoder.transform(coded)
        scored = tree_scores(self.trees, coded, self.label, list(own.values()), iteration="model")
        return scored.select("model", "observed", "predicted", *[F.col(n).alias(c) for c, n in own.items()])


def save_bundle(table: ModelTable, forests: Sequence[BaggedForest], path: str) -> None:
    """Write an ensemble below ``path``: ``nodes`` by replicate, ``levels`` of its categories, and ``index`` with seeds and roles.

    As many jobs for any number of replicates and trees. Parquet throughout.
    """
    spark, flat = table.df.sparkSession, flatten(forests)
    nodes = spark.createDataFrame(flat.to_arrow())
    nodes.repartition("iteration").write.mode("overwrite").partitionBy("iteration").parquet(f"{path}/nodes")
    empty = spark.createDataFrame([], "column string, level string, code bigint")
    levels = table.encoder.levels.select("column", "level", "code") if table.encoder else empty
    levels.write.mode("overwrite").parquet(f"{path}/levels")
    counts = table.encoder.counts if table.encoder else None
    index = [(r, s, table.label, flat.features, table.ids, counts) for r, s in zip(flat.replicates, flat.seeds, strict=True)]
    kinds = "iteration int, seed bigint, label string, features array<string>, ids array<string>, counts map<string, int>"
    spark.createDataFrame(index, kinds).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """Read what ``save_bundle`` wrote; the nodes come to the driver, from where they were written."""
    index = spark.read.parquet(f"{path}/index").orderBy("iteration").collect()
    nodes = spark.read.parquet(f"{path}/nodes")
    trees = collected(spark, nodes, {r.iteration: r.seed for r in index}, list(index[0].features))
    counts = index[0].counts
    encoder = None if counts is None else CategoryEncoder(spark.read.parquet(f"{path}/levels"), dict(counts))
    return Bundle(trees, encoder, index[0].label, list(index[0].ids))

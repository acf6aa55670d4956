"""Replicated bagged forests with out-of-bag scoring.

MLlib grows the trees but keeps no record of which rows a tree has seen. A replicate is
therefore a set of bags: each bag is one MLlib forest fitted on rows weighted by a
bootstrap multiplicity that is a pure function of row id, seed, replicate and bag. The
weights need no storage: any later pass recomputes them and knows the out-of-bag rows.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.functions import bag_weight, out_of_bag, safe_ratio
from coppice.operators.encode import CategoryEncoder, LevelEncoder
from coppice.operators.evaluate import fit_metrics
from coppice.operators.explain import Scorer, block_count, require_row_ids, with_permuted
from coppice.operators.trees import flatten, hash_seed, scaled_importance, tree_importance, tree_scores
from coppice.session import stage

_FEATURES = "__features"
_MAX_DEPTH = 30
MODELS_PER_PASS = 10


@dataclass(frozen=True)
class ForestSpec:
    """Settings of a replicate.

    ``mtry`` features are tried per split (default: the square root of their number),
    ``min_node`` is the smallest node that may be split, ``bags`` how many separately
    bootstrapped groups the trees are dealt to. MLlib limits depth and bins split points.
    """

    trees: int = 500
    mtry: int | None = None
    min_node: int = 5
    bags: int = 20
    max_depth: int = 10
    max_bins: int = 128
    seed: int = 0
    memory_mb: int = 256

    def bag_sizes(self) -> list[int]:
        """Trees per bag; never an empty bag."""
        bags = max(1, min(self.bags, self.trees))
        return [self.trees // bags + (b < self.trees % bags) for b in range(bags)]

    def estimator(self, n_features: int, trees: int, seed: int) -> RandomForestRegressor:
        """MLlib estimator for ``trees`` trees.

        ``mtry`` is clamped to the features at hand and passed as an integer text: MLlib
        reads "1.0" as all features. MLlib bounds the children of a split, not the node, so
        half of ``min_node`` is the nearest bound that never splits a smaller node.
        """
        mtry = self.mtry or max(1, math.isqrt(n_features))
        if mtry > n_features:
            warnings.warn(f"mtry {mtry} is more than the {n_features} features; all are tried", stacklevel=2)
        if self.max_depth > _MAX_DEPTH:
            raise ValueError(f"trees can be {_MAX_DEPTH} deep at most, not {self.max_depth}")
        return RandomForestRegressor(
            featuresCol=_FEATURES,
            numTrees=trees,
            featureSubsetStrategy=str(min(max(int(mtry), 1), n_features)),
            minInstancesPerNode=max(1, math.ceil(self.min_node / 2)),
            maxDepth=self.max_depth,
            maxBins=self.max_bins,
            maxMemoryInMB=self.memory_mb,
            seed=seed,
        )


@dataclass(frozen=True)
class ModelTable:
    """Staged numeric table ready for fitting, and the roles of its columns."""

    df: DataFrame
    label: str
    features: list[str]
    ids: list[str]
    encoder: CategoryEncoder | None = None
    carried: list[str] = field(default_factory=list)

    @property
    def levels(self) -> dict[str, int]:
        """Number of levels of each encoded feature."""
        return self.encoder.counts if self.encoder else {}


def prepare(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    ids: Sequence[str] = (),
    categorical: Sequence[str] = (),
    carried: Sequence[str] = (),
    cluster_by: str | None = None,
) -> ModelTable:
    """Select by role, encode categories, cast to double, and stage.

    ``ids`` identify a row and are never predictors unless also listed as features;
    ``carried`` columns only travel along. An id that is a feature too is kept in its
    original form under ``__id_<name>``. Without ids the rows are numbered as they are
    staged: the numbers are stored, hence stable for all later passes, but a new call may
    number the rows differently. ``cluster_by`` names an id or carried column that later
    passes filter on: its values are kept together inside each file, so that such a pass
    skips the pages of other values.
    """
    features, carried = list(features), list(carried)
    missing = [c for c in [label, *features, *ids, *carried] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")
    id_names = {c: f"__id_{c}" if c in features else c for c in ids}
    kept = {c: f"__as_{c}" if c in features else c for c in carried}
    chosen = df.select(
        *dict.fromkeys([label, *features]),
        *[F.col(c).alias(n) for c, n in id_names.items()],
        *[F.col(c).alias(n) for c, n in kept.items() if n not in id_names.values()],
    )
    encoder, coded = None, chosen
    if categorical:
        # learning the levels and coding are two passes: do not build the table twice
        chosen = stage(chosen, "uncoded", spread=True)
        encoder = CategoryEncoder.fit(chosen, list(categorical))
        coded = encoder.transform(chosen)
    numeric = coded.withColumns({c: F.col(c).cast("double") for c in [label, *features]})
    if not ids:
        numeric = numeric.withColumn("__row", F.monotonically_increasing_id())
        id_names = {"__row": "__row"}
    if cluster_by:
        numeric = numeric.sortWithinPartitions({**id_names, **kept}[cluster_by])
    staged = stage(numeric, "model-table", spread=cluster_by is None)
    row_ids = list(id_names.values())
    require_row_ids(staged, row_ids)
    return ModelTable(staged, label, features, row_ids, encoder, list(kept.values()))


def workflow(table: ModelTable, spec: ForestSpec) -> Pipeline:
    """Assembler and plain (bootstrapped) forest as one MLlib pipeline."""
    assembler = VectorAssembler(inputCols=table.features, outputCol=_FEATURES)
    forest = spec.estimator(len(table.features), spec.trees, spec.seed)
    forest = forest.setLabelCol(table.label).setBootstrap(True)
    return Pipeline(stages=[assembler, forest])


def raw_workflow(label: str, features: Sequence[str], categorical: Sequence[str], spec: ForestSpec) -> Pipeline:
    """Level codes, assembler and plain forest as one pipeline over raw rows; saved and loaded as a whole.

    Fitted, it takes rows with the original categories, unseen ones included. Numbers may be of any numeric type;
    rows with a missing feature are left out.
    """
    coder = [LevelEncoder(inputCols=list(categorical))] if categorical else []
    assembler = VectorAssembler(inputCols=list(features), outputCol=_FEATURES, handleInvalid="skip")
    forest = spec.estimator(len(features), spec.trees, spec.seed).setLabelCol(label).setBootstrap(True)
    return Pipeline(stages=[*coder, assembler, forest])


@dataclass(frozen=True)
class BaggedForest:
    """One fitted replicate."""

    replicate: int
    seed: int
    features: list[str]
    bags: list[RandomForestRegressionModel]

    def __post_init__(self) -> None:
        for b, model in enumerate(self.bags):
            model.setFeaturesCol(_FEATURES).setPredictionCol(self._raw(b))

    def _raw(self, bag: int) -> str:
        return f"__bag{bag}"

    def weight(self, ids: list[str], bag: int) -> Column:
        """Bootstrap multiplicity of a row in a bag of this replicate."""
        return _weight(ids, self.seed, self.replicate, bag)

    def unseen(self, ids: list[str], bag: int) -> Column:
        """True for rows a bag of this replicate was not fitted on."""
        return out_of_bag(ids, bag, hash_seed(self.seed, self.replicate))

    def raw_scores(self, df: DataFrame) -> DataFrame:
        """Add the prediction of every bag in one narrow pass over the rows."""
        absent = [f for f in self.features if f not in df.columns]
        if absent:
            raise ValueError(f"the model needs columns the table lacks: {absent}")
        assembler = VectorAssembler(inputCols=self.features, outputCol=_FEATURES)
        scored = reduce(lambda d, m: m.transform(d), self.bags, assembler.transform(df))
        return scored.drop(_FEATURES)

    def combined(self) -> Column:
        """Mean over all trees, from the bag predictions."""
        total = sum(m.getNumTrees for m in self.bags)
        parts = [F.col(self._raw(b)) * m.getNumTrees for b, m in enumerate(self.bags)]
        return reduce(lambda a, b: a + b, parts) / F.lit(float(total))

    def combined_out_of_bag(self, ids: list[str]) -> Column:
        """Mean over the trees that have not seen the row; null if all have."""
        outs = [(self.unseen(ids, b), b, m.getNumTrees) for b, m in enumerate(self.bags)]
        tops = [F.when(out, F.col(self._raw(b)) * n).otherwise(F.lit(0.0)) for out, b, n in outs]
        lows = [F.when(out, F.lit(float(n))).otherwise(F.lit(0.0)) for out, _, n in outs]
        return safe_ratio(reduce(lambda a, b: a + b, tops), reduce(lambda a, b: a + b, lows))

    def scorer(self) -> Scorer:
        """Scorer adding ``prediction``."""

        def score(df: DataFrame) -> DataFrame:
            raw = [self._raw(b) for b in range(len(self.bags))]
            return self.raw_scores(df).withColumn("prediction", self.combined()).drop(*raw)

        return score


def _weight(ids: list[str], seed: int, replicate: int, bag: int) -> Column:
    return bag_weight(ids, bag, hash_seed(seed, replicate))


def run_all(spark: SparkSession, jobs: Iterable[Callable], parallelism: int) -> list:
    """Run independent Spark jobs from a bounded pool of driver threads, in order."""
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(lambda job: inherit(job)(), list(jobs)))


def fit_replicates(
    table: ModelTable,
    spec: ForestSpec,
    replicates: Sequence[int] = range(1, 51),
    parallelism: int = 4,
) -> list[BaggedForest]:
    """Fit one bagged forest per replicate number.

    Every (replicate, bag) is an independent job over the same staged table. Rows of weight
    zero are filtered out rather than only weighted, since MLlib counts them towards its
    node sizes.
    """
    sizes = spec.bag_sizes()
    assembler = VectorAssembler(inputCols=table.features, outputCol=_FEATURES)

    def job(replicate: int, bag: int):
        def fit() -> RandomForestRegressionModel:
            weight = _weight(table.ids, spec.seed, replicate, bag).cast("double")
            absent = out_of_bag(table.ids, bag, hash_seed(spec.seed, replicate))
            rows = table.df.where(~absent).select(*table.features, table.label, weight.alias("__w"))
            estimator = spec.estimator(
                len(table.features), sizes[bag], hash_seed(spec.seed, replicate) * 1_009 + bag
            )
            # the bag is the bootstrap; its trees differ by their feature subsets
            estimator = estimator.setLabelCol(table.label).setWeightCol("__w").setBootstrap(False)
            return estimator.fit(assembler.transform(rows).select(_FEATURES, table.label, "__w"))

        return fit

    jobs = [job(r, b) for r in replicates for b in range(len(sizes))]
    models = run_all(table.df.sparkSession, jobs, parallelism)
    return [
        BaggedForest(r, spec.seed, table.features, models[i * len(sizes) : (i + 1) * len(sizes)])
        for i, r in enumerate(replicates)
    ]


def oob_predictions(
    forests: Sequence[BaggedForest], table: ModelTable, carried: Sequence[str] = ()
) -> DataFrame:
    """Out-of-bag prediction of every row in every replicate, long by ``iteration``.

    All replicates are scored in one pass over the rows, as far as their nodes fit (``trees.PASS_BYTES``).
    """
    return tree_scores(flatten(forests), table.df, table.label, [*table.ids, *carried], table.ids)


def replicate_metrics(oob: DataFrame, by: str = "iteration") -> DataFrame:
    """Out-of-bag R2, MSE and RMSE per replicate; rows that were never out-of-bag drop out."""
    return fit_metrics(oob, [by]).select(by, "r2_oob", "mse", "rmse")


def forest_importance(
    forests: Sequence[BaggedForest], table: ModelTable, blocks: int | None = None, seed: int = 0
) -> DataFrame:
    """Scaled permutation importance of every feature in every replicate.

    The repeats are the bags of a replicate, each judged on its own out-of-bag rows. The
    permuted columns serve all replicates and are staged once; all replicates are then scored in one
    pass over them, as far as their nodes fit (``trees.PASS_BYTES``).
    """
    blocks = blocks or block_count(table.df, table.ids)
    needed = table.df.select(*table.ids, *table.features, table.label)
    permuted = stage(
        with_permuted(needed, table.ids, table.features, blocks, seed).drop("__block"),
        "permuted",
        spread=True,
    )
    deltas = tree_importance(flatten(forests), permuted, table.ids, table.label)
    return scaled_importance(deltas)


def score_models(
    scorers: dict[int, Scorer],
    df: DataFrame,
    response: str,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Predictions of several stored models on a new table, long by ``model``.

    Up to ``MODELS_PER_PASS`` models score in one pass over the rows, which are then
    expanded by model; more models would make the plan unwieldy and take further passes.
    """
    keys, parts = list(scorers), []
    for start in range(0, len(keys), MODELS_PER_PASS):
        names = {k: f"__m{k}" for k in keys[start : start + MODELS_PER_PASS]}
        scored = df
        for key, name in names.items():
            scored = scorers[key](scored).withColumnRenamed("prediction", name)
        entries = F.array(
            *[
                F.struct(F.lit(int(k)).alias("model"), F.col(n).alias("predicted"))
                for k, n in names.items()
            ]
        )
        parts.append(
            scored.select(
                *carried, F.col(response).alias("observed"), F.explode(entries).alias("__e")
            ).select("__e.model", "observed", "__e.predicted", *carried)
        )
    return reduce(DataFrame.unionByName, parts)


def fit_per_group(
    df: DataFrame,
    group: str,
    label: str,
    features: Sequence[str],
    ids: Sequence[str],
    spec: ForestSpec,
    categorical: Sequence[str] = (),
    carried: Sequence[str] = (),
    parallelism: int = 4,
    max_groups: int = 1_000,
) -> dict[object, tuple[ModelTable, BaggedForest]]:
    """One forest per value of ``group`` (a replicate number, so few values), null included.

    The groups are fitted as separate distributed jobs over one encoded, staged table; no
    group is ever brought to a single task, however unequal their sizes. ``ids`` need to
    identify a row within its group only. A forest is numbered by its key if all keys are whole numbers of 32 bits, else in the order of
    keys from 1. More than ``max_groups`` keys are refused before anything is fitted.
    """
    row_ids = [group, *ids] if ids else []
    others = [*carried] if ids else [group, *carried]
    table = prepare(df, label, features, row_ids, categorical, others, cluster_by=group)
    column = table.ids[0] if ids else table.carried[0]
    keys = [r[0] for r in table.df.select(column).distinct().limit(max_groups + 1).collect()]
    if len(keys) > max_groups:
        raise ValueError(f"{group} has more than {max_groups} values: each is a model of its own, so say so by max_groups")
    keys.sort(key=lambda k: (k is not None, k))
    tables = {k: replace(table, df=table.df.where(F.col(column).eqNullSafe(F.lit(k)))) for k in keys}
    whole = all(isinstance(k, int) and not isinstance(k, bool) and abs(k) < 2**31 for k in keys)
    numbers = keys if whole else range(1, len(keys) + 1)
    fits = run_all(
        df.sparkSession,
        [lambda t=t, i=i: fit_replicates(t, spec, [i], 1)[0] for i, t in zip(numbers, tables.values(), strict=True)],
        parallelism,
    )
    return {k: (t, f) for (k, t), f in zip(tables.items(), fits, strict=True)}


def group_names(fits: dict[object, tuple[ModelTable, BaggedForest]], group: str = "model") -> DataFrame:
    """``iteration, group``: the key of each numbered forest of ``fit_per_group``, as many rows as it has fitted."""
    (table, _), *_ = fits.values()
    column = next(c for c in (group, f"__id_{group}", f"__as_{group}") if c in table.df.columns)
    rows = [(forest.replicate, key) for key, (_, forest) in fits.items()]
    kind = table.df.schema[column].dataType.simpleString()
    return table.df.sparkSession.createDataFrame(rows, f"iteration int, `{group}` {kind}")


def linear_fit_per_group(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Least-squares line per group by combinable aggregates."""
    return df.groupBy(group).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def with_spec(spec: ForestSpec, **changes) -> ForestSpec:
    """Copy of a spec with some settings changed."""
    return replace(spec, **changes)

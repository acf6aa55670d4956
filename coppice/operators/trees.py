"""Fitted trees as one flat node table, and scores of all trees of many replicates in one pass over the rows.

MLlib scores a forest by a transformer of its own, so a replicate of five hundred bags would add as many columns
to a plan. Here the nodes of all trees are rows of one table: feature, threshold, left, right, value. A task
holds that table, takes its rows a batch at a time, and walks all trees over the batch together, level by level. What needs the rows
a tree has not seen recomputes the bag of each row from its id. Replicates go through in passes of bounded node tables.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from coppice.functions import safe_ratio
from coppice.session import ship_package, stage

#: Bytes of the nodes that a pass sends to the tasks (a replicate that has more is a pass of its own).
PASS_BYTES = 128 << 20
_NODE_BYTES = 32
#: Rows times trees that are walked together.
_LANES = 1 << 20
#: Bags that one digest serves; see ``functions.hashing``.
_DRAWS = 4
_UNSEEN = math.exp(-1.0)
_SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")


def hash_seed(seed: int, replicate: int) -> int:
    """Seed of the bags of a replicate."""
    return seed * 100_003 + replicate


@dataclass(frozen=True)
class Trees:
    """Trees of some replicates: nodes in a row, and of each tree its root, its bag and its replicate's place."""

    feature: np.ndarray  # -1 at a leaf
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    bag: np.ndarray
    of: np.ndarray
    #: Replicate numbers, the seeds of their bags, and the trees of each bag.
    replicates: list[int]
    seeds: list[int]
    sizes: list[list[int]]
    features: list[str]

    def used(self, tree: int) -> np.ndarray:
        """Features that a tree splits on."""
        found = self.feature[self._span(tree)]
        return np.unique(found[found >= 0])

    def _span(self, tree: int) -> slice:
        end = self.root[tree + 1] if tree + 1 < len(self.root) else len(self.feature)
        return slice(int(self.root[tree]), int(end))

    def thresholds(self, feature: int, tree: int | None = None) -> np.ndarray:
        """Distinct split points of a feature, of all trees or of one, in order."""
        span = slice(None) if tree is None else self._span(tree)
        return np.unique(self.threshold[span][self.feature[span] == feature])

    def walk(
        self, trees: np.ndarray, rows: np.ndarray, wanted: np.ndarray | None = None,
        feature: int = -1, instead: np.ndarray | None = None,
    ) -> np.ndarray:
        """Prediction of each of ``trees`` for each of ``rows`` (zero where not ``wanted``).

        ``instead`` takes the place of a ``feature``: a value for each of ``trees``, or for each row.
        """
        n = len(rows)
        at = np.repeat(self.root[trees], n)
        lanes = np.arange(len(at)) if wanted is None else np.flatnonzero(wanted)
        alive = lanes
        by_tree = instead is not None and instead.ndim == 1
        while len(alive):
            node = at[alive]
            split = self.feature[node]
            inner = split >= 0
            alive, node, split = alive[inner], node[inner], split[inner]
            row = alive % n
            x = rows[row, split]
            if feature >= 0:
                other = instead[alive // n] if by_tree else instead[row, 0]
                x = np.where(split == feature, other, x)
            at[alive] = np.where(x <= self.threshold[node], self.left[node], self.right[node])
        out = np.zeros(len(at))
        out[lanes] = self.value[at[lanes]]
        return out.reshape(len(trees), n)

    def to_arrow(self) -> pa.Table:
        """The node table: ``iteration, bag, tree, node, feature, threshold, left, right, value``; nodes count within a tree."""
        n = np.diff(np.r_[self.root, len(self.feature)])
        tree = np.repeat(np.arange(len(self.root)), n)
        first = self.root[tree]
        inner = self.feature >= 0
        number = np.arange(len(self.root)) - np.searchsorted(self.of, self.of)
        return pa.table({
            "iteration": np.array(self.replicates, np.int32)[self.of[tree]], "bag": self.bag[tree].astype(np.int32),
            "tree": number[tree].astype(np.int32), "node": (np.arange(len(tree)) - first).astype(np.int32), "feature": self.feature,
            "threshold": self.threshold, "left": np.where(inner, self.left - first, -1).astype(np.int32),
            "right": np.where(inner, self.right - first, -1).astype(np.int32), "value": self.value,
        })

    @classmethod
    def from_arrow(cls, nodes: pa.Table, seeds: dict[int, int], features: list[str]) -> Trees:
        """The trees of a node table in any order; ``seeds`` by replicate."""
        nodes = nodes.sort_by([("iteration", "ascending"), ("tree", "ascending"), ("node", "ascending")])
        c = {name: nodes.column(name).to_numpy() for name in nodes.column_names}
        root = np.flatnonzero(c["node"] == 0)
        first = np.repeat(root, np.diff(np.r_[root, len(c["node"])]))
        replicates = sorted(seeds)
        of = np.searchsorted(replicates, c["iteration"][root])
        sizes = [np.bincount(c["bag"][root][of == i]).tolist() for i in range(len(replicates))]
        inner = c["feature"] >= 0
        return cls(
            c["feature"].astype(np.int32), c["threshold"], np.where(inner, c["left"] + first, -1), np.where(inner, c["right"] + first, -1),
            c["value"], root, c["bag"][root], of, replicates, [seeds[r] for r in replicates], sizes, features,
        )


def _parsed(text: str, nodes: dict[str, list], roots: list[int]) -> None:
    """Add the nodes of a forest's description, a line for each split and leaf, parents first."""
    feature, threshold, left, right, value = (nodes[k] for k in ("feature", "threshold", "left", "right", "value"))
    open_: list[int] = []
    for line in text.splitlines():
        line = line.strip()
        split = _SPLIT.match(line)
        if split is None and not line.startswith("Predict: "):
            continue
        at = len(feature)
        if open_:
            if left[open_[-1]] < 0:
                left[open_[-1]] = at
            else:
                right[open_.pop()] = at
        else:
            roots.append(at)
        feature.append(int(split[1]) if split else -1)
        threshold.append(float(split[2]) if split else 0.0)
        value.append(0.0 if split else float(line[9:]))
        left.append(-1)
        right.append(-1)
        if split:
            open_.append(at)


def flatten(forests: Sequence) -> Trees:
    """The trees of fitted replicates (``BaggedForest``), which all use the same features."""
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots, bags, of, sizes = [], [], [], []
    for i, forest in enumerate(forests):
        if forest.features != forests[0].features:
            raise ValueError("the replicates use different features")
        sizes.append([])
        for b, model in enumerate(forest.bags):
            before = len(roots)
            _parsed(model.toDebugString, nodes, roots)
            sizes[-1].append(len(roots) - before)
            bags += [b] * sizes[-1][-1]
            of += [i] * sizes[-1][-1]
    return Trees(
        np.array(nodes["feature"], np.int32), np.array(nodes["threshold"], np.float64), np.array(nodes["left"], np.int64),
        np.array(nodes["right"], np.int64), np.array(nodes["value"], np.float64), np.array(roots, np.int64), np.array(bags, np.int64),
        np.array(of, np.int64), [f.replicate for f in forests], [hash_seed(f.seed, f.replicate) for f in forests], sizes, list(forests[0].features),
    )


def passes(trees: Trees) -> Iterator[Trees]:
    """The trees in groups of whole replicates of about ``PASS_BYTES``; each group is a pass over the rows."""
    ends = [int(np.searchsorted(trees.of, i, "right")) for i in range(len(trees.replicates))]
    node_end = [int(trees.root[e]) if e < len(trees.root) else len(trees.feature) for e in ends]
    i = 0
    while i < len(ends):
        first, begin = (ends[i - 1], node_end[i - 1]) if i else (0, 0)
        k = i + 1
        while k < len(ends) and (node_end[k] - begin) * _NODE_BYTES <= PASS_BYTES:
            k += 1
        part, own = slice(begin, node_end[k - 1]), slice(first, ends[k - 1])
        inner = trees.feature[part] >= 0
        yield Trees(
            trees.feature[part], trees.threshold[part], np.where(inner, trees.left[part] - begin, -1),
            np.where(inner, trees.right[part] - begin, -1), trees.value[part], trees.root[own] - begin, trees.bag[own],
            trees.of[own] - i, trees.replicates[i:k], trees.seeds[i:k], trees.sizes[i:k], trees.features,
        )
        i = k


def hash_prefix(ids: Sequence[str]) -> Column:
    """What the hashes of ``functions.hashing`` put before the salt."""
    return F.concat_ws(":", *[F.col(c).cast("string") for c in ids], F.lit(""))


def unseen_rows(prefixes: list[str], seed: int, bags: int) -> np.ndarray:
    """``out_of_bag`` of every bag (rows) and table row (columns), recomputed from the ids' hash prefixes."""
    blocks = -(-bags // _DRAWS)
    salts = [f"{seed}:{k}".encode() for k in range(blocks)]
    digests = bytearray()
    for prefix in prefixes:
        begun = hashlib.md5(prefix.encode(), usedforsecurity=False)
        for salt in salts:
            whole = begun.copy()
            whole.update(salt)
            digests += whole.digest()
    draws = np.frombuffer(bytes(digests), ">u4").reshape(len(prefixes), blocks * _DRAWS)[:, :bags]
    return (draws / 2.0**32 < _UNSEEN).T


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    columns = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
    return np.column_stack([c.astype(np.float64) for c in columns]) if columns else np.zeros((batch.num_rows, 0))


def _sliced(batches: Iterator[pa.RecordBatch], trees: Trees) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that the trees of a replicate fit beside them."""
    size = max(64, 4 * _LANES // max(1, max(sum(s) for s in trees.sizes)))
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _chunks(n_trees: int, n_rows: int) -> Iterator[slice]:
    step = max(1, _LANES // max(1, n_rows))
    for at in range(0, n_trees, step):
        yield slice(at, at + step)


def _run(df: DataFrame, trees: Trees, work: Callable, schema: str) -> DataFrame:
    """``work(trees, batches)`` over ``df``, the trees sent to each executor once."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(trees)
    return df.mapInArrow(lambda batches: work(shared.value, batches), schema)


def _scores(df: DataFrame, trees: Trees, label: str, kept: list[str], prefix: Column | None, label_name: str) -> DataFrame:
    """``iteration``, the columns ``kept``, the label and ``predicted`` of every row in every replicate of a pass."""
    out_of_bag = prefix is not None
    features = [f"__x{i}" for i in range(len(trees.features))]
    columns = [F.col(c).alias(f"__k{i}") for i, c in enumerate(kept)]
    columns += [F.col(label).cast("double").alias("__y"), *[F.col(f).cast("double").alias(x) for f, x in zip(trees.features, features, strict=True)]]
    source = df.select(*columns, (prefix if out_of_bag else F.lit("")).alias("__prefix"))
    kinds = [df.schema[c].dataType.simpleString() for c in kept]
    schema = ", ".join(["iteration int", *[f"__k{i} {k}" for i, k in enumerate(kinds)], "__y double", "predicted double"])
    names = ["iteration", *[f"__k{i}" for i in range(len(kept))], "__y", "predicted"]

    def work(trees: Trees, batches):
        for batch in _sliced(batches, trees):
            x, n = _matrix(batch, features), batch.num_rows
            prefixes = batch.column(batch.num_columns - 1).to_pylist() if out_of_bag else []
            for i, (replicate, seed, sizes) in enumerate(zip(trees.replicates, trees.seeds, trees.sizes, strict=True)):
                own = np.flatnonzero(trees.of == i)
                total, count = np.zeros(n), np.zeros(n)
                unseen = unseen_rows(prefixes, seed, len(sizes)) if out_of_bag else None
                for part in _chunks(len(own), n):
                    wanted = unseen[trees.bag[own[part]]] if out_of_bag else None
                    total += trees.walk(own[part], x, wanted).sum(axis=0)
                    count += wanted.sum(axis=0) if out_of_bag else len(own[part])
                known = count > 0
                predicted = pa.array(np.divide(total, count, out=np.zeros(n), where=known), mask=~known)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, replicate, np.int32)), *batch.columns[: len(kept) + 1], predicted], names=names
                )

    scored = _run(source, trees, work, schema)
    renamed = [F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)]
    return scored.select("iteration", *renamed, F.col("__y").alias(label_name), "predicted")


def tree_scores(
    trees: Trees, df: DataFrame, label: str, kept: Sequence[str] = (), ids: Sequence[str] | None = None,
    iteration: str = "iteration", observed: str = "observed",
) -> DataFrame:
    """Prediction of every row in every replicate, long by ``iteration``; with ``ids``, by the trees that have not seen the row.

    One pass over the rows for as many replicates as ``PASS_BYTES`` of nodes hold. Null where all trees have seen a row.
    """
    absent = [f for f in [*trees.features, label, *kept] if f not in df.columns]
    if absent:
        raise ValueError(f"the model needs columns the table lacks: {absent}")
    kept = list(dict.fromkeys(kept))
    prefix = None if ids is None else hash_prefix(ids)
    out = None
    for part in passes(trees):
        scored = _scores(df, part, label, kept, prefix, observed).withColumnRenamed("iteration", iteration)
        out = scored if out is None else out.unionByName(scored)
    return out


def tree_importance(trees: Trees, permuted: DataFrame, ids: Sequence[str], label: str, prefix: str = "__perm_") -> DataFrame:
    """``iteration, bag, variable, delta``: rise of each bag's out-of-bag mean squared error when a feature is permuted.

    ``permuted`` has each feature's permuted value in a column ``prefix`` + its name. A tree that never splits on a feature predicts the same,
    so only the trees that do are walked again. Each task adds up its errors; only sums other than zero are shuffled. A bag that has seen
    all rows has no rise.
    """
    names = trees.features
    features, others = [f"__x{i}" for i in range(len(names))], [f"__p{i}" for i in range(len(names))]
    source = permuted.select(
        F.col(label).cast("double").alias("__y"), *[F.col(f).cast("double").alias(x) for f, x in zip(names, features, strict=True)],
        *[F.col(prefix + f).cast("double").alias(x) for f, x in zip(names, others, strict=True)], hash_prefix(ids).alias("__prefix"),
    )
    schema = "iteration int, bag int, feature int, total double"

    def work(trees: Trees, batches):
        sums = [np.zeros((len(s), len(names) + 1)) for s in trees.sizes]  # the last column counts rows
        users = [[] for _ in names]
        for t in range(len(trees.root)):
            for j in trees.used(t).tolist():
                users[j].append(t)
        for batch in _sliced(batches, trees):
            x, p, n = _matrix(batch, features), _matrix(batch, others), batch.num_rows
            y, prefixes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(batch.num_columns - 1).to_pylist()
            for i, (replicate, seed, sizes) in enumerate(zip(trees.replicates, trees.seeds, trees.sizes, strict=True)):
                own = np.flatnonzero(trees.of == i)
                unseen = unseen_rows(prefixes, seed, len(sizes))
                base = np.concatenate([trees.walk(own[c], x, unseen[trees.bag[own[c]]]) for c in _chunks(len(own), n)])
                by_bag = np.zeros((len(sizes), n))
                np.add.at(by_bag, trees.bag[own], base)
                share = np.array(sizes, np.float64)[:, None]
                error = np.where(unseen, (by_bag / share - y) ** 2, 0.0)
                sums[i][:, -1] += unseen.sum(axis=1)
                for j in range(len(names)):
                    using = np.array([t for t in users[j] if trees.of[t] == i], np.int64)
                    if not len(using):
                        continue
                    moved = np.zeros((len(sizes), n))
                    for c in _chunks(len(using), n):
                        again = trees.walk(using[c], x, unseen[trees.bag[using[c]]], j, p[:, j : j + 1])
                        np.add.at(moved, trees.bag[using[c]], again - base[using[c] - own[0]])
                    changed = np.unique(trees.bag[using])
                    new = np.where(unseen[changed], ((by_bag[changed] + moved[changed]) / share[changed] - y) ** 2, 0.0)
                    sums[i][changed, j] += (new - error[changed]).sum(axis=1)
        for replicate, total in zip(trees.replicates, sums, strict=True):
            bag, feature = np.nonzero(total)
            if len(bag):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(bag), replicate, np.int32)), pa.array(bag.astype(np.int32)),
                        pa.array(feature.astype(np.int32)), pa.array(total[bag, feature]),
                    ],
                    names=["iteration", "bag", "feature", "total"],
                )

    parts = None
    for part in passes(trees):
        found = _run(source, part, work, schema)
        parts = found if parts is None else parts.unionByName(found)
    sums = stage(parts.groupBy("iteration", "bag", "feature").agg(F.sum("total").alias("total")), "errors")
    rows = sums.filter(F.col("feature") == len(names)).select("iteration", "bag", F.col("total").alias("n"))
    every = rows.select("*", F.posexplode(F.array(*[F.lit(f) for f in names])).alias("feature", "variable"))
    joined = every.join(sums, ["iteration", "bag", "feature"], "left")
    return joined.select("iteration", "bag", "variable", (F.coalesce("total", F.lit(0.0)) / F.col("n")).alias("delta"))


def scaled_importance(deltas: DataFrame) -> DataFrame:
    """``iteration, variable, importance, importance_z`` of the rises of all bags."""
    n = F.count("delta")
    return deltas.groupBy("iteration", "variable").agg(
        F.avg("delta").alias("importance"),
        safe_ratio(F.avg("delta"), F.stddev_samp("delta") / F.sqrt(n)).alias("importance_z"),
    )


def _with_interval(grid: DataFrame, trees: Trees) -> DataFrame:
    """Add ``interval`` to ``variable, value`` rows: how many split points of the variable are below the value."""
    cuts = {f: trees.thresholds(j) for j, f in enumerate(trees.features)}
    names = list(grid.columns)
    schema = StructType([*grid.schema.fields, StructField("interval", LongType())])

    def place(batches):
        for batch in batches:
            variable = np.array(batch.column(names.index("variable")).to_pylist(), object)
            value = batch.column(names.index("value")).to_numpy(zero_copy_only=False)
            out = np.zeros(batch.num_rows, np.int64)
            for f in set(variable.tolist()):
                own = variable == f
                out[own] = np.searchsorted(cuts[f], value[own], "left")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*names, "interval"])

    ship_package(grid.sparkSession)
    return grid.mapInArrow(place, schema)


def tree_curves(trees: Trees, df: DataFrame, grid: DataFrame) -> DataFrame:
    """Mean prediction with one variable set to each value of ``grid`` (``variable, grid_index, value``), by replicate (``model_run``).

    Between two neighbouring split points of all trees a curve is constant. Each interval that holds a grid point is evaluated once, by the
    trees that split on the variable and once for each interval of their own; the other trees' predictions are added as they are. Grid
    points then take the value of their interval by a join. One pass over the rows for all variables and replicates (see ``passes``); a task
    gives one sum for each interval.
    """
    placed = stage(_with_interval(grid, trees), "grid")
    number = {f: j for j, f in enumerate(trees.features)}
    hit: dict[int, list[int]] = {}
    for r in placed.select("variable", "interval").distinct().collect():  # at most one for each split point, and one more
        hit.setdefault(number[r.variable], []).append(r.interval)
    values = {}
    for j, found in hit.items():
        found.sort()
        cuts = np.r_[trees.thresholds(j), np.inf]
        values[j] = (np.array(found), cuts[found])
    features = [f"__x{i}" for i in range(len(trees.features))]
    source = df.select(*[F.col(f).cast("double").alias(x) for f, x in zip(trees.features, features, strict=True)])
    schema = "model_run int, feature int, interval long, total double, n long"

    def work(trees: Trees, batches):
        sums = {(i, j): np.zeros(len(v)) for i in range(len(trees.replicates)) for j, (_, v) in values.items()}
        rows = 0
        plans = {}
        for j, (_, points) in values.items():
            for i in range(len(trees.replicates)):
                lanes, lane_values, where = [], [], []
                own = np.flatnonzero(trees.of == i)
                using = [t for t in own.tolist() if (trees.feature[trees._span(t)] == j).any()]
                for t in using:
                    at = np.searchsorted(trees.thresholds(j, t), points, "left")
                    kinds, first, back = np.unique(at, return_index=True, return_inverse=True)
                    where.append(len(lanes) + back)
                    lanes += [t] * len(kinds)
                    lane_values += points[first].tolist()
                others = np.setdiff1d(own, using)
                plans[i, j] = (np.array(lanes, np.int64), np.array(lane_values), np.array(where, np.int64), others)
        for batch in _sliced(batches, trees):
            x, n = _matrix(batch, features), batch.num_rows
            rows += n
            plain = np.zeros(len(trees.root))
            for c in _chunks(len(plain), n):
                plain[c] = trees.walk(np.arange(len(plain))[c], x).sum(axis=1)
            for (i, j), (lanes, lane_values, where, others) in plans.items():
                total = np.full(len(values[j][1]), plain[others].sum())
                if len(lanes):
                    each = np.zeros(len(lanes))
                    for c in _chunks(len(lanes), n):
                        each[c] = trees.walk(lanes[c], x, None, j, lane_values[c]).sum(axis=1)
                    total += each[where].sum(axis=0)
                sums[i, j] += total
        for (i, j), total in sums.items():
            k = len(total)
            if rows and k:
                count = sum(trees.sizes[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(k, trees.replicates[i], np.int32)), pa.array(np.full(k, j, np.int32)), pa.array(values[j][0]),
                        pa.array(total / count), pa.array(np.full(k, rows, np.int64)),
                    ],
                    names=["model_run", "feature", "interval", "total", "n"],
                )

    parts = None
    for part in passes(trees):
        found = _run(source, part, work, schema)
        parts = found if parts is None else parts.unionByName(found)
    means = parts.groupBy("model_run", "feature", "interval").agg((F.sum("total") / F.sum("n")).alias("yhat"))
    names = F.array(*[F.lit(f) for f in trees.features])
    means = means.select("model_run", names[F.col("feature")].alias("variable"), "interval", "yhat")
    return placed.join(means, ["variable", "interval"]).select("variable", "grid_index", "value", "yhat", "model_run")


def collected(spark: SparkSession, nodes: DataFrame, seeds: dict[int, int], features: list[str]) -> Trees:
    """The trees of a stored node table, which is no larger than what was fitted on the driver."""
    return Trees.from_arrow(nodes.toArrow(), seeds, features)

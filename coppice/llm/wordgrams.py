"""Quality by a linear model over hashed word n-grams, trained with follow-the-regularised-leader steps.

A text is a row of tokens: runs of letters and digits, and runs of one other sign. A token that repeats the one before it, and the
first token of a line that the text had before, count as marks of repetition. Each n-gram of tokens is hashed to one of
``BUCKETS`` features; a feature's value is one plus the logarithm of its count, and the values of a text have
length one. The model is a logistic regression; its training (FTRL-Proximal) keeps two sums for each feature and gives a weight other
than zero only where these outgrow the first penalty, so that a text is scored by a short dot product.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import arrow_map, fresh, stage, utf8

#: Features, and the longest n-gram.
BUCKETS = 1 << 20
LONGEST = 2
#: Labelled documents of each class that are learnt from, and the features that all of a class may have together.
TRAIN_PER_CLASS = 3_000
TRAIN_FEATURES = 4_000_000
#: FTRL: step size, its smoothing, and the penalties on the size and the square of weights.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.01
#: Passes over the sample.
ROUNDS = 5
#: Characters that are hashed together.
BLOCK = 1 << 18
_SPACE, _SIGN, _LETTER = 0, 1, 2
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_AGAIN, _LINE_AGAIN = np.uint64(1), np.uint64(2)


@cache
def _kinds() -> np.ndarray:
    out = np.full(0x110000, _SIGN, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            out[i] = _LETTER
        elif c.isspace():
            out[i] = _SPACE
    return out


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(32))) * _K2
    return a ^ (a >> np.uint64(29))


def _blocks(text: str) -> Iterator[str]:
    """Parts of about ``BLOCK`` characters that end with a line, or with a space in a long line."""
    at = 0
    while len(text) - at > 2 * BLOCK:
        end = text.find("\n", at + BLOCK, at + 2 * BLOCK) + 1 or text.find(" ", at + BLOCK) + 1 or len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def tokens(text: str, lines: set[int], last: np.ndarray) -> np.ndarray:
    """Names of the tokens of a part of a text.

    ``lines`` are hashes of the text's lines so far, and take the new ones; ``last`` is the token before the part.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _kinds()[points]
    if not kind.any():
        return np.zeros(0, np.uint64)
    changed = (kind[1:] != kind[:-1]) | ((kind[1:] == _SIGN) & (points[1:] != points[:-1]))
    start = np.r_[True, changed] & (kind != _SPACE)
    starts = np.flatnonzero(start)
    place = np.arange(len(points)) - starts[np.maximum(np.cumsum(start) - 1, 0)]
    lettered = np.where(kind != _SPACE, _mix((points.astype(np.uint64) + _K1) * (place.astype(np.uint64) * _K1 + _K2)), 0)
    name = _mix(np.add.reduceat(lettered, starts)) | np.uint64(4)
    again = name == np.r_[last if len(last) else np.zeros(1, np.uint64), name[:-1]]
    out = np.where(again, _AGAIN, name)
    first = np.unique(np.r_[0, np.searchsorted(starts, np.flatnonzero(points == 10))])
    first = first[first < len(starts)]
    order = _mix((np.arange(len(name)) - np.repeat(first, np.diff(np.r_[first, len(name)]))).astype(np.uint64) + _K1)
    for at, line in zip(first.tolist(), np.add.reduceat(_mix(name ^ order), first).tolist(), strict=True):
        if line in lines:
            out[at] = _LINE_AGAIN
        else:
            lines.add(line)
    return out


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value) of every feature of a whole text, in the order of buckets; nothing for a text without tokens."""
    found, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    lines: set[int] = set()
    last = np.zeros(0, np.uint64)
    for part in _blocks(text):
        names = tokens(part, lines, last[-1:])
        if not len(names):
            continue
        row, grams = np.r_[last, names], [names]
        last = row[max(0, len(row) - LONGEST + 1) :]
        joined = row
        for n in range(2, LONGEST + 1):
            joined = _mix(joined[:-1] * _K1 + row[n - 1 :])
            # those that end in this part
            grams.append(joined[max(0, len(joined) - len(names)) :])
        hashed = (_mix(np.concatenate(grams)) >> np.uint64(20)) % np.uint64(BUCKETS)
        new, n = np.unique(hashed.astype(np.int64), return_counts=True)
        if len(found):
            new, where = np.unique(np.r_[found, new], return_inverse=True)
            n = np.bincount(where, np.r_[counts, n]).astype(np.int64)
        found, counts = new, n
    values = 1 + np.log(np.maximum(counts, 1))
    return found.astype(np.int32), (values / max(np.sqrt((values**2).sum()), 1e-12)).astype(np.float32)


@dataclass(frozen=True)
class QualityModel:
    """Weights of the features and the bias."""

    weights: np.ndarray
    bias: float
    #: Whether there were examples of both classes; without, every text gets the same score.
    trained: bool = True

    def score(self, text: str) -> float:
        """From 0 to 1: how likely label 1 is. A text without tokens is scored by the bias."""
        at, values = features(text)
        return _logistic(float(self.weights[at] @ values) + self.bias)


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-min(max(x, -500.0), 500.0))))


def fit(
    examples: list[tuple[np.ndarray, np.ndarray]], labels: Iterable[int], rounds: int = ROUNDS, seed: int = 5
) -> QualityModel:
    """FTRL-Proximal over the examples, one at a time, in ``rounds`` shuffled passes.

    Without examples of both classes every text gets the share of label 1 (a half if there are none).
    """
    y = np.fromiter(labels, np.int64)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))), False)
    gradient, squares = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    penalty = np.full(BUCKETS + 1, L1)
    penalty[BUCKETS] = 0.0  # the bias, which is a feature of every text
    rng = np.random.default_rng(seed)
    rows = [(np.r_[at, BUCKETS].astype(np.int64), np.r_[values, 1.0]) for at, values in examples]
    order = np.arange(len(rows))
    for _ in range(rounds):
        rng.shuffle(order)
        for k in order.tolist():
            at, values = rows[k]
            z, n = gradient[at], squares[at]
            w = -np.sign(z) * np.maximum(np.abs(z) - penalty[at], 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)
            step = (_logistic(float(w @ values)) - y[k]) * values
            more = step * step
            gradient[at] = z + step - (np.sqrt(n + more) - np.sqrt(n)) / ALPHA * w
            squares[at] = n + more
    w = -np.sign(gradient) * np.maximum(np.abs(gradient) - penalty, 0) / ((BETA + np.sqrt(squares)) / ALPHA + L2)
    return QualityModel(w[:BUCKETS].astype(np.float32), float(w[BUCKETS]))


def learn(
    docs: DataFrame, labels: DataFrame, allowed: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
) -> QualityModel:
    """The model of a bounded sample of the labelled documents whose label row is ``allowed``.

    A class gives its ``TRAIN_PER_CLASS`` documents of the smallest hashes of the id, less those beyond ``TRAIN_FEATURES``
    features in all (never the first). Texts are taken whole. Labels other than 0 and 1 count as none; an id with both is an
    example of neither; an id that several rows share gives one of its texts. Only ids and labels are ordered, and only the
    sample's features come to the driver.
    """
    names = [F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")]
    wanted = labels.filter(allowed).filter(F.col(label_col).isin(0, 1)).select(*names).dropna()
    wanted = wanted.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high")).filter("label = high")
    known = wanted.drop("high").join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    chosen = [
        r for k in (0, 1) for r in known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(TRAIN_PER_CLASS).collect()
    ]
    if not chosen:
        return fit([], [])
    ids = docs.sparkSession.createDataFrame([(r.id, r.label, i) for i, r in enumerate(chosen)], known.schema.add("nth", "integer"))
    texts = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).join(F.broadcast(ids), "id")
    texts = texts.groupBy("nth", "label").agg(F.min("text").alias("text")).select("nth", "label", "text")

    def hashed(batches):
        for batch in batches:
            found = [features(raw.as_py().decode("utf-8", "replace")) for raw in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2], pa.array([len(at) for at, _ in found], pa.int32()),
                    pa.array([at.tobytes() for at, _ in found], pa.binary()),
                    pa.array([values.tobytes() for _, values in found], pa.binary()),
                ],
                names=["nth", "label", "n", "at", "value"],
            )

    rows = stage(arrow_map(texts, hashed, "nth int, label int, n int, at binary, value binary"), "examples")
    taken, total = [], {0: 0, 1: 0}
    for r in rows.select("nth", "label", "n").orderBy("nth").collect():
        if not total[r.label] or total[r.label] + r.n <= TRAIN_FEATURES:
            taken.append(r.nth)
        total[r.label] += max(r.n, 1)
    if len(taken) < len(chosen):
        rows = rows.filter(F.col("nth").isin(taken))
    sample = rows.orderBy("nth").select("label", "at", "value").collect()
    examples = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32)) for r in sample]
    return fit(examples, [r.label for r in sample])


def quality_scores(docs: DataFrame, model: QualityModel, extra: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns ``extra`` of ``docs`` and ``name``, the score of every whole text from 0 to 1.

    Null and empty texts, and such without a token, are scored by the bias alone. A score depends on the text only, so
    repeated rows get equal scores. Other columns do not take part; an empty table gives no rows. Nothing is shuffled.
    """
    weights, bias = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias
    schema = docs.select(*extra).schema
    schema.add(name, "double")

    def score(batches):
        model = QualityModel(weights.value, bias)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            out = pa.array([model.score(raw.as_py().decode("utf-8", "replace")) for raw in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*batch.schema.names[:-1], name])

    return arrow_map(docs.select(*extra, utf8(text_col).alias(fresh(docs, "_utf8"))), score, schema)

"""Toxicity by subword bags: character n-gram vectors, averaged, into a linear softmax.

A word is the bag of its character n-grams, each hashed to a row of an embedding table; a span of
words is the mean of its words' vectors, places without a word counting as zero; a linear softmax over that mean tells the classes
apart. Table and softmax are trained together in numpy. An unseen misspelling or inflection
shares most of its n-grams with words that were seen, and so their vectors. A document is
judged by its worst span: a long text is not excused by its clean parts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import arrow_map, fresh, utf8
from coppice.llm.sampling import labelled_texts

#: Rows of the embedding table, and its width.
BUCKETS = 1 << 17
WIDTH = 8
#: Lengths of the character n-grams, with marks at both ends of a word.
SHORTEST, LONGEST = 3, 5
#: Words in a span; spans start at every half of that.
SPAN = 16
#: Labelled documents of each class that are learnt from, and characters up to which they come first.
TRAIN_PER_CLASS = 1_200
TRAIN_CHARS = 30_000
#: Where those are too few: characters of a longer one that are learnt from, and of all longer ones of a class.
LONG_CHARS = 1 << 20
LONG_TOTAL = 1 << 22
#: Rounds in which whole texts are averaged, and texts in a training batch.
WARM_ROUNDS = 3
BATCH = 64
#: Characters that are scored together.
BLOCK = 1 << 18
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _points(text: str) -> np.ndarray:
    """Code points of the lower-case text between two marks; all that is no letter or digit is a mark, 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros(len(points) + 2, np.uint64)
    np.multiply(points, _in_word()[points], out=out[1:-1], casting="unsafe")
    return out


@cache
def _in_word() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(0x110000)])


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * _K2
    return a ^ (a >> np.uint64(29))


def word_grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name of each word, bucket of each n-gram, the n-gram's word); a word said again at once is left out.

    The n-grams of a word are those of its characters between two marks, and the word as a whole.
    """
    inside = points != 0
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.cumsum(inside & ~np.r_[False, inside[:-1]]) - 1
    place = (np.arange(len(points)) - starts[np.maximum(word, 0)]).astype(np.uint64)
    lettered = np.where(inside, _mixed(points * _K1 + place * _K2), 0)
    name = np.add.reduceat(lettered, starts)
    again = np.r_[False, name[1:] == name[:-1]]
    number = np.cumsum(~again) - 1
    buckets, owners = [name[~again] % np.uint64(BUCKETS)], [np.arange(len(starts) - again.sum())]
    for n in range(SHORTEST, LONGEST + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        whole = inside[1 : m + 1].copy()
        for i in range(2, n - 1):
            whole &= inside[i : m + i]
        at = np.flatnonzero(whole)
        own = word[at + 1]
        at, own = at[~again[own]], own[~again[own]]
        gram = np.full(len(at), n, np.uint64)
        for i in range(n):
            gram = gram * _K1 + points[at + i]
        buckets.append((gram ^ (gram >> np.uint64(29))) % np.uint64(BUCKETS))
        owners.append(number[own])
    return name[~again], np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def _blocks(points: np.ndarray):
    """Parts of about ``BLOCK`` characters that begin and end at marks."""
    at = 0
    while at < len(points) - 1:
        end = min(len(points) - 1, at + BLOCK)
        while points[end]:
            end += 1
        yield points[at : end + 1]
        at = end


@dataclass(frozen=True)
class ToxicityModel:
    """What the softmax says of each n-gram: the class margin is linear in the mean of vectors."""

    margin: np.ndarray  # for each bucket, toxic minus clean
    bias: float
    #: Whether there were examples of both classes; without, the score tells no text from another.
    trained: bool = True

    def word_margins(self, text: str) -> np.ndarray:
        """The margin of each word of a text: the mean over its n-grams."""
        out, last = [], None
        for part in _blocks(_points(text)):
            name, bucket, word = word_grams(part)
            if len(name):
                margin = np.bincount(word, self.margin[bucket]) / np.bincount(word)
                out.append(margin[1:] if name[0] == last else margin)
                last = name[-1]
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, text: str) -> float:
        """From 0 to 1, by the worst span; by the bias alone if there is no word."""
        margins, worst = self.word_margins(text), 0.0
        if len(margins):
            along = np.concatenate([[0.0], np.cumsum(margins)])
            a, b = span_bounds(len(margins))
            worst = (along[b] - along[a]).max() / SPAN
        return float(1 / (1 + np.exp(-np.clip(worst + self.bias, -500, 500))))


def _worst_span(margins: np.ndarray) -> tuple[int, int]:
    """Bounds of the span with the highest mean; there is at least one word."""
    along = np.concatenate([[0.0], np.cumsum(margins)])
    a, b = span_bounds(len(margins))
    k = int(np.argmax(along[b] - along[a]))
    return int(a[k]), int(b[k])


def span_bounds(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.arange(0, max(1, n - SPAN // 2), SPAN // 2)
    return a, np.minimum(n, a + SPAN)


def fit(texts: list[str], labels: list[int], rounds: int = 6, rate: float = 1.0, seed: int = 7) -> ToxicityModel:
    """Train embeddings and softmax on whole texts and their labels, in batches with AdaGrad steps.

    The first ``WARM_ROUNDS`` average whole texts, which finds n-grams that are common in toxic texts. Later a text
    counts by its worst span so far: a toxic text as its other spans may be clean, a clean text as that span most
    needs learning. Both classes weigh the same. Without examples of both classes the model gives every text
    the share of toxic labels (a half if there are none) and says so by ``trained``.
    """
    y = np.asarray(labels, np.int64)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))), False)
    vocabulary: dict[int, int] = {}
    bags, kept, gram_count = [], [], []
    for text in texts:
        name, bucket, word = word_grams(_points(text))
        names = name.tolist()
        old = len(vocabulary)
        bags.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in names], np.int32))
        if len(vocabulary) > old:  # the n-grams of words that are new
            new, at = np.unique(bags[-1], return_index=True)
            at = at[new >= old]
            order = np.argsort(word, kind="stable")
            count = np.bincount(word, minlength=len(names))
            ends = np.cumsum(count)
            for i in at.tolist():
                kept.append(bucket[order[ends[i] - count[i] : ends[i]]].astype(np.int32))
                gram_count.append(int(count[i]))
    flat, gram_count = np.concatenate([*kept, np.zeros(0, np.int32)]), np.array(gram_count, np.int64)
    cut = np.cumsum(np.r_[0, gram_count])[:-1]
    del kept, vocabulary
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())

    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1e-2, (BUCKETS, WIDTH)).astype(np.float32)
    softmax = np.zeros((WIDTH, 2), np.float32)
    softmax[:, 1] = rng.choice([-0.5, 0.5], WIDTH)
    softmax[:, 0] = -softmax[:, 1]
    bias = np.array([1.0, -1.0], np.float32)
    squares = [np.full_like(p, 1e-10) for p in (table, softmax, bias)]
    usable = np.array([d for d, bag in enumerate(bags) if len(bag)], np.int64)
    for step in range(rounds):
        rng.shuffle(usable)
        for at in range(0, len(usable), BATCH):
            batch = usable[at : at + BATCH]
            used, word = np.unique(np.concatenate([bags[d] for d in batch]), return_inverse=True)
            n = gram_count[used]
            behind = np.cumsum(n)
            own = flat[np.repeat(cut[used] - (behind - n), n) + np.arange(behind[-1])]
            vectors = np.add.reduceat(table[own], behind - n, axis=0) / n[:, None]
            margins = (vectors @ (softmax[:, 1] - softmax[:, 0]))[word]
            ends = np.cumsum([len(bags[d]) for d in batch])
            picked, size, slots = [], [], []
            for d, end in zip(batch, ends, strict=True):
                begin = end - len(bags[d])
                a, b = (0, end - begin) if step < WARM_ROUNDS else _worst_span(margins[begin:end])
                picked.append(word[begin + a : begin + b])
                size.append(b - a)
                slots.append(max(b - a, SPAN))
            inside, size, slots = np.concatenate(picked), np.array(size), np.array(slots)
            row = np.repeat(np.arange(len(batch)), size)
            mean = np.add.reduceat(vectors[inside], np.cumsum(size) - size, axis=0) / slots[:, None]
            scores = mean @ softmax + bias
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            error = scores / scores.sum(axis=1, keepdims=True)
            error[np.arange(len(batch)), y[batch]] -= 1
            error *= weight[batch][:, None]
            back = ((error @ softmax.T) / slots[:, None])[row]
            to_word = np.stack([np.bincount(inside, back[:, k], len(used)) for k in range(WIDTH)], axis=1)
            spread = np.repeat(to_word / n[:, None], n, axis=0)
            rows, place = np.unique(own, return_inverse=True)
            to_table = np.stack([np.bincount(place, spread[:, k], len(rows)) for k in range(WIDTH)], axis=1)
            squares[0][rows] += to_table**2
            table[rows] -= rate * to_table / np.sqrt(squares[0][rows])
            for p, g, q in ((softmax, mean.T @ error, squares[1]), (bias, error.sum(axis=0), squares[2])):
                q += g * g
                p -= 0.05 * g / np.sqrt(q)
    difference = softmax[:, 1] - softmax[:, 0]
    return ToxicityModel((table @ difference).astype(np.float32), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, label_col: str = "toxic", **columns) -> ToxicityModel:
    """The model of a bounded sample of labelled documents; see ``sampling.labelled_texts``."""
    return fit(*labelled_texts(
        docs, labels, label_col, TRAIN_PER_CLASS, TRAIN_CHARS, allowed, long_chars=LONG_CHARS, long_total=LONG_TOTAL, **columns
    ))


def toxic_scores(docs: DataFrame, model: ToxicityModel, extra: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns ``extra`` of ``docs`` and ``name``, the score of every whole text from 0 to 1.

    The score of a text without words, null and empty ones included, is that of the bias alone.
    A score depends on the text only, so repeated rows get equal scores.
    """
    margin, bias = docs.sparkSession.sparkContext.broadcast(model.margin), model.bias
    schema = docs.select(*extra).schema
    schema.add(name, "double")

    def score(batches):
        model = ToxicityModel(margin.value, bias)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            out = np.array([model.score(raw.as_py().decode("utf-8", "replace")) for raw in texts], np.float64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(out)], names=[*batch.schema.names[:-1], name]
            )

    return arrow_map(docs.select(*extra, utf8(text_col).alias(fresh(docs, "_utf8"))), score, schema)

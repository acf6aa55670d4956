"""Document quality: fixed word rules, and a chain model that labels each line content or boilerplate.

A linear-chain conditional random field scores the lines of a document together: what a
line looks like, and how labels follow each other. Viterbi decoding gives the best labels, and the share of
words in content lines decides whether the document stays. The field is fitted in numpy on
labelled documents, whose label all their lines take.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import arrow_map, utf8
from coppice.llm.sampling import labelled_texts

SYMBOLS = "#*$%&|<>"
#: A document needs this many words, and at most this share of them in repeated windows.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
REPEAT_WINDOW = 3
#: Share of words in content lines from which a document is kept.
LEAST_CONTENT = 0.5
#: Labelled documents of each class that are learnt from, lines and characters up to which they come first and that are read.
TRAIN_PER_CLASS = 400
TRAIN_LINES = 120
TRAIN_CHARS = 30_000
FEATURES = 16


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    n = len(words) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) < 2_000_000:
        v = len(number)
        windows = (ids[:n] * v + ids[1 : n + 1]) * v + ids[2:]
    else:  # three numbers do not fit into one: name the pairs first
        _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        windows = pairs[:n] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order] = np.r_[False, same] | np.r_[same, False]
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + REPEAT_WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


@dataclass(frozen=True)
class Base:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED_PERCENT * self.n_words


def base_counts(raw: bytes) -> Base:
    """The word rules of the UTF-8 bytes of a text; words end at the six ASCII spaces."""
    words = raw.split()
    # code points are the bytes that do not continue one
    chars = sum(map(len, words)) - len(raw.translate(None, _NOT_CONTINUING))
    seen: set[bytes] = set()
    again = 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip(b" \t\n\r\x0b\x0c"):
            seen.add(line)
    symbols = sum(raw.count(s.encode()) for s in SYMBOLS)
    return Base(len(words), chars, symbols, again, repeated_words(words))


_NOT_CONTINUING = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)
_SYMBOL_BYTES = SYMBOLS.encode()
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in _SYMBOL_BYTES)
_NOT_DIGITS = bytes(b for b in range(256) if b not in b"0123456789")
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)


def line_features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line, words of each line)."""
    lines = raw.split(b"\n")
    x = np.zeros((len(lines), FEATURES))
    sizes = np.zeros(len(lines), np.int64)
    seen: dict[bytes, int] = {}
    for i, line in enumerate(lines):
        words = line.split()
        n, size = len(words), max(1, len(line))
        sizes[i] = n
        symbols = len(line.translate(None, _NOT_SYMBOLS))
        upper = len(line.translate(None, _NOT_UPPER))
        distinct = len(set(words))
        same = sum(a == b for a, b in zip(words, words[1:], strict=False)) if distinct < n else 0
        before = seen.get(line, 0) if n else 0
        seen[line] = before + 1
        x[i] = (
            1, n == 0, 0 < n <= 3, 3 < n <= 10, n > 10, symbols > 0, min(1, 4 * symbols / max(1, n)),
            min(1, 5 * upper / size), upper * 2 > size, line.count(b"!") * 2 > n, min(1, line.count(b"|") / max(1, n)),
            distinct / max(1, n), min(1, 2 * same / max(1, n)), before > 0,
            min(1, 10 * len(line.translate(None, _NOT_DIGITS)) / size), line.rstrip().endswith((b".", b"!", b"?")),
        )
    return x, sizes


@dataclass(frozen=True)
class LineField:
    """Weights of a line's label (1: content) and of the label after each label."""

    emission: np.ndarray  # (features, 2)
    transition: np.ndarray  # (2, 2)

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Viterbi decoding; where both labels are as good, content."""
        score = x @ self.emission
        t = self.transition.tolist()
        back: list[tuple[int, int]] = []
        a, b = score[0].tolist()
        for e0, e1 in score[1:].tolist():
            back.append((0 if a + t[0][0] > b + t[1][0] else 1, 0 if a + t[0][1] > b + t[1][1] else 1))
            a, b = max(a + t[0][0], b + t[1][0]) + e0, max(a + t[0][1], b + t[1][1]) + e1
        out = [0 if a > b else 1]
        for pointer in reversed(back):
            out.append(pointer[out[-1]])
        return np.array(out[::-1])

    def content_share(self, raw: bytes) -> float:
        """Share of words in content lines; 1 for a text without words."""
        x, sizes = line_features(raw)
        total = sizes.sum()
        return float(sizes[self.labels(x) == 1].sum() / total) if total else 1.0


def fit(texts: list[bytes], labels: list[int], rounds: int = 60, rate: float = 0.15, decay: float = 1e-3) -> LineField:
    """Maximise the likelihood of the lines' labels by gradient steps; both classes weigh the same.

    Without examples of both classes everything is content.
    """
    y = np.asarray(labels, np.int64)
    if not len(y) or y.min() == y.max():
        emission = np.zeros((FEATURES, 2))
        emission[0, 1] = 1.0
        return LineField(emission, np.zeros((2, 2)))
    found = [line_features(t)[0] for t in texts]
    longest = max(map(len, found))
    x = np.zeros((len(found), longest, FEATURES))
    on = np.zeros((len(found), longest))
    for i, f in enumerate(found):
        x[i, : len(f)], on[i, : len(f)] = f, 1
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) / on.sum(axis=1)
    gold = np.zeros((len(found), 2))
    gold[np.arange(len(y)), y] = 1
    params = [np.zeros((FEATURES, 2)), np.zeros((2, 2))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    log_sum = lambda a, axis: np.log(np.exp(a - a.max(axis=axis, keepdims=True)).sum(axis=axis)) + a.max(axis=axis)
    for step in range(1, rounds + 1):
        emission, transition = params
        score = x @ emission
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            new = log_sum(forward[:, t - 1, :, None] + transition, 1) + score[:, t]
            forward[:, t] = np.where(on[:, t, None] > 0, new, forward[:, t - 1])
        total = log_sum(forward[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            new = log_sum(transition + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(on[:, t + 1, None] > 0, new, 0)
        single = np.exp(forward + backward - total[:, None, None]) * on[..., None]
        pair = np.exp(
            forward[:, :-1, :, None] + transition + (score + backward)[:, 1:, None, :] - total[:, None, None, None]
        ) * on[:, 1:, None, None]
        g_emission = np.einsum("dtf,dtk,d->fk", x, gold[:, None, :] * on[..., None] - single, weight)
        wanted = gold[:, :, None] * gold[:, None, :] * (on.sum(axis=1) - 1)[:, None, None]
        g_transition = np.einsum("dij,d->ij", wanted - pair.sum(axis=1), weight)
        for p, g, m in zip(params, (g_emission, g_transition), moments, strict=True):
            g = g - decay * p
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return LineField(*params)


def learn(docs: DataFrame, labels: DataFrame, **columns) -> LineField:
    """The field of a bounded sample of labelled documents; see ``sampling.labelled_texts``.

    As all lines take the label, the first lines of a longer document are examples where short ones are too few.
    """
    few_lines = lambda text: F.length(text) - F.length(F.replace(text, F.lit("\n"))) < TRAIN_LINES
    texts, classes = labelled_texts(
        docs, labels, "quality", TRAIN_PER_CLASS, TRAIN_CHARS, usable=few_lines, **columns
    )
    begun = ["\n".join(t.split("\n")[:TRAIN_LINES]) for t in texts]
    return fit([t.encode("utf-8", "replace") for t in begun], classes)


def judge(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept``.

    A row for each row of ``docs``, judged by its text alone; null text counts as empty, which fails for want of words.
    Rows may share ids. Columns other than the two named do not take part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    id_type = docs.schema[id_col].dataType.simpleString()

    def rule(batches):
        model = shared.value
        for batch in batches:
            counts: list[list[int]] = [[] for _ in range(5)]
            failed, share, kept = [], [], []
            for value in batch.column(1):
                raw = value.as_py()
                base = base_counts(raw)
                for c, v in zip(
                    counts, (base.n_words, base.word_chars, base.n_symbols, base.n_dup_lines, base.n_repeat_words), strict=True
                ):
                    c.append(v)
                failed.append(base.failed)
                share.append(model.content_share(raw))
                kept.append(not base.failed and share[-1] >= LEAST_CONTENT)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *(pa.array(c, pa.int64()) for c in counts),
                    pa.array(failed, pa.bool_()), pa.array(share, pa.float64()), pa.array(kept, pa.bool_()),
                ],
                names=names,
            )

    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = ["id", *numbers, "base_failed", "content_share", "kept"]
    kinds = f"id {id_type}, " + ", ".join(f"{n} long" for n in numbers)
    kinds += ", base_failed boolean, content_share double, kept boolean"
    judged = arrow_map(docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("_utf8")), rule, kinds)
    return judged.withColumnRenamed("id", id_col)

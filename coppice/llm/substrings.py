"""Repeated passages by recompression.

A text is a string of words. Recompression renames it in rounds: runs of one word become one symbol,
then, again and again, neighbouring symbols become one symbol where the left one is in the
left and the right one in the right half of that round's alphabet. Names and halves are hashes, so they are the
same everywhere without any exchange, and equal passages get equal symbols except at their ends.

How far an end reaches is tracked for each symbol as the span of words that its existence
depends on. A window takes as its anchor the best symbol whose span lies inside it: the one of the
highest round, then the longest, then the one with the smallest hash, then the leftmost. That choice depends on the
words of the window alone, so equal windows have equal anchors, and a window whose anchor symbol
occurs once in the corpus is not repeated. Anchors that occur again are verified window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import arrow_map, fresh, stage, utf8

WINDOW = 35
#: Rounds of pair naming. More make rarer symbols, until few fit into a window.
ROUNDS = 5
#: Words that are renamed together; longer texts are cut into parts that overlap by a window.
CHUNK = 1 << 17
REMEMBERED_WORDS = 400_000
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _WordHashes(dict):
    """Hash of each word that was asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * _K2
    a = (a ^ (a >> np.uint64(29))) * _K3
    return a ^ (a >> np.uint64(32))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of two names in a row; the order counts."""
    return _mix(a * _K1 + (b ^ (b >> np.uint64(33))) * _K3)


def _step(k: int) -> np.uint64:
    """A constant of its own for each round."""
    return np.uint64(k * int(_K1) % (1 << 64))


def window_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of the window that starts at each word, for all but the last ``WINDOW - 1``."""
    width, names = 1, words
    while 2 * width <= WINDOW:
        names = _join(names[: len(names) - width], names[width:])
        width *= 2
    rest = WINDOW - width
    return _join(names[: len(names) - rest], names[rest:]) if rest else names


class _Level:
    """Symbols of a round: name, first word, length, and the span of words each depends on."""

    def __init__(self, name, start, length, low, high):
        self.name, self.start, self.length, self.low, self.high = name, start, length, low, high


def _runs(name: np.ndarray, doc: np.ndarray, first: np.ndarray, end: np.ndarray) -> _Level:
    """Name the runs of a word; a symbol depends on the words on both sides."""
    new = np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]
    at = np.flatnonzero(new)
    length = np.diff(np.r_[at, len(name)])
    named = np.where(length > 1, _join(name[at], length.astype(np.uint64)), name[at])
    owner = doc[at]
    # where a document ends, what would follow is not known: the span reaches out of it
    return _Level(named, at, length, np.maximum(at - 1, first[owner] - 1), np.minimum(at + length, end[owner]))


def _pairs(old: _Level, doc_of: np.ndarray, first: np.ndarray, end: np.ndarray, round_: int) -> _Level:
    """Name the pairs of a left and a right symbol; the others depend on the neighbour they might have joined."""
    right = (_mix(old.name + _step(round_)) >> np.uint64(40)) & np.uint64(1) == 1
    doc = doc_of[old.start]
    follows = np.r_[doc[1:] == doc[:-1], False]  # the next symbol is of the same document
    joins = follows & ~right & np.r_[right[1:], False]
    joined = np.r_[False, joins[:-1]]
    nxt = np.minimum(np.arange(len(right)) + 1, len(right) - 1)
    high_next = np.where(follows, old.high[nxt], end[doc])
    low_before = np.where(np.r_[False, follows[:-1]], np.r_[old.low[:1], old.low[:-1]], first[doc] - 1)
    name = np.where(joins, _join(old.name, old.name[nxt]), old.name)
    length = old.length + np.where(joins, old.length[nxt], 0)
    low = np.where(right, low_before, old.low)
    high = np.where(right, old.high, high_next)
    keep = ~joined
    return _Level(name[keep], old.start[keep], length[keep], low[keep], high[keep])


def _anchors(words: np.ndarray, first: np.ndarray, end: np.ndarray):
    """(window start, level, symbol) of every window within a document of the chunk."""
    n = len(words)
    doc = np.repeat(np.arange(len(first)), end - first)
    position = np.arange(n)
    ground = _Level(words, position, np.ones(n, np.int64), position, position)
    levels = [ground, _runs(words, doc, first, end)]
    for r in range(1, ROUNDS + 1):
        levels.append(_pairs(levels[-1], doc, first, end, r))
    windows = np.flatnonzero(position + WINDOW <= end[doc])
    level_of, symbol_of = np.zeros(len(windows), np.int8), np.zeros(len(windows), np.int64)
    open_ = np.arange(len(windows))
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        m = len(level.name)
        short = np.uint64(31) - np.minimum(level.length, 31).astype(np.uint64)
        rank = (short << np.uint64(59)) | (_mix(level.name) >> np.uint64(5))
        rank = (rank >> np.uint64(24) << np.uint64(24)) | np.arange(m, dtype=np.uint64)
        # how many symbols have a lower bound before s, and an upper bound up to s
        before = np.r_[0, np.cumsum(np.bincount(level.low + 1, minlength=n + 2))]
        upto = np.cumsum(np.bincount(level.high, minlength=n + 2))
        s = windows[open_]
        a, b = before[s + 1], upto[s + WINDOW - 1] - 1
        fits = a <= b
        s, a, b, found = s[fits], a[fits], b[fits], open_[fits]
        if len(s):
            tables = [rank]
            while (1 << len(tables)) <= WINDOW:
                t, w = tables[-1], 1 << (len(tables) - 1)
                tables.append(np.r_[np.minimum(t[: m - w], t[w:]), t[m - w :]] if m > w else t)
            power = np.floor(np.log2(b - a + 1)).astype(np.int64)
            best = np.empty(len(s), np.uint64)
            for p in np.unique(power).tolist():
                own = power == p
                best[own] = np.minimum(tables[p][a[own]], tables[p][b[own] - (1 << p) + 1])
            level_of[found] = k
            symbol_of[found] = (best & np.uint64((1 << 24) - 1)).astype(np.int64)
        open_ = open_[~fits]
        if not len(open_):
            break
    return levels, windows, level_of, symbol_of, doc


def anchor_rows(words: np.ndarray, first: np.ndarray, end: np.ndarray):
    """(document, anchor, content, start, windows) of each run of windows that share an anchor.

    ``content`` is a hash of all windows of the run, in order, and of where the anchor lies.
    """
    levels, windows, level, symbol, doc = _anchors(words, first, end)
    if not len(windows):
        return None
    hashes = window_hashes(words)[windows]
    new = np.r_[
        True,
        (level[1:] != level[:-1]) | (symbol[1:] != symbol[:-1]) | (windows[1:] != windows[:-1] + 1)
        | (doc[windows[1:]] != doc[windows[:-1]]),
    ]
    at = np.flatnonzero(new)
    count = np.diff(np.r_[at, len(windows)])
    inside = np.arange(len(windows)) - np.repeat(at, count)
    name, place = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    for k, lv in enumerate(levels):
        own = level[at] == k
        name[own] = _mix(lv.name[symbol[at[own]]] + _step(k + 1))
        place[own] = lv.start[symbol[at[own]]]
    content = np.add.reduceat(_mix(hashes + _mix(inside.astype(np.uint64) + _K1)), at)
    content = _join(content, (place - windows[at]).astype(np.uint64) * _K1 + count.astype(np.uint64))
    return doc[windows[at]], name, content, windows[at], count


def _chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[int]]]:
    """(word hashes, first, end, text, first word's place in it) of texts taken together, or of parts of long ones."""
    parts, sizes, owner, offset = [], [], [], []

    def done():
        end = np.cumsum(sizes)
        return np.concatenate(parts), end - np.array(sizes), end, list(owner), list(offset)

    for i, text in enumerate(texts):
        words = text.split()
        if len(words) < WINDOW:
            continue
        for at in range(0, max(1, len(words) - WINDOW + 1), CHUNK):
            part = words[at : at + CHUNK + WINDOW - 1]
            if sum(sizes) + len(part) > CHUNK and parts:
                yield done()
                parts, sizes, owner, offset = [], [], [], []
            parts.append(word_hashes(part))
            sizes.append(len(part))
            owner.append(i)
            offset.append(at)
    if parts:
        yield done()


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _occurrences(docs: DataFrame, id_type: str) -> DataFrame:
    def find(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for words, first, end, owner, offset in _chunks(texts):
                rows = anchor_rows(words, first, end)
                if rows is None:
                    continue
                doc, anchor, content, start, count = rows
                source = pa.array(np.array(owner)[doc])
                place = start - first[doc] + np.array(offset)[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(source), batch.column(1).take(source), _signed(anchor), _signed(content),
                        pa.array(place.astype(np.int32)), pa.array(count.astype(np.int32)),
                    ],
                    names=["id", "text_hash", "anchor", "content", "start", "n"],
                )

    return arrow_map(docs, find, f"id {id_type}, text_hash long, anchor long, content long, start int, n int")


def _windows(texts: DataFrame) -> DataFrame:
    """``anchor, content, copies, place, window`` of every window of the runs listed with each text."""

    def unfold(batches):
        for batch in batches:
            for raw, runs in zip(batch.column("_utf8"), batch.column("runs"), strict=True):
                words, cut = raw.as_py().split(), runs.as_py()
                out = [[], [], [], [], []]
                for r in cut:
                    hashes = window_hashes(word_hashes(words[r["start"] : r["start"] + r["n"] + WINDOW - 1]))
                    for column, value in zip(out, (r["anchor"], r["content"], r["copies"]), strict=False):
                        column.append(np.full(len(hashes), value, np.int64))
                    out[3].append(np.arange(len(hashes), dtype=np.int32))
                    out[4].append(hashes.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in out], names=["anchor", "content", "copies", "place", "window"]
                )

    return arrow_map(texts, unfold, "anchor long, content long, copies long, place int, window long")


def repeated_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text_hash, spans`` of every distinct (id, text) with repeated windows.

    ``spans`` are (first window, bits): bit i says that the window i words on is repeated.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), utf8(text_col).alias("_utf8")
    )
    runs = stage(_occurrences(source, id_type), "anchors")
    known = runs.groupBy("anchor").agg(
        F.count("*").alias("_n"), (F.min("content") == F.max("content")).alias("same")
    ).filter("_n > 1").drop("_n")
    known = stage(known, "known-anchors")  # joined from a table, an anchor that a third of all rows share can be split
    again = stage(runs.join(known, "anchor"), "shared-anchors")
    # runs of one anchor that differ: one of each kind is unfolded, with the number of its copies
    kinds = again.filter("not same").groupBy("anchor", "content").agg(
        F.count("*").alias("copies"), F.min(F.struct("text_hash", "id", "start", "n")).alias("r")
    )
    listed = kinds.groupBy(F.col("r.id").alias("l_id"), F.col("r.text_hash").alias("l_hash")).agg(
        F.collect_list(F.struct("anchor", "content", "copies", "r.start", "r.n")).alias("runs")
    )
    same_text = F.col("id").eqNullSafe(F.col("l_id")) & (F.col("text_hash") == F.col("l_hash"))
    one_row = source.join(listed, same_text).select("id", "text_hash", "_utf8", "runs")
    unfolded = stage(_windows(one_row).distinct(), "windows")
    twice = unfolded.groupBy("anchor", "window").agg(F.sum("copies").alias("_n")).filter("_n > 1").drop("_n")
    twice = stage(twice, "known-windows")
    bits = unfolded.join(twice, ["anchor", "window"]).groupBy("anchor", "content").agg(
        F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits")
    )
    bits = stage(bits, "repeated-windows")
    whole = again.filter("same").withColumn("bits", F.expr("shiftleft(1L, n) - 1"))
    parts = again.filter("not same").join(bits, ["anchor", "content"])
    found = whole.select("id", "text_hash", "start", "bits").union(parts.select("id", "text_hash", "start", "bits"))
    return found.groupBy("id", "text_hash").agg(F.collect_set(F.struct("start", "bits")).alias("spans"))


def _covered(n: int, spans: list[dict]) -> np.ndarray:
    """Which of ``n`` words lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        bits, start = s["bits"], s["start"]
        while bits:
            low = (bits & -bits).bit_length() - 1
            run = ((bits >> low) + 1 & -((bits >> low) + 1)).bit_length() - 1  # ones in a row
            edge[start + low] += 1
            edge[start + low + run - 1 + WINDOW] -= 1
            bits &= ~(((1 << run) - 1) << low)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """``id_col``, the columns ``keep``, ``n_words, n_removed, kept_text, kept_sha256`` of every row.

    A word goes if a window of ``WINDOW`` words that covers it also starts elsewhere, in this or another row.
    All copies lose the passage, the first one too; rows with equal texts are copies. Null texts count as empty,
    and texts shorter than a window keep all words. Rows may share ids. Columns of ``docs`` that are
    not named do not take part.
    """
    found_id, found_hash = fresh(docs, "_found_id"), fresh(docs, "_found_hash")
    found = repeated_windows(docs, id_col, text_col).withColumnsRenamed({"id": found_id, "text_hash": found_hash})
    carried = [c for c in dict.fromkeys([id_col, *keep]) if c != text_col]
    hash_col, body, spans = fresh(docs, "_hash"), fresh(docs, "_utf8"), fresh(docs, "_spans")
    rows = docs.select(*carried, F.xxhash64(text_col).alias(hash_col), utf8(text_col).alias(body))
    same = F.col(id_col).eqNullSafe(F.col(found_id)) & (F.col(hash_col) == F.col(found_hash))
    joined = rows.join(found.withColumnRenamed("spans", spans), same, "left").select(*carried, body, spans)
    schema = rows.select(*carried).schema
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept_text", "string"), ("kept_sha256", "string")):
        schema.add(name, kind)

    def cut(batches):
        for batch in batches:
            n_words, n_removed, kept, digest = [], [], [], []
            for raw, cuts in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                words = raw.as_py().split()
                left = words
                if cuts.is_valid:
                    gone = _covered(len(words), cuts.as_py())
                    left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                text = b" ".join(left)
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(text.decode("utf-8", "replace"))
                digest.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-2], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.string()), pa.array(digest, pa.string()),
                ],
                names=[*batch.schema.names[:-2], "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    return arrow_map(joined, cut, schema)

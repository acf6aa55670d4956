"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel distance.

A test item with an error budget of ``k`` edits is split into ``k + 1`` pieces: wherever the item occurs with
at most ``k`` edits, one piece is there unchanged. An automaton finds the exact hits of all pieces of all items in one pass
over a text. A hit is verified twice: first within its group of pieces, as of all groups one
must stay under as many edits as it has pieces, then for the whole item. Neither test loses a match.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import arrow_map, fresh, utf8

#: Edits allowed, as a share of an item's characters.
ERROR_RATE = 0.1
#: Pieces verified together before the whole item is.
GROUP = 2
#: Characters of items that are searched for in one pass.
BLOCK_CHARS = 2_000_000


def normal(text: str) -> str:
    """Lower case, one space between words."""
    return " ".join(text.lower().split())


def _bits(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | (1 << i)
    return bits


def distances(bits: dict[str, int], m: int, text: str, anchored: bool = False):
    """Myers: after each character of ``text``, the edits between the pattern and what ends there.

    What is compared starts anywhere, or with ``anchored`` at the start of ``text``.
    """
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = ones, 0, m
    for c in text:
        eq = bits.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (ones & ~(zero | plus))
        down = plus & zero
        if up & top:
            score += 1
        if down & top:
            score -= 1
        up = (up << 1) | (1 if anchored else 0)
        down <<= 1
        plus = (down | ~(zero | up)) & ones
        minus = up & zero & ones
        yield score


@dataclass
class Item:
    item_id: object
    text: str
    budget: int

    def __post_init__(self):
        n, parts = len(self.text), self.budget + 1
        cut = [n * i // parts for i in range(parts + 1)]
        self.pieces = list(zip(cut[:-1], cut[1:], strict=True))
        self.groups = [(cut[a], cut[min(parts, a + GROUP)], min(parts, a + GROUP) - a) for a in range(0, parts, GROUP)]
        self.bits, self.reverse = _bits(self.text), _bits(self.text[::-1])
        # the other piece of a pair has one edit at most, so a half of it is unchanged
        self.halves = [(self.text[a : (a + b) // 2], self.text[(a + b) // 2 : b]) for a, b in self.pieces]
        self.group_bits = [_bits(self.text[a:b]) for a, b, _ in self.groups]


class Searcher:
    """Finds items in texts; each task builds its own, which goes with it."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items = []
        for item_id, text in items:
            text = normal(text)
            if text:
                self.items.append(Item(item_id, text, int(len(text) * rate)))
        where: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(self.items):
            for p, (a, b) in enumerate(item.pieces):
                where.setdefault(item.text[a:b], []).append((i, p))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in where.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if where:
            self.automaton.make_automaton()

    def _group_fits(self, item: Item, p: int, text: str, at: int) -> bool:
        """Whether the group of piece ``p``, which is at ``at``, is there with fewer edits than it has pieces."""
        g = p // GROUP
        a, b, parts = item.groups[g]
        if a == b:
            return True
        start = at - (item.pieces[p][0] - a)
        if text.startswith(item.text[a:b], max(0, start)) and start >= 0:
            return True
        window = text[max(0, start - parts) : max(0, start + (b - a) + parts)]
        if not any(half in window for half in item.halves[p ^ 1 if p ^ 1 < len(item.pieces) else p]):
            return False
        return any(d < parts for d in distances(item.group_bits[g], b - a, window))

    def search(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item id, fewest edits, first word, words) of each item in ``text``, at its first best place."""
        if not self.items:
            return []
        text = normal(text)
        best: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int]] = set()
        grouped: dict[tuple[int, int, int], bool] = {}
        for end, (size, owners) in self.automaton.iter(text):
            at = end - size + 1
            for i, p in owners:
                item = self.items[i]
                start = at - item.pieces[p][0]
                if best.get(i, (1, 0))[0] == 0 or (i, start) in tried:
                    continue
                key = (i, p // GROUP, start)
                if key not in grouped:
                    grouped[key] = self._group_fits(item, p, text, at)
                if not grouped[key]:
                    continue
                tried.add((i, start))
                low = max(0, start - item.budget)
                if start >= 0 and text.startswith(item.text, start):
                    best[i] = (0, start + len(item.text))
                    continue
                window = text[low : max(0, start + len(item.text) + item.budget)]
                found = min(
                    ((d, low + j + 1) for j, d in enumerate(distances(item.bits, len(item.text), window))),
                    default=(item.budget + 1, 0),
                )
                if found[0] <= item.budget:
                    best[i] = min(best.get(i, found), found)
        return [self._placed(i, d, end, text) for i, (d, end) in sorted(best.items())]

    def _placed(self, i: int, d: int, end: int, text: str) -> tuple[object, int, int, int]:
        item = self.items[i]
        back = text[max(0, end - len(item.text) - item.budget) : end][::-1]
        size = min((x, j + 1) for j, x in enumerate(distances(item.reverse, len(item.text), back, anchored=True)))[1]
        first = text.count(" ", 0, end - size)
        return item.item_id, d, first, text.count(" ", 0, end - 1) - first + 1


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """The items in blocks of about ``BLOCK_CHARS`` characters; each is searched for in a pass of its own."""
    items = benchmark.select(F.col(item_col).alias("id"), F.col(text_col).alias("text")).dropna(subset=["text"]).distinct()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK_CHARS))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    for b in range(blocks):
        rows = items.filter(block == b).orderBy("id", "text").collect()
        yield [(r.id, r.text) for r in rows]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``id_col, item_col, distance, first_word, n_words``: a row for each row of ``docs`` and item in it.

    Texts are compared in lower case with single spaces; at most ``rate`` of an item's characters may be edited. The
    place given is the first with the fewest edits, in words of the text. Null and empty texts hold no item, null and
    empty items are in no text. Items with equal texts all count; repeated rows give repeated results. Columns that
    are not named do not take part. Nothing is shuffled but the items.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType
    item_type = item_kind.simpleString()
    source = docs.select(F.col(id_col).alias("d"), utf8(text_col).alias("text"))
    found = None
    for block in item_blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches, shared=shared):
            searcher = Searcher(shared.value, rate)
            for batch in batches:
                rows = [
                    (i, *hit)
                    for i, raw in enumerate(batch.column(1))
                    for hit in searcher.search(raw.as_py().decode("utf-8", "replace"))
                ]
                if rows:
                    source_row, item, d, first, n = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(source_row)), pa.array(item), pa.array(d, pa.int32()),
                            pa.array(first, pa.int64()), pa.array(n, pa.int64()),
                        ],
                        names=["d", "i", "distance", "first_word", "n_words"],
                    )

        schema = f"d {id_type}, i {item_type}, distance int, first_word long, n_words long"
        part = arrow_map(source, search, schema)
        found = part if found is None else found.union(part)
    return found.withColumnsRenamed({"d": id_col, "i": item_col})


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; see ``find_leaks``. Nothing is shuffled."""
    for block in item_blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        body = fresh(docs, "_utf8")

        def clean(batches, shared=shared):
            searcher = Searcher(shared.value, rate)
            for batch in batches:
                own = [not searcher.search(raw.as_py().decode("utf-8", "replace")) for raw in batch.column(body)]
                yield batch.drop_columns([body]).filter(pa.array(own, pa.bool_()))

        docs = arrow_map(docs.withColumn(body, utf8(text_col)), clean, docs.schema)
    return docs

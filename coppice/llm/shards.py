"""Shards of nearly equal bytes by a histogram sort.

Rows are ordered by a key and cut into shards at splitters. The splitters are found by counting:
every round counts, exactly and in each partition, the bytes and rows between candidate
boundaries, adds the counts up, and places new candidates inside the one gap in which a
splitter must lie, until the bytes below it are within tolerance of its share. Only then do
rows move, once, to the piece of a shard they belong to. As the rows below each splitter are
known, a row's place in its shard is its rank in its piece plus a constant.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.common import arrow_map, stage, utf8

#: Bytes of a key: hash of the text, hash of the whole row's identity, both unsigned.
KEY_BYTES = 16
_END = 1 << (8 * KEY_BYTES)
#: Candidates placed in a gap in each round.
PROBES = 24


@dataclass
class Splitter:
    """Where a target lies: between ``low`` (its bytes are below) and ``high``."""

    target: float
    tolerance: float
    low: int = 0
    low_bytes: int = 0
    low_rows: int = 0
    high: int = _END
    high_bytes: int = 0
    high_rows: int = 0

    def settled(self) -> tuple[int, int, int] | None:
        """(key, bytes below, rows below) of a boundary that will do."""
        near = min(
            (abs(b - self.target), k, b, r)
            for k, b, r in ((self.low, self.low_bytes, self.low_rows), (self.high, self.high_bytes, self.high_rows))
        )
        if near[0] <= self.tolerance or self.high - self.low <= 1 or self.high_rows - self.low_rows <= 1:
            return near[1:]
        return None


def _hash_bytes(column: Column) -> Column:
    return F.unhex(F.lpad(F.hex(column), 16, "0"))


def sort_key(text: Column, *identity: Column) -> Column:
    """Binary key that keeps equal texts next to each other."""
    return F.concat(_hash_bytes(F.xxhash64(text)), _hash_bytes(F.xxhash64(*identity)))


def _histogram(slim: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(gap, bytes, rows, smallest key, largest key) of every gap with rows; gap i lies below probe i.

    The result has a row for each probe and task at most, and one for each probe on the driver.
    """
    edges = np.array([p.to_bytes(KEY_BYTES, "big") for p in probes], dtype=f"S{KEY_BYTES}")

    def count(batches):
        size = np.zeros(len(edges) + 1, np.int64)
        rows = np.zeros(len(edges) + 1, np.int64)
        low: dict[int, bytes] = {}
        high: dict[int, bytes] = {}
        for batch in batches:
            keys = np.array(batch.column(0).to_pylist(), dtype=f"S{KEY_BYTES}")
            if not len(keys):
                continue
            gap = np.searchsorted(edges, keys, side="right")
            np.add.at(size, gap, batch.column(1).to_numpy())
            np.add.at(rows, gap, 1)
            order = np.lexsort((keys, gap))
            gap, keys = gap[order], keys[order]
            first = np.flatnonzero(np.r_[True, gap[1:] != gap[:-1]])
            last = np.r_[first[1:] - 1, len(gap) - 1]
            for g, a, b in zip(gap[first].tolist(), keys[first].tolist(), keys[last].tolist(), strict=True):
                a, b = a.ljust(KEY_BYTES, b"\0"), b.ljust(KEY_BYTES, b"\0")
                low[g] = min(low.get(g, a), a)
                high[g] = max(high.get(g, b), b)
        found = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(found.astype(np.int32)), pa.array(size[found]), pa.array(rows[found]),
                pa.array([low[g] for g in found.tolist()], pa.binary()),
                pa.array([high[g] for g in found.tolist()], pa.binary()),
            ],
            names=["gap", "size", "n", "low", "high"],
        )

    parts = arrow_map(slim, count, "gap int, size long, n long, low binary, high binary")
    total = parts.groupBy("gap").agg(
        F.sum("size").alias("size"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    return sorted(
        (r.gap, r["size"], r.n, int.from_bytes(r.low, "big"), int.from_bytes(r.high, "big")) for r in total.collect()
    )


def _tighten(splitters: list[Splitter], probes: list[int], gaps: list[tuple[int, int, int, int, int]]) -> None:
    """Move both ends of every open splitter to the boundaries around its target."""
    keys, below_bytes, below_rows = [], [], []
    size = rows = 0
    for _, s, n, low, high in gaps:  # before and behind the keys that are there
        keys += [low, high + 1]
        below_bytes += [size, size + s]
        below_rows += [rows, rows + n]
        size, rows = size + s, rows + n
    for x in splitters:
        if x.settled() and x.high_rows:
            continue
        at = bisect.bisect_left(below_bytes, x.target)
        if at < len(keys) and (not x.high_rows or keys[at] < x.high):
            x.high, x.high_bytes, x.high_rows = keys[at], below_bytes[at], below_rows[at]
        if at and keys[at - 1] > x.low:
            x.low, x.low_bytes, x.low_rows = keys[at - 1], below_bytes[at - 1], below_rows[at - 1]


def find_splitters(slim: DataFrame, targets: list[tuple[float, float]], size: int, rows: int) -> list[tuple[int, int, int]]:
    """(key, bytes below, rows below) for each (target, tolerance), in rising order.

    ``slim`` has columns ``key`` and ``size`` and should be a staged table, as each round reads it.
    A round cuts every open gap into ``PROBES + 1`` and then shrinks it to the keys that
    are there, so hot keys and dense ids take few rounds more than spread keys.
    """
    splitters = [Splitter(t, tol, high_bytes=size, high_rows=rows) for t, tol in targets]
    for x in splitters:
        x.high_rows = 0  # not counted yet
    while open_ := [x for x in splitters if not x.high_rows or not x.settled()]:
        probes: set[int] = set()
        for low, high in {(x.low, x.high) for x in open_}:
            wanted = PROBES * max(1, sum(1 for x in open_ if x.low == low and x.high == high) // 4)
            step = max(1, (high - low) // (wanted + 1))
            probes.update(range(low + step, min(high, low + step * wanted + 1), step))
            probes.update(p for p in (low, high) if 0 < p < _END)
        placed = sorted(probes)
        _tighten(splitters, placed, _histogram(slim, placed))
    return [x.settled() for x in splitters]


def shard_by_bytes(
    df: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    piece_bytes: int = 256 << 20,
    tolerance: float = 0.001,
) -> DataFrame:
    """``id_col, text_col, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``df``.

    ``size`` is the UTF-8 bytes of the text plus 8. Shards are ranges of the sort key, so equal
    texts are neighbours, and each splitter is within ``tolerance`` of a shard's share, or at
    the row nearest to it where a single row is larger than that. ``slot`` counts each shard's
    rows from 0 without gaps. Shards are made of pieces of about ``piece_bytes``, each of which is
    one task, so a third of all rows in one group of copies is cut like the rest.

    Null text has size 8, crc32 0, and is a text of its own for the order; a null id is an id.
    Rows equal in id and text share a key and stay in one shard, with slots of their own. Empty
    tables give no rows; with fewer rows than shards some shards are empty. Columns of ``df`` other
    than the two named do not take part.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text, payload = F.col(text_col), utf8(text_col)
    rows = df.select(
        F.col(id_col), text,
        (F.octet_length(payload) + F.lit(8)).cast("long").alias("size"),
        F.crc32(payload).alias("text_crc32"),
        sort_key(text, F.col(id_col), text).alias("key"),
    )
    slim = stage(rows.select("key", "size"), "shard-keys")
    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    size, n = int(total[0]), int(total[1])
    if not n:
        pieces = []
    else:
        share = size / shards
        cuts = max(1, -(-int(share) // piece_bytes))
        targets = [
            (share * (s + c / cuts), share * tolerance if not c else share / cuts / 8)
            for s in range(shards) for c in range(cuts) if s or c
        ]
        pieces = find_splitters(slim, targets, size, n)
        del slim
    shard_of = [0] + [(i + 1) // (cuts if n else 1) for i in range(len(pieces))]
    below = [0] + [r for _, _, r in pieces]
    edges = [k for k, _, _ in pieces]
    start: dict[int, int] = {}
    for s, r in zip(shard_of, below, strict=True):
        start.setdefault(s, r)
    base = [r - start[s] for s, r in zip(shard_of, below, strict=True)]
    packed = np.array([min(k, _END - 1).to_bytes(KEY_BYTES, "big") for k in edges], dtype=f"S{KEY_BYTES}")
    beyond = sum(1 for k in edges if k >= _END)  # boundaries behind every row

    @F.pandas_udf("int")
    def piece_of(key):
        found = np.array(key.tolist(), dtype=f"S{KEY_BYTES}")
        import pandas as pd

        return pd.Series(np.searchsorted(packed[: len(packed) - beyond], found, side="right").astype(np.int32))

    by_piece = Window.partitionBy("piece").orderBy("key")
    lookup = lambda values: F.element_at(F.lit(values), F.col("piece") + 1)
    placed = rows.withColumn("piece", piece_of("key")).withColumn("at", F.row_number().over(by_piece))
    return placed.select(
        F.col(id_col), F.col(text_col), "size", "text_crc32", F.lit("bytes").alias("law"),
        lookup([int(s) for s in shard_of]).cast("int").alias("shard"),
        (lookup([int(b) for b in base]).cast("long") + F.col("at") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

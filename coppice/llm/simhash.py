"""SimHash near-duplicates through an inverted index on bytes in their positions.

A fingerprint has eight bytes. Two that differ in at most two bits differ in at most two bytes, so a pair
that links shares at least six bytes in their positions. Tallying single shared bytes for each pair would
visit a fixed share of all pairs, so the index has a posting list for each choice of six
positions and the bytes there: a pair meets in a list exactly if its tally reaches six. The
fingerprints of a list differ in two bytes only, so there are at most 65,536, and each is verified
against the others by looking up its neighbours. What a list gives on is a star for
each set of linked fingerprints, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import arrow_map, fresh, stage, utf8
from coppice.llm.graph import components

SHINGLE = 3
SEED = 42
#: Bits that may differ, bytes of a fingerprint, and the tally that any pair within them reaches.
RADIUS = 2
BYTES = 8
TALLY = BYTES - RADIUS
#: Every difference of one or two bits between two 16-bit remainders.
_NEAR = np.array([1 << i for i in range(16)] + [(1 << i) | (1 << j) for i, j in combinations(range(16), 2)])
#: Shingles hashed at a time.
_BLOCK = 1 << 16


def fingerprint(text: bytes) -> int:
    """Fingerprint of the UTF-8 bytes of a whole text, 0 if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - SHINGLE + 1)
    hash_ = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        first = starts[at : min(n, at + _BLOCK)].tolist()
        last = ends[at + min(SHINGLE, len(words)) - 1 :][: len(first)].tolist()
        found = np.array([hash_(line[a:b], SEED) for a, b in zip(first, last, strict=True)], dtype=">u8")
        votes += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, keep: list[str], text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the fingerprint of each whole text, as a signed long."""
    schema = docs.select(*keep).schema
    schema.add(name, "long")

    def hashed(batches):
        for batch in batches:
            found = np.array(
                [fingerprint(t.as_py()) for t in batch.column(batch.num_columns - 1)], np.uint64
            ).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found)], names=[*batch.schema.names[:-1], name]
            )

    return arrow_map(docs.select(*keep, utf8(text_col).alias(fresh(docs, "_utf8"))), hashed, schema)


def _posting_lists(fingerprints: DataFrame) -> DataFrame:
    """``list, key, fingerprint``: every fingerprint in its 28 lists, by the choice of two positions left out."""
    f = F.col("fingerprint")
    entries = []
    for k, left in enumerate(combinations(range(BYTES), BYTES - TALLY)):
        mask = sum(0xFF << (8 * p) for p in range(BYTES) if p not in left)
        signed = mask - (1 << 64) if mask >> 63 else mask
        entries.append(F.struct(F.lit(k).cast("byte").alias("list"), f.bitwiseAND(F.lit(signed)).alias("key")))
    return fingerprints.select(f, F.explode(F.array(*entries)).alias("e")).select("e.list", "e.key", "fingerprint")


def _stars(prints: np.ndarray, left: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint it is linked with) within a posting list."""
    bits = prints.view(np.uint64)
    low, high = (bits >> np.uint64(8 * left[0])) & np.uint64(255), (bits >> np.uint64(8 * left[1])) & np.uint64(255)
    rest = (low | (high << np.uint64(8))).astype(np.int64)
    if len(prints) == 2:
        if bin(int(rest[0] ^ rest[1])).count("1") > RADIUS:
            return prints[:0], prints[:0]
        return prints.max(keepdims=True), prints.min(keepdims=True)
    rest_order = np.argsort(rest)
    prints, rest = prints[rest_order], rest[rest_order]
    label = np.arange(len(rest))
    if len(rest) <= 96:
        i, j = np.nonzero(np.triu(_BITS[rest[:, None] ^ rest[None, :]] <= RADIUS, 1))
    else:
        place = np.full(1 << 16, -1)
        place[rest] = label
        found = place[rest[:, None] ^ _NEAR[None, :]]
        i, k = np.nonzero(found > label[:, None])
        j = found[i, k]
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (before == label).all():
            break
    member = np.flatnonzero(label != np.arange(len(label)))
    return prints[member], prints[label[member]]


_BITS = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)
_LEFT = list(combinations(range(BYTES), BYTES - TALLY))


def links(fingerprints: DataFrame) -> DataFrame:
    """``a, b``: edges that connect just the fingerprints that chains of links connect.

    ``fingerprints`` has one column of distinct longs.
    """

    def verify(batches):
        held: tuple[np.ndarray, ...] | None = None  # the last list may go on in the next batch

        def edges(kind, key, prints):
            new = np.r_[True, (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])] if len(key) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            ends = np.r_[starts[1:], len(key)]
            many = ends - starts > 1
            out = [_stars(prints[s:e], _LEFT[kind[s]]) for s, e in zip(starts[many], ends[many], strict=True)]
            a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
            b = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.int64)
            pairs = np.unique(np.stack([a, b], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            columns = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if held is not None:
                columns = tuple(np.concatenate([h, c]) for h, c in zip(held, columns, strict=True))
            kind, key, _ = columns
            if not len(key):
                continue
            whole = np.flatnonzero((kind != kind[-1]) | (key != key[-1]))
            cut = whole[-1] + 1 if len(whole) else 0
            held = tuple(c[cut:] for c in columns)
            if cut:
                yield edges(*(c[:cut] for c in columns))
        if held is not None:
            yield edges(*held)

    index = _posting_lists(fingerprints).repartition("list", "key").sortWithinPartitions("list", "key")
    return arrow_map(index, verify, "a long, b long")


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, fingerprint, root, component_id`` of every row; ``root`` is the component's smallest fingerprint."""
    rows = stage(with_fingerprint(docs.select(F.col(id_col).alias("id"), text_col), ["id"], text_col), "fingerprints")
    classes = rows.groupBy("fingerprint").agg(F.min("id").alias("least"))
    roots = components(links(classes.select("fingerprint")))
    rooted = classes.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(names, "root").select("fingerprint", "root", "component_id"), "fingerprint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint`` (long)``, component_id`` of every row.

    ``component_id`` is the smallest id that chains of links reach, the row's own included; rows with
    equal fingerprints are linked. Texts without a word, null or empty, have fingerprint 0. A null id is
    never the smallest; a component with nothing but null ids has a null id. Rows may share ids. Columns of ``docs``
    other than the two named do not take part. Only distinct fingerprints are indexed, so copies cost nothing
    beyond the grouping.
    """
    return _placed(docs, id_col, text_col).select(F.col("id").alias(id_col), "fingerprint", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all columns as they were: a row with its smallest id.

    Where several rows share that id the one with the smallest fingerprint stays; a component
    without ids keeps its row with the smallest fingerprint. The texts themselves move only for rows
    whose id is null or not their own.
    """
    return keep_rows(docs, _placed(docs, id_col, text_col), with_fingerprint, id_col, text_col)


def keep_rows(
    docs: DataFrame, placed: DataFrame, named: Callable[..., DataFrame], id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row of each component of ``placed`` (``id, fingerprint, root, component_id`` of every row); see ``keep_one``.

    ``named(docs, keep, text_col, name)`` adds the fingerprint of ``placed`` to ``docs``, as ``with_fingerprint`` does.
    """
    placed = stage(placed, "components")
    chosen = placed.filter("id <=> component_id").groupBy("id", "root").agg(F.min("fingerprint").alias("kept"))
    shared = placed.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").select("id")
    shared = stage(shared, "shared-ids")
    name, print_, mark = (fresh(docs, c) for c in ("_id", "_kept", "_fingerprint"))
    own = chosen.join(shared, "id", "left_anti").filter("id is not null").select(F.col("id").alias(name))
    single = docs.join(own, F.col(id_col) == F.col(name), "left_semi")
    shared = shared.withColumnRenamed("id", name)
    again = chosen.join(shared, F.col("id").eqNullSafe(F.col(name))).select(name, F.col("kept").alias(print_))
    doubled = docs.join(shared, F.col(id_col).eqNullSafe(F.col(name)), "left_semi")
    marked = named(doubled, docs.columns, text_col, mark)
    same = F.col(id_col).eqNullSafe(F.col(name)) & (F.col(mark) == F.col(print_))
    thinned = marked.join(again, same, "left_semi").dropDuplicates([id_col, mark]).select(docs.columns)
    return single.unionByName(thinned)

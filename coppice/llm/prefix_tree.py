"""Prefix tree of conversations: ternary search trees over range shards, merged at their boundaries.

A turn is known by a hash of its role and text, so texts never move. Equal conversations are grouped first; the
distinct ones are ordered by their turns and dealt to shards by range, so that a node of the tree lies within one shard, unless it is on the
path to the shard's first or last conversation. Each shard writes its turns as codes of a dictionary of its own and
puts its conversations into a ternary search tree: the middle one first, then the middle ones of both halves, which keeps
the trees of siblings balanced. One traversal, without recursion, sums up members, leaves and savings.

Nodes on a shard's first or last path are finished later: neighbouring shards, ``FAN_IN`` at a time, add up what they know of
equal nodes, close those that have become inner ones, and pass on the two paths at the ends, until one shard is left.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import arrow_map, stage

#: Turns of distinct conversations that a shard is planned to hold, and shards that are merged together.
SHARD_TURNS = 200_000
FAN_IN = 64
#: Ids that a part of a long list of members is planned to hold.
PART_IDS = 1_000
#: Bytes of the hash by which a turn or a node is known.
KEY_BYTES = 16
_EMPTY = hashlib.sha256(b"").hexdigest()
_ROOT = bytes(KEY_BYTES)


def turn_rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, key, words`` of every turn that belongs to a conversation."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    named = F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_)
    key = F.substring(F.unhex(F.sha2(named.cast("binary"), 256)), 1, KEY_BYTES)
    words = F.regexp_count(text_, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.filter(F.col(conv).isNotNull())
    return rows.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), key.alias("key"), words.alias("words"))


def borrowed_turns(conv: Column, most: int) -> Column:
    """How many turns a conversation takes from the one it copies: crc32 of its decimal id, modulo."""
    return (F.crc32(conv.cast("string").cast("binary")) % (most + 1)).cast("int")


def rebuilt(turns: DataFrame, family: int, most: int) -> DataFrame:
    """``conv, path`` of every conversation: its turns (key, words) in order, the first ones replaced.

    Conversation c takes its first h turns from conversation c - c % ``family``, h from 0 to ``most`` by a hash of c; all if that has
    fewer, none if it is absent. Its own turns after its first h follow. A null turn number comes first; equal ones are ordered by
    the hash of role and text.
    """
    row = F.struct("turn", "key", "words")
    own = turns.groupBy("conv").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    own = stage(own.select("conv", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("path")), "own")
    base = F.col("conv") - F.col("conv") % family
    taken = borrowed_turns(F.col("conv"), most)
    copies = own.select("conv", base.alias("base"), taken.alias("taken"), "path")
    whole = copies.filter("base = conv or taken = 0").select("conv", "path")
    heads = own.filter(F.col("conv") % family == 0).select(F.col("conv").alias("base"), F.slice("path", 1, most).alias("head"))
    others = copies.filter("base <> conv and taken > 0").join(heads, "base", "left")
    none = F.array().cast(own.schema["path"].dataType)
    head = F.coalesce(F.slice("head", F.lit(1), F.col("taken")), none)
    rest = F.slice("path", F.col("taken") + 1, F.greatest(F.size("path") - F.col("taken"), F.lit(0)))
    return whole.unionByName(others.select("conv", F.concat(head, rest).alias("path")))


def member_hashes(members: DataFrame, part_ids: int = PART_IDS) -> DataFrame:
    """``name, ends``: SHA-256 of the ascending, comma-joined ``conv`` ids of each ``name``.

    The hash reads its list from front to back. Ids are gathered in parts by their range, so a list, however long, passes
    by as a row for each part and is never held.
    """
    bounds = members.agg(F.min("conv").alias("low"), F.max("conv").alias("high"), F.count("*").alias("n")).first()
    if not bounds["n"]:
        return members.select("name", F.lit(_EMPTY).alias("ends"))
    width = max(1, part_ids * (bounds["high"] - bounds["low"] + 1) // bounds["n"])
    part = F.floor((F.col("conv") - F.lit(bounds["low"])) / F.lit(width)).cast("long")
    parts = members.groupBy("name", part.alias("part")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    parts = parts.select("name", "part", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def digest(batches):
        name, state = None, None
        for batch in batches:
            names, ends = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != name:
                    if state is not None:
                        names.append(name)
                        ends.append(state.hexdigest())
                    name, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ends)], names=["name", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], names=["name", "ends"])

    ordered = parts.repartition("name").sortWithinPartitions("name", "part")
    return arrow_map(ordered, digest, "name binary, ends string")


@dataclass
class Node:
    """A node, or what is known of it in some shards: members, and what its closed children add up to."""

    key: bytes
    above: bytes | None
    depth: int
    words: int
    convs: int = 0
    least: int | None = None
    ends: str | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    #: Whether it is on the path to the first or the last conversation of its shard.
    first: bool = False
    last: bool = False

    def add(self, other: Node) -> None:
        """What another shard knows of the same node."""
        self.convs += other.convs
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends
        if self.least is None or (other.least is not None and other.least < self.least):
            self.least = other.least


@dataclass
class TernaryTree:
    """Ternary search trees of sequences of whole numbers: in each node a code, smaller, equal and larger."""

    code: list[int] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    down: list[int] = field(default_factory=list)
    #: The tree node that each one hangs on as a further turn, -1 for first turns.
    above: list[int] = field(default_factory=list)
    top: int = -1

    def _new(self, code: int, above: int) -> int:
        self.code.append(code)
        self.above.append(above)
        for links in (self.low, self.high, self.down):
            links.append(-1)
        return len(self.code) - 1

    def insert(self, codes: list[int]) -> list[int]:
        """The nodes of a sequence, added where they are missing."""
        path, above = [], -1
        for code in codes:
            at = self.top if above < 0 else self.down[above]
            if at < 0:
                at = self._new(code, above)
                if above < 0:
                    self.top = at
                else:
                    self.down[above] = at
            while self.code[at] != code:
                side = self.low if code < self.code[at] else self.high
                if side[at] < 0:
                    side[at] = self._new(code, above)
                at = side[at]
            path.append(at)
            above = at
        return path


def middle_first(n: int) -> Iterator[int]:
    """The numbers below ``n``: the middle one, then the middle ones of both halves, and so on."""
    waiting = deque([(0, n)])
    while waiting:
        low, high = waiting.popleft()
        if low < high:
            middle = (low + high) // 2
            yield middle
            waiting.append((low, middle))
            waiting.append((middle + 1, high))


def child_key(above: bytes, turn: bytes) -> bytes:
    return hashlib.sha256(above + turn).digest()[:KEY_BYTES]


def shard_nodes(rows: list[tuple]) -> list[Node]:
    """The nodes of a shard, parents before children; ``rows`` are (turn keys, words, members, least, hash of members), in order."""
    dictionary = {key: code for code, key in enumerate(sorted({k for keys, *_ in rows for k in keys}))}
    tree, where = TernaryTree(), [[] for _ in rows]
    for r in middle_first(len(rows)):
        where[r] = tree.insert([dictionary[k] for k in rows[r][0]])
    root = Node(_ROOT, None, 0, 0)
    nodes: list[Node | None] = [None] * len(tree.code)
    order = [root]
    for path, (keys, words, convs, least, ends) in zip(where, rows, strict=True):
        above = root
        for at, turn, n in zip(path, keys, words, strict=True):
            if nodes[at] is None:
                nodes[at] = Node(child_key(above.key, turn), above.key, above.depth + 1, n)
                order.append(nodes[at])
            above = nodes[at]
        above.convs += convs
        above.ends = ends
        above.least = least if above.least is None else min(above.least, least)
    for mark, path in (("first", where[0]), ("last", where[-1])):
        setattr(root, mark, True)
        for at in path:
            setattr(nodes[at], mark, True)
    by_key = {n.key: n for n in order}
    for node in reversed(order):  # the members of a node are also those of the one above
        if node.above is not None:
            above = by_key[node.above]
            above.convs += node.convs
            above.least = node.least if above.least is None else min(above.least, node.least)
    return order


def closed(nodes: list[Node], whole: bool) -> tuple[list[tuple], list[Node]]:
    """(result rows, nodes still open) of nodes that are listed parents first.

    A node closes unless it is on the first or the last path; if the nodes are the ``whole`` tree all close. Row:
    least, depth, least of the parent, members, children, leaves, savings, hash of members, key, key of an open parent.
    """
    by_key = {n.key: n for n in nodes}
    rows, open_ = [], []
    for node in reversed(nodes):
        if not whole and (node.first or node.last):
            open_.append(node)
            continue
        leaves = node.leaves + (node.children == 0)
        saved = node.saved + (node.convs - 1) * node.words
        above = by_key.get(node.above)
        waits = above is not None and not whole and (above.first or above.last)
        rows.append((
            node.least, node.depth, None if above is None or waits else above.least, node.convs, node.children, leaves, saved,
            node.ends or _EMPTY, node.key, node.above if waits else None,
        ))
        if above is not None:
            above.children += 1
            above.leaves += leaves
            above.saved += saved
    return rows, open_[::-1]


def merged(parts: Iterable[tuple[int, list[Node]]]) -> list[Node]:
    """The nodes of neighbouring shards, added up, parents first; their first and last paths are those of the row of shards."""
    parts = sorted(parts, key=lambda p: p[0])
    out: dict[bytes, Node] = {}
    for k, (_, nodes) in enumerate(parts):
        for node in nodes:
            first, last = node.first and k == 0, node.last and k == len(parts) - 1
            if node.key in out:
                out[node.key].add(node)
            else:
                out[node.key] = node
                node.first = node.last = False
            out[node.key].first |= first
            out[node.key].last |= last
    return sorted(out.values(), key=lambda n: n.depth)


_KINDS = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
#: Columns of a result row, and of what it leaves to be resolved.
_ROW = {
    **dict.fromkeys(("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), "long"),
    "ends_sha256": "string", "name": "binary", "waits_for": "binary",
}
_RESULT = list(_ROW)[:8]
#: An open node, with its shard.
_NODE = {
    "shard": "long", "key": "binary", "above": "binary", **dict.fromkeys(("depth", "words", "convs", "least"), "long"),
    "ends": "string", **dict.fromkeys(("children", "leaves", "saved"), "long"), "first": "boolean", "last": "boolean",
}
_NODE_TYPE = pa.struct([(n, _KINDS[k]) for n, k in _NODE.items()])
#: A row is a result row, or has an open ``node``.
_BOTH = ", ".join(f"{n} {k}" for n, k in _ROW.items()) + f", node struct<{', '.join(f'{n}: {k}' for n, k in _NODE.items())}>"


def _written(shard: int, rows: list[tuple], open_: list[Node], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    names, types = [*_ROW, "node"], [_KINDS[k] for k in _ROW.values()]
    for at in range(0, len(rows), size):
        part = list(zip(*rows[at : at + size], strict=True))
        arrays = [pa.array(c, t) for c, t in zip(part, types, strict=True)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(part[0]), _NODE_TYPE)], names=names)
    for at in range(0, len(open_), size):
        part = [vars(n) | {"shard": shard} for n in open_[at : at + size]]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(part), t) for t in types], pa.array(part, _NODE_TYPE)], names=names)


def _first_level(sequences: DataFrame, shards: int) -> DataFrame:
    def build(batches):
        rows = []
        for batch in batches:
            rows += zip(*[c.to_pylist() for c in batch.columns], strict=True)
        if rows:
            nodes, open_ = closed(shard_nodes(rows), shards == 1)
            yield from _written(TaskContext.get().partitionId(), nodes, open_)

    columns = sequences.select("keys", "words", "n", "least", "ends")
    ranged = columns.repartitionByRange(shards, "keys").sortWithinPartitions("keys")
    return arrow_map(ranged, build, _BOTH)


def _next_level(nodes: DataFrame, last: bool) -> DataFrame:
    """One level of merging: ``FAN_IN`` neighbouring shards become one."""

    def merge(key, table):
        parts: dict[int, list[Node]] = {}
        for r in table.drop_columns(["group"]).to_pylist():
            parts.setdefault(r.pop("shard"), []).append(Node(**r))
        rows, open_ = closed(merged(parts.items()), last)
        batches = _written(key[0].as_py(), rows, open_)
        return pa.Table.from_batches(batches)

    grouped = nodes.withColumn("group", F.floor(F.col("shard") / FAN_IN).cast("long")).groupBy("group")
    return grouped.applyInArrow(merge, _BOTH)


def prefix_tree(
    conversations: DataFrame, family: int = 20, most: int = 3, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text", shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations, the empty one included.

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``. See ``rebuilt`` for what
    conversations are made of. Null roles and texts are empty; rows without a conversation id belong to none and are left
    out; repeated rows are turns of their own. Other columns do not take part; an empty table gives no rows.

    A conversation is one path of the tree, so its turns (24 bytes each) are brought together; nothing else is. Hot
    conversations are grouped before they move, and lists of members pass by in parts.
    """
    turns = turn_rows(conversations, conv_col, turn_col, role_col, text_col)
    paths = rebuilt(turns, family, most).withColumns({"keys": F.col("path.key"), "words": F.col("path.words")})
    whole = F.array_join(F.transform("keys", F.hex), "").cast("binary")
    name = F.substring(F.unhex(F.sha2(whole, 256)), 1, KEY_BYTES)
    paths = stage(paths.select("conv", "keys", "words", name.alias("name")), "paths")
    ends = member_hashes(paths.select("name", "conv"))
    grouped = paths.groupBy("name", "keys", "words").agg(F.count("*").alias("n"), F.min("conv").alias("least"))
    sequences = stage(grouped.join(ends, "name"), "sequences")
    total = sequences.agg(F.sum(F.size("keys") + 1)).first()[0] or 0
    shards = max(1, -(-total // shard_turns))
    levels = [stage(_first_level(sequences, shards), "nodes")]
    while shards > 1:
        shards = -(-shards // FAN_IN)
        open_ = levels[-1].filter("node is not null").select("node.*")
        levels.append(stage(_next_level(open_, shards == 1), "nodes"))
    rows = reduce(DataFrame.unionByName, [x.filter("node is null").drop("node") for x in levels])
    done = rows.filter("waits_for is null").select(*_RESULT)
    if len(levels) == 1:
        return done
    # the parents that were open above closed in a later level
    later = reduce(DataFrame.unionByName, levels[1:]).filter("node is null").select(F.col("name").alias("key"), F.col("conv_id").alias("parent"))
    waiting = rows.filter("waits_for is not null").join(later, F.col("waits_for") == F.col("key"))
    return done.unionByName(waiting.withColumn("parent_conv_id", F.col("parent")).select(*_RESULT))

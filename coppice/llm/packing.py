"""Best-fit packing of documents into sequences, planned on a histogram of lengths.

Best fit only looks at lengths, so it is run on counts: the histogram has a row for each length
up to the sequence length, whatever the number of documents, and whole blocks of equal bins
take equal pieces at once. The plan says, for ranges of the rank within a length, which
sequences hold them and where. Spark spreads the ranges into slots, and pieces take
slots by joining on length and rank within length.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count, pairwise
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coppice.llm.common import arrow_map, stage, utf8

#: Bytes of words and ids that a task remembers in a generation; it holds two.
REMEMBERED_BYTES = 48 << 20
#: What a remembered word takes besides its own bytes and those of its ids.
_ENTRY_BYTES = 160
#: Bytes of the texts that are split at a time; a longer text is split alone.
CHUNK_BYTES = 8 << 20
#: Rows of a plan range that one task spreads, and pieces that are ranked together.
SLOTS_PER_CHUNK = 50_000
#: Steps before the model of a tokenizer for which words may be encoded one by one: it lower-cases, drops white space, and
#: splits into runs of letters, single digits and runs of other signs.
_WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {
            "type": "Split", "behavior": "Removed", "invert": True,
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None, "truncation": None, "padding": None,
}
#: The pieces of a lower-case word of printable ASCII, as the tokenizer's pattern above cuts it.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
_PRINTABLE = re.compile("[!-~]+").fullmatch


def _byte_signs() -> str:
    """The signs by which a byte-level vocabulary writes each byte: printable ones as they are, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = count(256)
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


_BYTE_SIGNS = _byte_signs()


@cache
def _tokenizer(path: str) -> tuple[Tokenizer, bool, tuple[str, ...]]:
    """The tokenizer of a file, whether its file says that words may be encoded one by one, and its added tokens."""
    tokenizer = Tokenizer.from_file(path)
    steps = json.loads(tokenizer.to_str())
    added = steps["added_tokens"]
    within = not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
    spaced = any(re.search(r"\s", t["content"]) for t in added)
    wordwise = within and not spaced and all(steps[k] == v for k, v in _WORDWISE.items())
    return tokenizer, wordwise, tuple(t["content"] for t in added)


class Encoder:
    """Ids of texts, for one task: what it remembers of words goes with it.

    Where the tokenizer's file proves that words may be encoded one by one they are: Arrow splits some texts at a time and
    finds their different words, each is looked up once, and Arrow puts the ids in the words' places. Words of late are
    remembered, in two generations bounded in bytes. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer, self.wordwise, self.added = _tokenizer(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}
        self.bytes = 0

    def text_ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text, without special tokens."""
        return next(self.texts_ids(pa.array([text], pa.large_string())))

    def texts_ids(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, in turn."""
        if not self.wordwise:
            for text in texts:
                yield np.array(self.tokenizer.encode(text.as_py(), add_special_tokens=False).ids, dtype="<u4").tobytes()
            return
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(texts):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + CHUNK_BYTES, "right")))
            words = pc.split_pattern(pc.replace_substring(texts.slice(first, last - first), "\n", " "), " ")
            coded = words.flatten().dictionary_encode()
            found = self.ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            _, starts, body = pa.array(found, pa.large_binary()).take(coded.indices).buffers()
            at = np.frombuffer(starts, np.int64)[words.offsets.to_numpy()].tolist()
            body = memoryview(body or b"")
            for a, b in pairwise(at):
                yield bytes(body[a:b])
            first = last

    def _remember(self, word: str, ids: bytes) -> None:
        if self.bytes > REMEMBERED_BYTES:
            self.before, self.known, self.bytes = self.known, {"": b""}, 0
        self.known[word] = ids
        self.bytes += _ENTRY_BYTES + len(word) + len(ids)

    def _piece(self, low: str) -> bytes:
        """Ids of a piece that the tokenizer's first steps leave as it is, but for writing its bytes as signs."""
        ids = self.known.get(low)
        if ids is None:
            ids = self.before.get(low)
            if ids is None:
                signs = low if low.isascii() else codecs.charmap_decode(low.encode(), "strict", _BYTE_SIGNS)[0]
                own = [t.id for t in self.model.tokenize(signs)]
                ids = struct.pack(f"<{len(own)}I", *own)
            self._remember(low, ids)
        return ids

    def _plain(self, word: str) -> bytes | None:
        """Ids of a word of printable ASCII, or of letters and perhaps a stop or comma; None for other words."""
        if word.isascii():
            if word.isalpha():
                return self._piece(word.lower())
            letters = word[:-1]
            if word[-1] in ".," and letters.isalpha():
                return self._piece(letters.lower()) + self._piece(word[-1])
            if not _PRINTABLE(word) or any(t in word for t in self.added):
                return None
            return b"".join(map(self._piece, _ASCII_PIECES(word.lower())))
        letters, stop = (word[:-1], word[-1]) if word[-1] in ".," else (word, "")
        low = letters.lower()
        if not letters.isalpha() or "\u03a3" in letters or len(low) != len(letters) or not low.isalpha():
            return None
        if not (is_normalized("NFC", letters) and (low == letters or is_normalized("NFC", low))):
            return None
        return self._piece(low) + self._piece(stop)

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word; words have no blanks and line feeds."""
        found = list(map(self.known.get, words))
        rest = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            ids = self._plain(words[i])
            if ids is None:
                ids = self.before.get(words[i])
            if ids is None:
                rest.append(i)
            else:
                found[i] = ids
        for a in range(0, len(rest), 10_000):
            part = [words[i] for i in rest[a : a + 10_000]]
            encoded = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            own = np.array(encoded.ids, dtype="<u4").tobytes()
            end = (np.cumsum(np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(part))) * 4).tolist()
            for i, (start, stop) in zip(rest[a : a + 10_000], pairwise([0, *end]), strict=True):
                found[i] = own[start:stop]
                self._remember(words[i], found[i])
        return found


def encode_text(text: str, path: str) -> bytes:
    """Little-endian 32-bit ids of one text; see ``Encoder`` for many."""
    return Encoder(path).text_ids(text)


def _text(raw: pa.Array) -> pa.Array:
    """Bytes as text, with a replacement character for what is not UTF-8."""
    try:
        return raw.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.large_string())


def token_pieces(
    df: DataFrame, tokenizer: str, max_tokens: int, end_id: int, id_col: str, text_col: str, with_ids: bool = False
) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` (and ``ids``, bytes) of every piece of every row."""
    id_type = df.schema[id_col].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * max_tokens

    def cut(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            ids = batch.column(0)
            source, piece, start, length, crc, body = [], [], [], [], [], []

            def flush():
                out = [
                    ids.take(pa.array(source, pa.int32())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(body, pa.binary()))
                    names.append("ids")
                return pa.RecordBatch.from_arrays(out, names=names)

            for i, tokens in enumerate(encoder.texts_ids(_text(batch.column(1)))):
                tokens += end
                for p, at in enumerate(range(0, len(tokens), step)):
                    part = tokens[at : at + step]
                    source.append(i)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        body.append(part)
                if len(source) > 2_000 or len(body) > 200:
                    yield flush()
                    for x in (source, piece, start, length, crc, body):
                        x.clear()
            if source:
                yield flush()

    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    cut_up = arrow_map(df.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")), cut, schema)
    return cut_up.withColumnRenamed("id", id_col)


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces, pieces to a bin, first bin, offset) of every block of equal bins.

    Best-fit decreasing: lengths from the longest, each piece into the fullest bin that holds it.
    A bin that has just taken a piece is fuller than its equals, so equal pieces fill one bin after
    another, and a block of bins with equal room can be filled in one step.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first bin, bins)
    plan, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        heap = [r for r in room if r >= length]
        heapq.heapify(heap)
        while left:
            if heap:
                r = heapq.heappop(heap)
                blocks = room.pop(r)
            else:
                r = capacity
                fresh = -(-left // (capacity // length))
                blocks = [(bins, fresh)]
                bins += fresh
            each = r // length
            while blocks and left:
                first, n = blocks.pop()
                used = min(n, -(-left // each))
                taken = min(left, used * each)
                plan.append((length, rank, taken, each, first, capacity - r))
                whole, rest = divmod(taken, each)
                if whole and r - each * length:
                    room[r - each * length].append((first, whole))
                if rest:
                    room[r - rest * length].append((first + whole, 1))
                if n > used:
                    blocks.append((first + used, n - used))
                left -= taken
                rank += taken
            if blocks:
                room[r].extend(blocks)
    return plan


def pack(
    df: DataFrame,
    tokenizer: str,
    max_tokens: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Place of every piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its tokens and ``end_id``; only longer ones are cut into ``max_tokens`` pieces.
    Null text counts as empty: one piece of one token. Rows with equal, repeated or null ids are
    documents of their own. An empty table gives no rows. Columns of ``df`` other than the two
    named do not take part. Pieces of equal length are interchangeable; which takes which slot
    follows from the staged table, so a second run may number sequences in another way.
    """
    spark = df.sparkSession
    pieces = token_pieces(df, tokenizer, max_tokens, end_id, id_col, text_col)
    uid = "_row"
    staged = stage(pieces.withColumn(uid, F.monotonically_increasing_id()), "pieces")
    total = staged.count()
    groups = max(1, -(-total // SLOTS_PER_CHUNK))
    ranked = staged.withColumn("_part", F.pmod(F.xxhash64(uid), F.lit(groups)))
    counts = ranked.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = plan_best_fit(histogram, max_tokens)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_part").orderBy(uid)
    ranked = ranked.withColumn("_at", F.row_number().over(inside) - 1).join(bases, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_at"))

    columns = "length long, _rank long, _taken long, _each long, _first long, _offset long"
    ranges = spark.createDataFrame(plan, columns).withColumn(
        "_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_taken") - 1, F.lit(SLOTS_PER_CHUNK).cast("long")))
    )
    tasks = max(1, min(len(plan), groups))
    last = F.least(F.col("_taken"), F.col("_from") + SLOTS_PER_CHUNK) - 1
    slots = ranges.repartition(tasks).withColumn("_j", F.explode(F.sequence(F.col("_from"), last))).select(
        "length", (F.col("_rank") + F.col("_j")).alias("_rank"),
        (F.col("_first") + F.floor(F.col("_j") / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (F.col("_j") % F.col("_each")) * F.col("length")).alias("offset"),
    )
    return ranked.join(slots, ["length", "_rank"]).select(
        id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def packed_sequences(
    df: DataFrame, places: DataFrame, tokenizer: str, max_tokens: int = 4096, end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``sequence_id, ids`` (bytes) of every sequence that ``pack`` has planned; ids must be unique.

    A sequence holds ``max_tokens`` ids at most, so its group is bounded.
    """
    bodies = token_pieces(df, tokenizer, max_tokens, end_id, id_col, text_col, with_ids=True)
    joined = places.join(bodies.select(id_col, "piece", "ids"), [id_col, "piece"])
    parts = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    empty = F.lit(b"").cast("binary")
    return parts.select("sequence_id", F.aggregate("p", empty, lambda a, x: F.concat(a, x["ids"])).alias("ids"))

"""Alignment of two tokenizers by the byte offsets where tokens of both end.

Both tokenizers write the same bytes, a space and the text. A dictionary from end offset to place is made for each
of the two id lists; the offsets that are keys of both, in order, cut the two lists into groups that cover the
same bytes, and within a group each pair of tokens whose bytes overlap is a link. Where the tokenizers' files prove that no
token goes on into white space after other signs, every word is such a cut, and words are aligned one by one and remembered.

How often a pair of ids is linked is a number of the whole corpus, and the pairs grow with it. Texts are therefore worked off in
chunks: a chunk lists each of its pairs once, pairs are summed in Spark, and each chunk gets the sums of its own pairs
back. A frequent pair is one row for each chunk, not for each of its links, and no task holds more than a chunk's pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from bisect import bisect_left
from functools import cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coppice.llm.common import arrow_map, stage, utf8

#: UTF-8 bytes of the texts of a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Bytes of words and what is known of them that a task remembers.
REMEMBERED_BYTES = 96 << 20
_ENTRY_BYTES = 340
#: White space and the word after it; other signs than these that a tokenizer may take for white space.
_WORD = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_WHITE = " \t\n\x0b\x0c\r"
_ODD_SPACE = "\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
#: Steps before the model of a byte-level tokenizer whose tokens have white space at their front only, and how it parts a text.
_BYTE_LEVEL = {
    "normalizer": None, "post_processor": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
}
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Signs beyond which two libraries may take different ones for letters.
_LATE_SIGN = re.compile("[^\x00-\u024f]")

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core


def _byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level tokenizer file: ids of texts, the bytes of each id, and whether words may be encoded one by one."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        signs = _byte_of_sign()
        size = self.tokenizer.get_vocab_size()
        entries = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(signs[c] for c in e) if all(c in signs for c in e) else e.encode() for e in entries]
        self.inner = ""
        steps = json.loads(self.tokenizer.to_str())
        self.wordwise = all(steps[k] == v for k, v in _BYTE_LEVEL.items())
        self.ranked = self._ranked(steps["model"]) if self.wordwise else None

    def _ranked(self, model: dict) -> tiktoken.Encoding | None:
        """A faster encoder of the same ids, where these are the order of merges: single bytes, then a merge each."""
        merges = [m if isinstance(m, str) else "".join(m) for m in model["merges"]]
        merged = [model["vocab"].get(m.replace(" ", "")) for m in merges]
        plain = merged == list(range(256, 256 + len(merges))) and not model["ignore_merges"] and not model["dropout"]
        plain = plain and model["type"] == "BPE" and model["continuing_subword_prefix"] in (None, "")
        plain = plain and model["end_of_word_suffix"] in (None, "") and all(len(b) == 1 for b in self.bytes[:256])
        if not plain:
            return None
        ranks = {b: i for i, b in enumerate(self.bytes[: 256 + len(merges)])}
        return tiktoken.Encoding("byte-level", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part as it is."""
        if self.ranked is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        fast, late = self.ranked.encode_ordinary, _LATE_SIGN.search
        return [self.tokenizer.encode(p, add_special_tokens=False).ids if late(p) else fast(p) for p in parts]


class Pieces:
    """A piece model, which adds a space itself; otherwise as ``ByteLevel``."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        for i, piece in enumerate(pieces):
            written = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
            self.bytes.append(b"" if self.model.is_control(i) else written)
        self.space = self.model.piece_to_id("▁")
        kept = [b"".join(self.bytes[i] for i in self.model.encode(x)) for x in ("a  b \n c ", " a")]
        crossing = any(re.search("[^▁]▁", p) for p in pieces)
        self.wordwise = kept == [b" a  b \n c ", b"  a"] and not crossing and self.bytes[self.space] == b" "
        #: White space that pieces have inside: texts with such are encoded whole.
        self.inner = "".join(sorted({c for p in pieces for c in p if c.isspace()}))

    def encode(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part; the space that the model adds stands for the one that a part begins with.

        A part that begins with no space loses the added one again, which is a token of its own before other white space.
        """
        bare = [p[1:] if p[:1] == " " else p for p in parts]
        # one by one, as the library would start a thread for a list
        found = [self.model.encode(p) for p in bare]
        return [
            (ids or [self.space]) if p[:1] == " " else ids[1:] for p, ids in zip(parts, found, strict=True)
        ]


@cache
def load(path: str) -> ByteLevel | Pieces:
    """The tokenizer of a file, by its ending; of fixed size, so a worker keeps it."""
    tokenizer = ByteLevel(path) if path.endswith(".json") else Pieces(path)
    tokenizer.sizes = [len(b) for b in tokenizer.bytes]
    tokenizer.names = [str(i) for i in range(len(tokenizer.bytes))]
    return tokenizer


def end_places(ids: list[int], sizes: list[int]) -> dict[int, int]:
    """How many tokens end up to each offset where one ends."""
    out, end = {}, 0
    for place, i in enumerate(ids, 1):
        end += sizes[i]
        out[end] = place
    return out


def groups(ends_a: dict[int, int], ends_b: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(first A, past A, first B, past B) of every group: the places between offsets where tokens of both end."""
    out, a, b = [], 0, 0
    for end in sorted(ends_a.keys() & ends_b.keys()):
        out.append((a, a := ends_a[end], b, b := ends_b[end]))
    return out


def align_parts(parts: list[str], ids_a: list[int], ids_b: list[int], a, b) -> list[tuple[int, int, int, bytes, str]] | None:
    """(A tokens, B tokens, groups, the id pair of every link, the groups written out) of each of some parts in a row.

    The ids are those of the parts put together. The result is None if the bytes of an id list are not theirs, or if a part does not end
    with a token of both. A pair is a 64-bit number with A's id in its upper half; groups are written ``a1,a2|b1;a3|b2,b3``.
    """
    bodies = [p.encode("utf-8", "replace") for p in parts]
    whole = b"".join(bodies)
    if b"".join([a.bytes[i] for i in ids_a]) != whole or b"".join([b.bytes[i] for i in ids_b]) != whole:
        return None
    ends_a, ends_b = end_places(ids_a, a.sizes), end_places(ids_b, b.sizes)
    cuts = groups(ends_a, ends_b)
    # within a group, each stretch between two ends of either side is the overlap of one pair
    every = np.array(sorted(ends_a.keys() | ends_b.keys()))
    at_a, at_b = np.searchsorted(np.fromiter(ends_a, np.int64), every), np.searchsorted(np.fromiter(ends_b, np.int64), every)
    pairs = (np.array(ids_a, np.int64)[at_a] << 32 | np.array(ids_b, np.int64)[at_b]).tobytes()
    text_a, text_b = [a.names[i] for i in ids_a], [b.names[i] for i in ids_b]
    written = [
        text_a[i] + "|" + text_b[j] if k - i == 1 == m - j else ",".join(text_a[i:k]) + "|" + ",".join(text_b[j:m])
        for i, k, j, m in cuts
    ]
    past_a = [k for _, k, _, _ in cuts]
    out, end, a0, b0, g0, l0 = [], 0, 0, 0, 0, 0
    for body in bodies:
        end += len(body)
        a1, b1 = ends_a.get(end), ends_b.get(end)
        if a1 is None or b1 is None:
            return None
        g1 = bisect_left(past_a, a1, g0) + 1
        # a link for each token of either side, less one for each group
        l1 = l0 + (a1 - a0) + (b1 - b0) - (g1 - g0)
        out.append((a1 - a0, b1 - b0, g1 - g0, pairs[8 * l0 : 8 * l1], ";".join(written[g0:g1])))
        a0, b0, g0, l0 = a1, b1, g1, l1
    return out


class Aligner:
    """Aligns whole texts, for one task: what it remembers of words goes with it."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = load(path_a), load(path_b)
        self.wordwise = self.a.wordwise and self.b.wordwise
        self.odd = re.compile(f"[{_ODD_SPACE}{re.escape(self.a.inner + self.b.inner)}]")
        self.known: dict[str, tuple | None] = {}
        self.bytes = 0

    def _one(self, part: str) -> tuple | None:
        found = align_parts([part], self.a.encode([part])[0], self.b.encode([part])[0], self.a, self.b)
        return found and found[0]

    def _learn(self, words: list[str]) -> None:
        """Align words that are new, put together behind a stop; those with rare signs, or that are white space only, alone."""
        row = [w for w in words if w[-1] not in _WHITE and not _LATE_SIGN.search(w)]
        parts = [" .", *row]
        text = "".join(parts)
        found = align_parts(parts, self.a.encode([text])[0], self.b.encode([text])[0], self.a, self.b)
        if found is not None:
            self.known.update(zip(row, found[1:], strict=True))
        for w in words:
            if w not in self.known:
                self.known[w] = self._one(w)
        self.bytes += _ENTRY_BYTES * len(words) + 12 * sum(map(len, words))

    def align(self, text: str) -> tuple[tuple[int, int, int], np.ndarray, str]:
        """(A tokens, B tokens and groups), the id pair of every link, and the groups written out; nothing of a text without tokens."""
        nothing = (0, 0, 0), np.zeros(0, np.int64), ""
        if not text:
            return nothing
        if not self.wordwise or self.odd.search(text):
            found = [self._one(" " + text)]
        else:
            words = _WORD.findall(" " + text)
            if self.bytes > REMEMBERED_BYTES:
                self.known, self.bytes = {}, 0
            known = self.known
            new = list(set(words) - known.keys()) if len(words) > len(known) else [w for w in set(words) if w not in known]
            for at in range(0, len(new), 4096):
                self._learn(new[at : at + 4096])
            found = list(map(known.__getitem__, words))
        try:
            n_a = sum(map(itemgetter(0), found))
        except TypeError:  # one of the parts has no tokens
            return nothing
        pairs = np.frombuffer(b"".join(map(itemgetter(3), found)), np.int64)
        written = ";".join(map(itemgetter(4), found))
        n_groups = written.count(";") + 1
        return (n_a, len(pairs) + n_groups - n_a, n_groups), pairs, written


def _numbers(values: np.ndarray) -> bytes:
    return values.astype("<i4").tobytes()


def _chunk_rows(ids: pa.Array, found: list[tuple], chunk: int, names: list[str]):
    """A row for each text of a chunk, and one with the chunk's pairs; ``found`` has counts, pairs and hash of each text."""
    out = {n: [] for n in ("n_a", "n_b", "n_groups", "n_links", "hash", "at", "n")}
    keys = [pairs for _, pairs, _ in found]
    for counts, pairs, hash_ in found:
        for name, value in zip(out, (*counts, len(pairs), hash_), strict=False):
            out[name].append(value)
    pairs, place, total = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    end = 0
    for key in keys:
        own, n = np.unique(place[end : end + len(key)], return_counts=True)
        end += len(key)
        out["at"].append(_numbers(np.diff(own, prepend=0)))
        out["n"].append(_numbers(n))
    size = len(found)
    arrays = [
        pa.array([chunk] * size, pa.int64()), ids, *[pa.array(out[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")],
        pa.array(out["hash"], pa.string()), pa.array(out["at"], pa.binary()), pa.array(out["n"], pa.binary()),
        pa.nulls(size, pa.list_(pa.int64())), pa.nulls(size, pa.list_(pa.int64())),
    ]
    yield pa.RecordBatch.from_arrays(arrays, names=names)
    nothing = [pa.nulls(1, x.type) for x in arrays[1:-2]]
    yield pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), *nothing, pa.array([pairs], pa.list_(pa.int64())), pa.array([total], pa.list_(pa.int64()))],
        names=names,
    )


def aligned_chunks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """Staged rows of all texts (``pairs`` null) and of all chunks (``pairs, total`` not null); ``chunk`` joins them."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["chunk", "id", "n_a", "n_b", "n_groups", "n_links", "hash", "at", "n", "pairs", "total"]
    schema = (
        f"chunk long, id {id_type}, n_a long, n_b long, n_groups long, n_links long, hash string, at binary, n binary, "
        "pairs array<long>, total array<long>"
    )

    def cut(batches):
        aligner = Aligner(path_a, path_b)
        chunk = TaskContext.get().partitionId() << 32
        ids, found, size = [], [], 0
        for batch in batches:
            begin = 0
            for i, raw in enumerate(batch.column(1)):
                body = raw.as_py()
                counts, pairs, written = aligner.align(body.decode("utf-8", "replace"))
                found.append((counts, pairs, hashlib.sha256(written.encode()).hexdigest() if written else ""))
                size += len(body)
                if size >= chunk_bytes:
                    ids.append(batch.column(0).slice(begin, i + 1 - begin))
                    yield from _chunk_rows(pa.concat_arrays(ids), found, chunk, names)
                    ids, found, size, begin, chunk = [], [], 0, i + 1, chunk + 1
            ids.append(batch.column(0).slice(begin))
        if found:
            yield from _chunk_rows(pa.concat_arrays(ids), found, chunk, names)

    return stage(arrow_map(docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")), cut, schema), "aligned")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``pair, count, best`` of every id pair: its links in the corpus, and whether its B id has no pair with more.

    The highest counts are a row for each B id at most, hence bounded by B's vocabulary.
    """
    listed = _listed(chunks)
    counts = stage(listed.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    joined = counts.join(F.broadcast(highest), b == F.col("b"))
    return joined.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _listed(chunks: DataFrame) -> DataFrame:
    listed = chunks.filter("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "total")).alias("place", "e"))
    return listed.select("chunk", "place", F.col("e.pairs").alias("pair"), F.col("e.total").alias("n"))


def alignment(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``.

    ``path_a`` is a byte-level tokenizer file, ``path_b`` a piece model; strings of special tokens in a text are plain text.
    Texts that are null or empty, or whose bytes one of the two does not write as they are, have no tokens: zeros and an empty
    hash. ``n_best`` counts the links whose pair no other pair of their B id outnumbers in the corpus, ``count_sum`` adds up the counts of
    the pairs of all links. Rows may share or lack ids; repeated rows count as often as they occur. Other columns do not take part;
    an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    chunks = aligned_chunks(docs, path_a, path_b, id_col, text_col, chunk_bytes)
    sums = _listed(chunks).select(F.col("chunk").alias("of"), "place", "pair").join(pair_counts(chunks), "pair")
    known = sums.select("of", "place", "count", "best")
    texts = chunks.filter("pairs is null").drop("pairs", "total").withColumn("in", F.col("chunk") + 0)
    schema = (
        f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )

    def look_up(rows, sums):
        place = sums.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = sums.column("count").to_numpy(), sums.column("best").to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for at, n in zip(rows.column("at"), rows.column("n"), strict=True):
            own = np.cumsum(np.frombuffer(at.as_py(), "<i4").astype(np.int64))
            times = np.frombuffer(n.as_py(), "<i4").astype(np.int64)
            n_best.append(int(times @ best[own]))
            count_sum.append(int(times @ count[own]))
        kept = rows.select(["id", "n_a", "n_b", "n_groups", "n_links"])
        kept = kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
        return kept.append_column("groups_sha256", rows.column("hash"))

    # a chunk without a link has no sums, but its texts are rows all the same
    found = texts.groupBy("in").cogroup(known.groupBy("of")).applyInArrow(look_up, schema)
    return found.withColumnRenamed("id", id_col)

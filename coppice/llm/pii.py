"""Personal data: fixed formats, and identifiers found through the contexts that known ones share.

Fixed formats (email, ip, card, phone) give the seeds, and so do tokens that look like keys or digests, which may also be
harmless: those count as found only where a pattern says so. The words next to seeds induce patterns: *the
token after this word*, *the token before that word*. Patterns and the tokens they hold form a graph, which
Spark scores in rounds: a pattern is as good as the share of its places, anywhere in the corpus, that hold
trusted tokens; a token is as trusted as its patterns together make it. Patterns above a threshold then
discover tokens that no fixed format knows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import arrow_map, fresh, stage, utf8

KINDS = ("email", "ip", "card", "phone")
#: Kind of a span that only a pattern has found.
FOUND = "context"
#: Different seeds that a pattern must hold, rounds, and threshold.
LEAST_SEEDS = 5
ROUNDS = 4
THRESHOLD = 0.8
#: Patterns a task holds at a time; different words a task counts before it passes them on.
BLOCK = 200_000
HELD = 200_000
#: Bits of the filter that spares most words the way to the counts of patterns (1 MB).
FILTER_BITS = 1 << 23
_PAGE = 32_768
#: Characters up to which a word is its own name; a longer one is named by a digest.
_LONG = 40
#: Fixed formats of keys and digests: seeds, but no spans of their own.
_SECRET = re.compile(
    r"[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64}|AKIA[0-9A-Z]{16}|gh[oprsu]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|"
    r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}|eyJ[\w-]+\.[\w-]+\.[\w-]+"
)
#: What is known of a token: a fixed format has it, it looks like a key, it may be an identifier.
_BASE, _KEY, _MAYBE = 2, 1, 0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A token with a digit, at least six characters long, and its ends without punctuation.
_TOKEN = re.compile(r"[^\s]+")
_EDGES = ".,;:!?\"'()[]{}<>|#*$%&="


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def _ips(text: str):
    # a match takes the first four numbers of what dots connect, the next one the next four
    for dotted in _DOTTED.finditer(text):
        parts = dotted.group().split(".")
        at = dotted.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            # a number of more than 300 digits is not below 256 however it is read
            if all(len(p) < 300 and int(p) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed formats, in order; time grows with the text, whatever is in it."""
    spans = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [(a, b, 1) for a, b in _ips(text)]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    spans.append((m.start(), m.end(), 3))
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


def _identifier(text: str, start: int, end: int) -> tuple[int, int] | None:
    """Bounds of the token's core if it may be an identifier."""
    while start < end and text[start] in _EDGES:
        start += 1
    while end > start and text[end - 1] in _EDGES:
        end -= 1
    return (start, end) if end - start >= 6 and _DIGIT.search(text, start, end) else None


def _word(token: str) -> str:
    return _named(token.lower())


def _named(word: str) -> str:
    """A word, or a digest of a long one."""
    if len(word) <= _LONG:
        return word
    return "#" + hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=18).hexdigest()


def _bounds(text: str, at: int) -> tuple[int, int]:
    """Bounds of the token around ``at``."""
    start = end = at
    while start and not text[start - 1].isspace():
        start -= 1
    while end < len(text) and not text[end].isspace():
        end += 1
    return start, end


def _neighbours(text: str, start: int, end: int) -> tuple[str | None, str | None]:
    """The words before and after a span."""
    i = start
    while i and not text[i - 1].isspace():
        i -= 1  # the token may begin before the span
    while i and text[i - 1].isspace():
        i -= 1
    before = _word(text[_bounds(text, i - 1)[0] : i]) if i else None
    j = end
    while j < len(text) and not text[j].isspace():
        j += 1
    found = _TOKEN.search(text, j)
    return before, _word(found.group()) if found else None


def _tokens(text: str, base: list[tuple[int, int, int]]):
    """(start, end, what is known) of base spans and of tokens that may be identifiers and touch no base span."""
    for a, b, _ in base:
        yield a, b, _BASE
    k, last = 0, -1
    ordered = sorted((a, b) for a, b, _ in base)
    for digit in _DIGIT.finditer(text):
        if digit.start() < last:
            continue
        start, last = _bounds(text, digit.start())
        core = _identifier(text, start, last)
        if not core:
            continue
        while k < len(ordered) and ordered[k][1] <= core[0]:
            k += 1
        if k == len(ordered) or ordered[k][0] >= core[1]:
            yield *core, _KEY if _SECRET.fullmatch(text, *core) else _MAYBE


def _graph(docs: DataFrame, text_col: str) -> DataFrame:
    """``side, word, token, seed, n``: how often a token stands after (L) or before (R) a word, summed in each task."""

    def read(batches):
        for batch in batches:
            found: Counter = Counter()  # at most as large as the texts of a batch
            for raw in batch.column(0):
                text = raw.as_py().decode("utf-8", "replace")
                for a, b, known in _tokens(text, base_spans(text)):
                    seed = known > _MAYBE
                    before, after = _neighbours(text, a, b)
                    # a digest names a token: only whether two are equal counts
                    token = hashlib.blake2b(text[a:b].encode("utf-8", "replace"), digest_size=12).digest()
                    if before is not None:
                        found["L", before, token, seed] += 1
                    if after is not None:
                        found["R", after, token, seed] += 1
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                    pa.array([k[2] for k in keys], pa.binary()), pa.array([k[3] for k in keys], pa.bool_()),
                    pa.array(list(found.values()), pa.int64()),
                ],
                names=["side", "word", "token", "seed", "n"],
            )

    kinds = "side string, word string, token binary, seed boolean, n long"
    rows = arrow_map(docs.select(utf8(text_col).alias("_utf8")), read, kinds)
    return stage(rows.groupBy("side", "word", "token", "seed").agg(F.sum("n").alias("n")), "contexts")


def _word_filter(words: DataFrame) -> bytes:
    """``FILTER_BITS`` bits, of which each word sets one: of the same size for any number of words."""
    slot = F.crc32(F.col("word").cast("binary")) % FILTER_BITS
    pages = words.groupBy((slot / _PAGE).cast("int").alias("page")).agg(F.bitmap_construct_agg(slot % _PAGE).alias("bits"))
    bits = bytearray(FILTER_BITS // 8)
    for row in pages.collect():
        at = row.page * _PAGE // 8
        bits[at : at + _PAGE // 8] = row.bits
    return bytes(bits)


def _places(docs: DataFrame, text_col: str, words: DataFrame) -> DataFrame:
    """``word, places``: how many tokens in the corpus each word is; all of ``words``, and a few others."""
    shared = docs.sparkSession.sparkContext.broadcast(_word_filter(words))

    def counted(found):
        bits, kept = shared.value, Counter()
        for token, n in found.items():
            word = _named(token)
            slot = zlib.crc32(word.encode()) % FILTER_BITS
            if bits[slot >> 3] >> (slot & 7) & 1:
                kept[word] += n
        return pa.RecordBatch.from_arrays(
            [pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "places"]
        )

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for raw in batch.column(0):
                found.update(raw.as_py().decode("utf-8", "replace").lower().split())
                if len(found) >= HELD:
                    yield counted(found)
                    found = Counter()
        yield counted(found)

    rows = arrow_map(docs.select(utf8(text_col).alias("_utf8")), count, "word string, places long")
    return rows.groupBy("word").agg(F.sum("places").alias("places"))


def learn_patterns(
    docs: DataFrame, text_col: str = "text", least_seeds: int = LEAST_SEEDS, rounds: int = ROUNDS, threshold: float = THRESHOLD
) -> DataFrame:
    """``side, word, score`` of all patterns that reach ``threshold``.

    A pattern needs ``least_seeds`` different seeds. All its places in all texts count against it, those with ordinary
    words too, so the words around one copied identifier, or common words, make no pattern.
    """
    graph = _graph(docs, text_col)
    pattern = ["side", "word"]
    seeded = graph.filter("seed").groupBy(*pattern).agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= least_seeds)
    seeded = stage(seeded.select(*pattern), "seeded-patterns")
    if seeded.isEmpty():
        return seeded.withColumn("score", F.lit(0.0))
    edges = stage(graph.join(seeded, pattern).join(_places(docs, text_col, seeded), "word"), "pattern-graph")
    trust = edges.groupBy("token").agg(F.max(F.col("seed").cast("double")).alias("trust"))
    for _ in range(rounds):
        scored = edges.join(trust, "token").groupBy(*pattern).agg(
            (F.sum(F.col("n") * F.col("trust")) / F.greatest(F.max("places"), F.sum("n"))).alias("score")
        )
        scored = stage(scored, "pattern-scores")
        # many weak patterns do not add up to trust: only patterns that are mostly right speak for a token
        voice = F.when(F.col("score") >= threshold, F.col("score")).otherwise(0.0)
        trust = edges.join(scored, pattern).groupBy("token").agg(
            F.greatest(F.max(F.col("seed").cast("double")), 1 - F.exp(F.sum(F.log(1 - F.least(voice, F.lit(0.999)))))).alias("trust")
        )
    return scored.filter(F.col("score") >= threshold)


def _in_context(text: str, base: list[tuple[int, int, int]], patterns: set[tuple[str, str]]):
    """(start, end) of tokens that a pattern holds."""
    for a, b, known in _tokens(text, base) if patterns else ():
        if known < _BASE:
            before, after = _neighbours(text, a, b)
            if ("L", before) in patterns or ("R", after) in patterns:
                yield a, b


def all_spans(text: str, patterns: set[tuple[str, str]], earlier: list[int] | None = None) -> tuple[list, list]:
    """(base and discovered spans as (start, end, kind), base spans as ``base_spans`` gives them).

    ``earlier`` has the starts and ends, in turn, of what other patterns have found in the text.
    """
    base = base_spans(text)
    earlier = earlier or []
    found = {*zip(earlier[::2], earlier[1::2], strict=True), *_in_context(text, base, patterns)}
    spans = [(a, b, k, KINDS[k]) for a, b, k in base] + [(a, b, len(KINDS), FOUND) for a, b in found]
    return [(a, b, name) for a, b, _, name in sorted(spans, key=lambda s: (s[0], s[2]))], base


def _decoded(raw: str | bytes | None) -> str:
    return raw.decode("utf-8", "replace") if isinstance(raw, bytes) else raw or ""


def _search(docs: DataFrame, text_col: str, patterns: DataFrame, block: int) -> tuple[DataFrame, str, set[tuple[str, str]]]:
    """``docs`` with a column of what all blocks of patterns but the last have found, its name, and the last block.

    A task holds one block of about ``block`` patterns. As a rule there is only one, and no pass is made here; each
    further block is a pass over all rows, which are written in between.
    """
    spark = docs.sparkSession
    blocks = max(1, -(-patterns.count() // block))
    number = F.pmod(F.xxhash64("side", "word"), F.lit(blocks))

    def members(k):
        return {(r.side, r.word) for r in patterns.filter(number == k).select("side", "word").collect()}

    mark = fresh(docs, "_contexts")
    docs = docs.withColumn(mark, F.lit(None).cast("array<bigint>"))
    for k in range(blocks - 1):
        shared = spark.sparkContext.broadcast(members(k))

        def add(batches, shared=shared):
            for batch in batches:
                marks = []
                for raw, old in zip(batch.column(text_col), batch.column(mark), strict=True):
                    text = _decoded(raw.as_py())
                    found = _in_context(text, base_spans(text), shared.value)
                    marks.append([*(old.as_py() or []), *(x for span in found for x in span)])
                columns = [*batch.columns[:-1], pa.array(marks, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        docs = stage(arrow_map(docs, add, docs.schema), "contexts-found")
    return docs, mark, members(blocks - 1)


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, **learning
) -> DataFrame:
    """``id_col, n_email, n_ip, n_card, n_phone, n_context, base_sha256, spans`` of every row.

    Counts and ``base_sha256`` are of the fixed formats; ``spans`` also has what patterns have found (``context``), as
    ``kind:start:end`` in code points by start and then kind. Null text is empty: no spans. Rows may share ids; equal
    texts have equal spans. Columns of ``docs`` other than the two named do not take part. After the
    patterns are learnt each row is judged alone.
    """
    patterns = learn_patterns(docs, text_col, **learning)
    texts = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("_utf8"))
    texts, _, last = _search(texts, "_utf8", patterns, block)
    shared = docs.sparkSession.sparkContext.broadcast(last)
    id_type = docs.schema[id_col].dataType.simpleString()

    def find(batches):
        known = shared.value
        for batch in batches:
            counts, digest, written = [[0] * batch.num_rows for _ in range(len(KINDS) + 1)], [], []
            for i, (raw, earlier) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                spans, base = all_spans(_decoded(raw.as_py()), known, earlier.as_py())
                for _, _, k in base:
                    counts[k][i] += 1
                counts[-1][i] = len(spans) - len(base)
                digest.append(hashlib.sha256(_written([(a, b, KINDS[k]) for a, b, k in base]).encode()).hexdigest())
                written.append(_written(spans))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *(pa.array(c, pa.int64()) for c in counts),
                    pa.array(digest, pa.string()), pa.array(written, pa.string()),
                ],
                names=["id", *(f"n_{k}" for k in KINDS), "n_context", "base_sha256", "spans"],
            )

    kinds = f"id {id_type}, " + ", ".join(f"n_{k} long" for k in (*KINDS, FOUND)) + ", base_sha256 string, spans string"
    return arrow_map(texts, find, kinds).withColumnRenamed("id", id_col)


def redact(
    docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", block: int = BLOCK, **learning
) -> DataFrame:
    """``docs`` with each span of ``text_col`` replaced by ``<kind>``, and ``length_col``, if there is one, brought up to date.

    Overlapping spans are replaced together, under the kind of the first. Rows without a span do not change at all; null
    texts stay null.
    """
    columns = docs.columns
    docs, found, last = _search(docs, text_col, learn_patterns(docs, text_col, **learning), block)
    shared = docs.sparkSession.sparkContext.broadcast(last)
    mark = fresh(docs, "_redacted")
    schema = docs.select("*").schema.add(mark, "string")

    def cover(batches):
        known = shared.value
        for batch in batches:
            out = []
            for raw, earlier in zip(batch.column(text_col), batch.column(found), strict=True):
                text = raw.as_py()
                spans = all_spans(text, known, earlier.as_py())[0] if text else []
                if not spans:
                    out.append(None)
                    continue
                parts, done = [], 0
                for a, b, kind in spans:
                    if a >= done:
                        parts += [text[done:a], f"<{kind}>"]
                    done = max(done, b)
                out.append("".join([*parts, text[done:]]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, mark]
            )

    covered = arrow_map(docs, cover, schema)
    if length_col in columns:
        kind = docs.schema[length_col].dataType
        covered = covered.withColumn(
            length_col, F.when(F.col(mark).isNotNull(), F.length(mark).cast(kind)).otherwise(F.col(length_col))
        )
    return covered.withColumn(text_col, F.coalesce(F.col(mark), F.col(text_col))).select(columns)

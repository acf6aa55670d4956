"""Language identification by bit-sliced Bloom filters over character n-grams.

One table of slots serves all languages: each slot is a bitmask with a bit for each language, so that
the masks at an n-gram's slots, ANDed, name every language whose filter has the n-gram at once. A text is
decided by the number of its n-grams in each language, less those that a filter of that fill
would have let through by accident.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import arrow_map, fresh, utf8

#: Slots of the filters, probes of an n-gram, lengths of n-grams (with marks at both ends of a word).
SLOTS = 1 << 20
PROBES = 3
SHORTEST, LONGEST = 3, 4
#: Documents of a language that are learnt from, and characters up to which they come first and of each that are read.
TRAIN_PER_LANGUAGE = 1_500
TRAIN_CHARS = 30_000
#: An n-gram belongs to the languages that use it at least this often, relative to the one that uses it most.
SHARE = 0.5
#: An n-gram is learnt if it makes up this share of a language's n-grams.
LEAST_RATE = 2e-6
#: Characters that are looked up together.
BLOCK = 1 << 18
UNKNOWN = "und"
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-case text between two marks; all that is no letter is a mark, 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros(len(points) + 2, np.uint64)
    np.multiply(points, _is_letter()[points], out=out[1:-1], casting="unsafe")
    return out


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams_of_size(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit name for each n-gram that lies in one word, the marks at its ends included."""
    m = len(points) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    inner = points[1 : m + 1] != 0
    for i in range(2, n - 1):
        inner &= points[i : m + i] != 0
    name = np.full(m, n, np.uint64)
    for i in range(n):
        name = name * _K1 + points[i : m + i]
    name = name[inner]
    return name ^ (name >> np.uint64(29))


def slots_of(grams: np.ndarray) -> list[np.ndarray]:
    """The slots of each probe, by double hashing."""
    a = grams * _K2
    b = (a >> np.uint64(32)) | np.uint64(1)
    return [((a >> np.uint64(7)) + np.uint64(k) * b) & np.uint64(SLOTS - 1) for k in range(PROBES)]


@dataclass(frozen=True)
class LanguageFilters:
    languages: list[str]
    masks: np.ndarray  # (slots, bytes) bits of languages
    accident: np.ndarray  # for each language, the share of foreign n-grams that its filter lets through

    def count(self, text: str) -> tuple[np.ndarray, int]:
        """(n-grams of the text in each language's filter, n-grams of the text)."""
        hits, n = np.zeros(len(self.languages), np.int64), 0
        points = letters_of(text)
        for at in range(0, len(points), BLOCK):
            # blocks share the characters of n-grams that begin in the first of them
            for size in range(SHORTEST, LONGEST + 1):
                grams = grams_of_size(points[at : at + BLOCK + size - 1], size)
                n += len(grams)
                slots = slots_of(grams)
                for k in range(self.masks.shape[1]):
                    table = self.masks[:, k]
                    found = table[slots[0]]
                    for s in slots[1:]:
                        found = found & table[s]
                    # one count for each bitmask that came up, then one for each of its bits
                    own = slice(8 * k, 8 * k + 8)
                    hits[own] += (np.bincount(found, minlength=256) @ _BITS)[: len(hits[own])]
        return hits, n

    def decide(self, hits: np.ndarray, n: int) -> tuple[str, float]:
        """Best language and its share of the corrected counts; ties go to the first by name."""
        if not n or not self.languages:
            return UNKNOWN, 0.0
        true = np.maximum(0.0, (hits - n * self.accident) / np.maximum(1e-9, 1 - self.accident))
        best = int(np.argmax(true))
        total = true.sum()
        return self.languages[best], float(true[best] / total) if total else 0.0


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageFilters:
    """Filters from (n-grams, how often each came up) of each language."""
    languages = sorted(counts)
    masks = np.zeros((SLOTS, max(1, -(-len(languages) // 8))), np.uint8)
    if languages:
        gram = np.concatenate([counts[g][0] for g in languages])
        rate = np.concatenate([counts[g][1] / max(1, counts[g][1].sum()) for g in languages])
        owner = np.repeat(np.arange(len(languages)), [len(counts[g][0]) for g in languages])
        names, place = np.unique(gram, return_inverse=True)
        most = np.zeros(len(names))
        np.maximum.at(most, place, rate)
        for i in range(len(languages)):
            own = (owner == i) & (rate >= SHARE * most[place]) & (rate >= LEAST_RATE)
            for slots in slots_of(gram[own]):
                masks[slots, i // 8] |= np.uint8(1 << (i % 8))
    bits = np.unpackbits(masks, axis=1, bitorder="little", count=max(1, len(languages)))
    return LanguageFilters(languages, masks, bits.mean(axis=0)[: len(languages)] ** PROBES)


def learn(
    docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = TRAIN_PER_LANGUAGE,
) -> LanguageFilters:
    """Filters from at most ``per_language`` documents of each language, chosen by a hash of the id.

    Texts of up to ``TRAIN_CHARS`` characters come first; a language with too few of them is filled up with the beginnings
    of longer ones. Rows without text or language are not learnt from. N-grams are counted in Spark; the driver gets
    those of the bounded sample.
    """
    rows = docs.filter(allowed).filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    long = F.length(text_col) > TRAIN_CHARS
    slim = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), long.alias("long"))
    slim = slim.groupBy("id", "lang").agg(F.min("long").alias("long"))
    languages = [r.lang for r in slim.select("lang").distinct().collect()]
    chosen = []
    for g in sorted(languages):
        chosen += slim.filter(F.col("lang") == g).orderBy("long", F.xxhash64("id"), "id").limit(per_language).collect()
    if not chosen:
        return build({})
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r.id, r.lang) for r in chosen], slim.select("id", "lang").schema)
    same = F.col("d_id").eqNullSafe(F.col("id")) & (F.col("d_lang") == F.col("lang"))
    begun = F.substring(text_col, 1, TRAIN_CHARS).alias("text")
    texts = rows.select(F.col(id_col).alias("d_id"), F.col(lang_col).alias("d_lang"), begun, long.alias("long"))
    # an id that many rows share gives one of its texts, a short one if there is any
    one = F.coalesce(F.min(F.when(~F.col("long"), F.col("text"))), F.min("text"))
    sample = texts.join(F.broadcast(ids), same).groupBy("id", "lang").agg(one.alias("text"))

    def count(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            for lang in sorted(set(names)):
                own = [t for g, t in zip(names, batch.column(1).to_pylist(), strict=True) if g == lang]
                points = letters_of("\n".join(own))
                grams = np.concatenate([grams_of_size(points, n) for n in range(SHORTEST, LONGEST + 1)])
                gram, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)],
                    names=["lang", "gram", "n"],
                )

    grams = arrow_map(sample.select("lang", "text"), count, "lang string, gram long, n long")
    total = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()
    lang = np.array(total.column("lang").to_pylist(), dtype=object)
    gram, n = total.column("gram").to_numpy().view(np.uint64), total.column("n").to_numpy()
    return build({g: (gram[lang == g], n[lang == g]) for g in sorted(set(lang.tolist()))})


def identify(docs: DataFrame, filters: LanguageFilters, extra: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``extra`` of ``docs`` with ``lang_pred`` and ``score`` of every whole text.

    Null texts and texts without a letter are ``und`` with score 0. The result depends on the text only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    schema = docs.select(*extra).schema
    schema.add("lang_pred", "string").add("score", "double")

    def decide(batches):
        model = shared.value
        for batch in batches:
            best, scores = [], []
            for raw in batch.column(batch.num_columns - 1):
                lang, s = model.decide(*model.count(raw.as_py().decode("utf-8", "replace")))
                best.append(lang)
                scores.append(s)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(best, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return arrow_map(docs.select(*extra, utf8(text_col).alias(fresh(docs, "_utf8"))), decide, schema)

"""Prefix tree, n-gram quality model and token alignment over awkward rows, against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from coppice.llm import alignment, prefix_tree, wordgrams
from coppice.llm.queries import QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, depth long, key string, node string"
DOCS = "doc_id long, text string, lang string, id long, chunk long, n_a string, score string, _utf8 string"


# ---------------------------------------------------------------- prefix tree


def _tree(rows, family=20, most=3):
    """The result of the operator, by dictionaries of whole prefixes."""

    def key(role, text):
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]

    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, key(role or "", text or ""), text or ""))
    own = {c: [(k, t) for *_, k, t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        paths[c] = own.get(c - int(math.fmod(c, family)), [])[:h] + turns[h:]
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), set()).add(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, convs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(convs) - 1) * len(WORDS.findall(p[-1][1])) if p else 0
    return sorted(
        (
            min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), children[p], leaves[p], saved[p],
            hashlib.sha256(",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(p)).encode()).hexdigest(),
        )
        for p, convs in members.items()
    )


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(3)
    lines = [None, "", "yes", "no no", "tell me more", "  spaced\tout\n", "é à", "a " * 50]
    rows = []
    for c in [*range(0, 90), *range(200, 215), -7, -20, 10**12, 10**12 + 3]:
        rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(lines)) for t in range(rng.randint(1, 6))]
    hello = [(0, "user", "hello there"), (1, "bot", "how can I help"), (2, "user", "you can not")]
    for c in range(1000, 1400):  # one conversation many times, with longer versions of it
        rows += [(c, *t) for t in hello] + [(c, 3 + k, "bot", "and so on") for k in range(c % 40 == 0)]
    rows += [(2000, t, "user", f"turn {t % 7}") for t in range(300)]  # a long one and one that leaves it late
    rows += [(2020, t, "user", f"turn {t % 7}" if t < 250 else "else") for t in range(280)]
    rows += [(3001, None, "user", "first"), (3001, None, None, None), (3001, 5, "user", "x"), (3001, 5, "user", "x")]
    rows += [(3001, 5, "bot", "tie"), (3001, 5, "user", "tie"), (None, 1, "user", "lost"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("shard_turns", "fan_in"), [(10**6, 64), (60, 3), (400, 64)])
def test_tree_equals_dictionaries_of_prefixes(spark, turns, monkeypatch, shard_turns, fan_in):
    monkeypatch.setattr(prefix_tree, "FAN_IN", fan_in)
    df = spark.createDataFrame([(*r, 1, "k", "n") for r in turns], TURNS).repartition(5)
    found = sorted((tuple(r) for r in prefix_tree.prefix_tree(df, shard_turns=shard_turns).collect()), key=lambda r: r[:2])
    assert found == sorted(_tree(turns), key=lambda r: r[:2])


def test_tree_of_no_conversations(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_tree.prefix_tree(empty).collect() == []
    lost = spark.createDataFrame([(None, 1, "user", "x", 1, "k", "n")], TURNS)
    assert prefix_tree.prefix_tree(lost).collect() == []


def test_members_are_hashed_in_parts(spark):
    rng = random.Random(4)
    rows = [(b"a", i) for i in rng.sample(range(-50, 10**6), 3000)] + [(b"b", 7), (b"c", 2), (b"c", -1)]
    found = prefix_tree.member_hashes(spark.createDataFrame(rows, "name binary, conv long"), part_ids=20).collect()
    for name in (b"a", b"b", b"c"):
        ids = sorted(i for n, i in rows if n == name)
        wanted = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert [r.ends for r in found if bytes(r.name) == name] == [wanted]


def test_ternary_tree_is_balanced_and_finds_what_it_holds():
    tree = prefix_tree.TernaryTree()
    paths = {}
    for k in prefix_tree.middle_first(1023):
        paths[k] = tree.insert([k, 5])
    assert all(tree.insert([k, 5]) == p for k, p in paths.items())
    depth = {tree.top: 1}
    for at in sorted(p[0] for p in paths.values()):
        for side in (tree.low[at], tree.high[at]):
            if side >= 0:
                depth[side] = depth[at] + 1
    assert max(depth.values()) == 10
    assert sorted(prefix_tree.middle_first(10)) == list(range(10)) and list(prefix_tree.middle_first(0)) == []


# ---------------------------------------------------------------- quality by word n-grams


def _plain_grams(text):
    """Counts of n-grams of tokens, by groups of characters."""
    out, seen, last = [], set(), None
    for line in text.split("\n"):
        row = []
        for kind, run in itertools.groupby(line, lambda c: 2 if c.isalnum() else 0 if c.isspace() else c):
            if kind != 0:
                row.append("".join(run))
        marked = []
        for t in row:
            marked.append("<again>" if t == last else t)
            last = t
        if row and tuple(row) in seen:
            marked[0] = "<line again>"
        seen.add(tuple(row))
        out += marked
    return Counter([(t,) for t in out] + list(zip(out, out[1:], strict=False)))


TEXTS = [
    "one two two two three!! --- ok", "a b\na b\nc\na b", "", " \n\t ", "É é!é 12 12 x", "same same\nsame same", "x" * 400,
    "line of words\n" * 30, "* * * ** a", "end.\n.end",
]


@pytest.mark.parametrize("text", TEXTS)
def test_features_are_the_counted_n_grams(text):
    at, values = wordgrams.features(text)
    counts = sorted(1 + math.log(n) for n in _plain_grams(text).values())
    norm = math.sqrt(sum(c * c for c in counts)) or 1
    assert len(set(at.tolist())) == len(at) and np.allclose(sorted(values.tolist()), [c / norm for c in counts], atol=1e-6)


def test_features_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(5)
    text = "\n".join(" ".join(rng.choice("the of and ## no, yes it".split()) for _ in range(rng.randint(0, 9))) for _ in range(400))
    whole = wordgrams.features(text)
    monkeypatch.setattr(wordgrams, "BLOCK", 64)
    parts = wordgrams.features(text)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])


def test_training_equals_plain_ftrl():
    rng = random.Random(6)
    words = "good fine bad worse the of".split()
    texts = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(60)]
    labels = [int(t.count("good") + t.count("fine") > t.count("bad") + t.count("worse")) for t in texts]
    examples = [wordgrams.features(t) for t in texts]
    model = wordgrams.fit(examples, labels, rounds=2, seed=1)
    order, shuffled = np.arange(len(texts)), np.random.default_rng(1)
    z, n = Counter(), Counter()

    def weight(i):
        l1 = 0.0 if i == "bias" else wordgrams.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((wordgrams.BETA + math.sqrt(n[i])) / wordgrams.ALPHA + wordgrams.L2)

    for _ in range(2):
        shuffled.shuffle(order)
        for k in order.tolist():
            row = {**dict(zip(examples[k][0].tolist(), examples[k][1].tolist(), strict=True)), "bias": 1.0}
            w = {i: weight(i) for i in row}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in row.items())))
            for i, x in row.items():
                g = (p - labels[k]) * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / wordgrams.ALPHA * w[i]
                n[i] += g * g
    assert math.isclose(model.bias, weight("bias"), abs_tol=1e-6)
    for i in {i for at, _ in examples for i in at.tolist()}:
        assert math.isclose(model.weights[i], weight(i), abs_tol=1e-5)
    assert (model.weights[[i for i in range(1000) if i not in z]] == 0).all()


def test_quality_of_held_out_texts(spark):
    rng = random.Random(7)

    def prose(marks):
        words = "the of and to in on at by an it is was for with from".split()
        return " ".join(rng.choice(words) + rng.choice(["", "ing", "s"]) + (rng.choice(marks) if marks else "") for _ in range(60))

    texts = [prose(["##", "%%%", "&&"]) if i % 4 == 0 else prose("") for i in range(240)]
    rows = [(i, t, "en", i, 1, "x", "y", "u") for i, t in enumerate(texts)] + [(None, None, None, 1, 1, "x", "y", "u")] * 2
    rows += [(3, texts[4], "en", 1, 1, "x", "y", "u")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame(
        [(i, int(i % 4 != 0)) for i in range(240)] + [(1, 0), (None, 1), (5000, 1), (2, None), (6, 7)], "doc_id long, quality int"
    )
    model = wordgrams.learn(docs, labels, labels.doc_id % 3 != 1)
    assert model.trained
    found = wordgrams.quality_scores(docs, model, ["doc_id", "lang"]).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id % 3 == 1]
    assert all((r.score >= 0.5) == (r.doc_id % 4 != 0) for r in held)
    assert len({r.score for r in found if r.doc_id is None}) == 1
    only = wordgrams.learn(docs, labels.filter("quality = 1"), labels.doc_id >= 0)
    assert not only.trained and only.score("anything") > 0.9
    nothing = wordgrams.learn(docs, labels.limit(0), labels.doc_id >= 0)
    assert not nothing.trained and nothing.score("x") == 0.5
    assert wordgrams.quality_scores(docs.limit(0), model, ["doc_id"]).collect() == []


def test_sample_keeps_its_bound_and_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(wordgrams, "TRAIN_FEATURES", 50)
    taken = []
    monkeypatch.setattr(wordgrams, "fit", lambda examples, labels: taken.append((examples, list(labels))))
    texts = [" ".join(f"w{i}x{k}" for k in range(20)) for i in range(12)] + [" ".join(f"long{k}" for k in range(900))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 12)) for i in range(13)], "doc_id long, quality int")
    wordgrams.learn(docs, labels, labels.doc_id >= 0)
    (examples, marks), = taken
    assert marks.count(1) == 1 and marks.count(0) == 1
    short, long = sorted(len(at) for at, _ in examples)
    assert short == 39 and 1780 < long <= 1799  # a few n-grams share a bucket


# ---------------------------------------------------------------- alignment of tokenizers


def _paths():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _aligned(texts):
    """(n_a, n_b, groups, id pairs of links) of each text, by both libraries and sets of byte ranges."""
    path_a, path_b = _paths()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    signs = alignment._byte_of_sign()
    out = []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(signs[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [
            bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, b.id_to_piece(i)) for i in ids_b)
        ]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
            out.append((0, 0, [], []))
            continue
        ranges = []
        for parts in (bytes_a, bytes_b):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            ranges.append(list(zip([0, *ends], ends, strict=False)))
        common = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        cut = [
            ([ids_a[i] for i, (_, e) in enumerate(ranges[0]) if low < e <= high], [ids_b[i] for i, (_, e) in enumerate(ranges[1]) if low < e <= high])
            for low, high in zip([0, *common], common, strict=False)
        ]
        pairs = [(ids_a[i], ids_b[j]) for i, (s, e) in enumerate(ranges[0]) for j, (u, v) in enumerate(ranges[1]) if s < v and u < e]
        out.append((len(ids_a), len(ids_b), cut, pairs))
    return out


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(8)
    bits = [
        "a", "the ", " ", "  ", "\n", "\t", "\n\n", "\r\n", "É", "é", "ß", "'s", "12", "3", "!", "...", "<s>", "<|endoftext|>", "<0x41>", "▁",
        "中", "😀", "\x00", "\x1f", "　", "ing ", " of", "|", "_", "é", " ", "ﬁ", "\xa0", "İ", "ą",
    ]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(250)]
    return [*texts, None, "", " ", "\n", "the the the", "the the the", "word " * 300, "x" * 3000, " lead", "trail ", "a\r\nb"]


def test_alignment_equals_overlapping_ranges(spark, odd_texts):
    rows = [(i if i % 9 else None, t, "en", 1, 2, "a", "s", "u") for i, t in enumerate(odd_texts)] + [(5, odd_texts[5], "x", 1, 2, "a", "s", "u")] * 3
    texts = [r[1] for r in rows]
    plain = _aligned(texts)
    counts = Counter(p for *_, pairs in plain for p in pairs)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    wanted = Counter()
    for row, (n_a, n_b, cut, pairs) in zip(rows, plain, strict=True):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in cut)
        wanted[
            row[0], n_a, n_b, len(cut), len(pairs), sum(counts[p] == highest[p[1]] for p in pairs), sum(counts[p] for p in pairs),
            hashlib.sha256(written.encode()).hexdigest() if cut else "",
        ] += 1
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for chunk_bytes in (200, 1 << 20):
        found = Counter(tuple(r) for r in alignment.alignment(docs, *_paths(), chunk_bytes=chunk_bytes).collect())
        assert found == wanted
    assert alignment.alignment(docs.limit(0), *_paths()).collect() == []


def test_words_are_aligned_as_whole_texts_are(odd_texts):
    one, whole = alignment.Aligner(*_paths()), alignment.Aligner(*_paths())
    assert one.wordwise
    whole.wordwise = False
    for text in odd_texts:
        (n, pairs, written), (m, others, again) = one.align(text or ""), whole.align(text or "")
        assert n == m and written == again and pairs.tolist() == others.tolist()


def test_aligner_forgets_words_beyond_its_bound(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED_BYTES", 5_000)
    one = alignment.Aligner(*_paths())
    for k in range(50):
        one.align(" ".join(f"word{k}x{i}" for i in range(10)))
        assert one.bytes < 5_000 + 10 * 600


# ---------------------------------------------------------------- contracts of the queries


def _remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


@pytest.mark.parametrize(
    ("name", "modulus", "held", "columns"),
    [
        ("op5_language_filters", 4, 2, {"lang_pred": "string", "score": "double"}),
        ("op9_subword_toxicity", 5, 0, {"score": "double", "predicted": "int"}),
        ("op12_ftrl_quality", 3, 1, {"score": "double", "predicted": "int"}),
    ],
)
def test_learnt_queries_mark_what_they_did_not_learn_from(spark, name, modulus, held, columns):
    df = QUERIES[name](spark, SF)
    assert {"doc_id": "bigint", "held_out": "boolean", **columns}.items() <= dict(df.dtypes).items()
    rows = df.collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    assert all(r.held_out == (_remainder(r.doc_id, modulus) == held) and 0 <= r.score <= 1 for r in rows)
    if "predicted" in columns:
        assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_rules_and_packing_queries_keep_their_contracts(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op7_line_field"](spark, SF).collect():
        words = WORDS.findall(docs[r.doc_id])
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
        lines, earlier = 0, set()
        for line in docs[r.doc_id].split("\n"):
            if WORDS.search(line):
                lines += line in earlier
                earlier.add(line)
        signs = sum(c in "#*$%&|<>" for c in docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), signs, lines, len(inside)
        )
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        assert r.base_failed == failed and not (failed and r.kept)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in QUERIES["op10_best_fit"](spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert set(pieces) == set(docs)
    for doc_id, found in pieces.items():
        ids = [*tokenizer.encode(docs[doc_id], add_special_tokens=False).ids, 1]
        assert sorted(found) == [
            (p, at, len(part := ids[at : at + 4096]), zlib.crc32(np.array(part, "<u4").tobytes()))
            for p, at in enumerate(range(0, len(ids), 4096))
        ]

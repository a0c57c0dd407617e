"""Alignment, byte-level BPE and ranked search against plain versions."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from factorloom.llm import alignment, byte_bpe, lexical
from factorloom.llm.texts import blank_parts

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MARKS = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "1", "漢", "՘", "\x1c", "\xa0", "!", "the", " the ", "▁", "İ", "̀",
         "<|endoftext|>", "</s>", "<unk>", "\x85", " ", "\U0001f600", "\x00"]
ODD = ["", None, " ", "  a", "a ", "a  b", "\na \n b", "a▁b", "x" * 3000, "ab" * 900, "word " * 4000, "DON'T", "same one", "same one"]
SCHEMA = "doc_id long, text string, ids string, k0 int, bag int, chunk int, item int"


@pytest.fixture(scope="module")
def docs(spark, folder):
    rows = [(-i - 1, t, "i", 0, 1, 2, 3) for i, t in enumerate(ODD)] + [(None, "no id", "i", 0, 1, 2, 3), (2**62 + 1, "far id", "i", 0, 1, 2, 3)]
    extra = [F.lit("i").alias("ids"), *[F.lit(i).alias(c) for i, c in enumerate(["k0", "bag", "chunk", "item"])]]
    real = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", *extra)
    return real.unionByName(spark.createDataFrame(rows, SCHEMA)).checkpoint()


def some_texts(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choices(MARKS, k=draw.randint(0, 10))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return byte_bpe.ByteBpe(RANKS, PATTERN, byte_bpe.foreign_letters(PATTERN))


def test_ids_equal_the_library(own, library):
    texts = some_texts(4000, 1) + [t for t in ODD if t]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert own.decode(ids.tolist()) == text.encode()


def test_letters_of_other_unicode_versions(own, library):
    strange = sorted(byte_bpe.foreign_letters(PATTERN))
    texts = [f"a{chr(c)}b 1{chr(c)} {chr(c)}" for c in strange[::50]] + [f"a{chr(c)}1 {chr(c)}" for c in range(0xA0, 0x3000)]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text), repr(text)


def test_very_long_matches(own, library):
    draw = random.Random(3)
    for text in ["a" * 60_000, "".join(draw.choices("abcdefgh", k=60_000)), "ab" * 20_000 + " " * 5000, "é" * 9000]:
        assert own.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_shared_queue_equals_a_queue_of_its_own(own):
    draw = random.Random(4)
    matches = list({"".join(draw.choices("abcé ", k=draw.randint(1, 40))).encode() for _ in range(500)})
    own.merged(set())
    together = byte_bpe.merge_many(matches, own._one, own._pairs, own._bits)
    for match, ids in zip(matches, together):
        assert np.frombuffer(ids, "<i4").tolist() == byte_bpe.merge(match, own.ranks, own._bits)
    assert not own._bits


def test_rank_bits_give_the_lowest():
    bits, held = byte_bpe.RankBits(70_000), set()
    draw = random.Random(5)
    for _ in range(3000):
        rank = draw.randrange(70_000)
        if rank in held and draw.random() < 0.7:
            held.discard(rank)
            bits.clear(rank)
        else:
            held.add(rank)
            bits.mark(rank)
        assert bits.lowest() == min(held)
    while held:
        bits.clear(bits.lowest())
        held.discard(min(held))
    assert not bits


def test_known_parts_are_bounded(library, monkeypatch):
    own = byte_bpe.ByteBpe(RANKS, PATTERN, {})
    monkeypatch.setattr(own, "ENTRIES", 10)
    for i in range(5):
        texts = [f"word{i} and word{i * 7} others {j}" for j in range(9)]
        assert [x.tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]
        assert len(own._known) <= 10


def hashed(x):
    return hashlib.sha256(x).hexdigest()


def test_round_trip_of_a_table(docs, library):
    want = Counter()
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashed(" ".join(map(str, ids)).encode()), hashed((r["text"] or "").encode())] += 1
    assert Counter(map(tuple, byte_bpe.round_trip(docs, RANKS, PATTERN).collect())) == want
    encoded = byte_bpe.encode(docs, RANKS, PATTERN, keep=("doc_id", "bag"))
    decoded = byte_bpe.decode(encoded, RANKS, PATTERN, keep=("doc_id", "bag"))
    assert encoded.columns == ["doc_id", "bag", "ids"] and decoded.columns == ["doc_id", "bag", "decoded"]
    got = Counter((r["doc_id"], bytes(r["decoded"])) for r in decoded.collect())
    assert got == Counter((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect())
    none = docs.where("false")
    assert byte_bpe.round_trip(none, RANKS, PATTERN).collect() == [] and byte_bpe.encode(none, RANKS, PATTERN).collect() == []


# ---- alignment ----


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(A, B)


def spans(ids, bytes_of):
    out, at = [], 0
    for i in ids.tolist():
        out.append((at, at := at + len(bytes_of[i]), i))
    return out


def plain_alignment(pair, text):
    """Token pairs that overlap, groups as text, and counts, by looking at every span."""
    found = pair.tokens(text) if text else None
    if found is None:
        return (0,) * 5, "", []
    a, b = spans(found[0], pair.a_bytes), spans(found[1], pair.b_bytes)
    links, first = [], 0
    for start, end, i in a:
        while b[first][1] <= start:
            first += 1
        at = first
        while at < len(b) and b[at][0] < end:
            links.append((i, b[at][2]))
            at += 1
    cuts = sorted({x[1] for x in a} & {x[1] for x in b})
    ga, gb = ([[str(i) for s, e, i in side if lo < e <= hi] for lo, hi in zip([0, *cuts], cuts)] for side in (a, b)) if len(a) < 300 else (None, None)
    groups = None if ga is None else ";".join(",".join(x) + "|" + ",".join(y) for x, y in zip(ga, gb))
    shared = None if ga is None else sum(len(x) * len(y) for x, y in zip(ga, gb))
    return (len(a), len(b), len(cuts), len(links), shared), groups, links


def test_parts_align_like_whole_texts(pair):
    texts = some_texts(3000, 6) + ODD
    for text, (counts, digest, codes) in zip(texts, pair.digests(texts)):
        want, groups, links = plain_alignment(pair, text)
        assert tuple(counts.tolist())[:4] == want[:4], repr(text)
        if groups is not None:
            assert counts[4] == want[4] and digest == (hashed(groups.encode()) if groups else "")
        got = np.frombuffer(codes, pair.code).tolist()
        assert [(x % len(pair.a_bytes), x // len(pair.a_bytes)) for x in got] == links


def test_products_equal_dense_ones(monkeypatch):
    rng = np.random.default_rng(7)
    for cells in (3, 1000):
        monkeypatch.setattr(alignment, "CELLS", cells)
        one, two = (rng.random((6, 9)) < 0.4).astype(int), (rng.random((9, 5)) < 0.4) * rng.integers(1, 4, (9, 5))

        def csr(m):
            return alignment.Csr(np.r_[0, np.cumsum((m != 0).sum(1))], np.nonzero(m)[1], m[m != 0], m.shape[1])

        made = csr(one) @ csr(two)
        dense = np.zeros((6, 5), int)
        for i in range(6):
            own = slice(made.indptr[i], made.indptr[i + 1])
            dense[i, made.indices[own]] = made.values[own]
        assert (dense == one @ two).all()
        back = csr(two).transposed()
        assert back.rows == 5 and sorted(back.values.tolist()) == sorted(two[two != 0].tolist())
    links = alignment.overlap_links(np.array([2, 5, 6]), np.array([3, 6]))
    assert links.indices.tolist() == [0, 0, 1, 1] and links.values.tolist() == [2, 1, 2, 1]
    assert alignment.group_links(np.array([2, 5, 6]), np.array([2, 3, 6])).indices.tolist() == [0, 1, 2, 1, 2]


def test_counts_of_a_table(docs, pair, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 5000)
    monkeypatch.setattr(alignment, "SLICE_PAIRS", 500)
    rows = docs.collect()
    plain = [plain_alignment(pair, r["text"]) for r in rows]
    corpus = Counter(x for _, _, links in plain for x in links)
    most = Counter()
    for (_, b), n in corpus.items():
        most[b] = max(most[b], n)
    want = Counter()
    for r, (counts, _, links) in zip(rows, plain):
        best = sum(corpus[x] == most[x[1]] for x in links)
        want[(r["doc_id"], *counts[:4], best, sum(corpus[x] for x in links))] += 1
    got = alignment.aligned_counts(docs, A, B).collect()
    assert Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) for r in got) == want
    assert alignment.aligned_counts(docs.where("false"), A, B).collect() == []


def test_spans_and_links_of_documents(docs, pair):
    some = docs.where("doc_id between -10 and 3")
    by_id = {r["doc_id"]: r for r in some.collect()}
    for r in alignment.alignments(some, A, B).collect():
        counts, _, links = plain_alignment(pair, by_id[r["doc_id"]]["text"])
        assert (len(r["a_ids"]), len(r["b_ids"]), len(r["group_ends"]), len(r["link_a"])) == counts[:4]
        assert [(r["a_ids"][i], r["b_ids"][j]) for i, j in zip(r["link_a"], r["link_b"])] == links
        if r["a_ends"]:
            assert r["a_ends"][-1] == r["b_ends"][-1] == sum(r["link_bytes"]) == len(by_id[r["doc_id"]]["text"].encode()) + 1


def test_parts_give_the_text_back():
    for text in some_texts(2000, 8):
        parts = blank_parts(text)
        assert " ".join(parts) == text
        assert all(p and not p[0].isspace() and not q.endswith(" ") for p, q in zip(parts[1:], parts))


# ---- ranked search ----


def plain_search(docs, items, k):
    cut = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower()) if t else []
    bags = [(d, Counter(cut(t))) for d, t in docs if cut(t)]
    n, length = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(cut(text))
    out = set()
    for item, terms in wanted.items():
        found = []
        for d, c in bags:
            m = 50 + (50 * sum(c.values()) * n) // length
            score = sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out |= {(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k])}
    return out


ITEMS = [(1, "Same one"), (1, "far"), (None, "the of no id"), (2, None), (3, ""), (4, "zzzz qqqq"), (5, "WORD, word! é"), (6, "a")]


@pytest.mark.parametrize("block", [1024, 2])
def test_search_equals_plain_scoring(spark, docs, monkeypatch, block):
    monkeypatch.setattr(lexical, "ITEMS", block)
    monkeypatch.setattr(lexical, "CELLS", 50)
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, rank int")
    copies = docs.unionAll(docs.where("doc_id < 5"))
    got = lexical.search(copies, items, k=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = [(r["doc_id"], r["text"]) for r in copies.collect()]
    found = [tuple(r) for r in got.collect()]
    assert set(found) == plain_search(rows, ITEMS, 7) and len(found) == len({x[:2] for x in found})


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(docs.where("false"), items).collect() == []
    assert lexical.search(docs, items.where("false")).collect() == []
    assert lexical.search(docs, items.where("item_id in (2, 3, 4)")).collect() == []


def test_exact_sums_beyond_doubles():
    rng = np.random.default_rng(8)
    term, item = rng.integers(0, 5, 12), rng.integers(0, 3, 12)
    weight = rng.integers(1, 9, 5) << 40
    scorer = lexical.Scorer(term, item, weight, 3)
    assert not scorer._exact
    bag = np.array([[t, t + 1] for t in range(5)], "<u4").tobytes()
    want = [sum(int(weight[t]) * ((10**9 * (t + 1)) // (1000 * (t + 1) + 1400)) for t, j in zip(term, item) if j == i) for i in range(3)]
    assert scorer.of(np.array([70]), [bag])[0].tolist() == want

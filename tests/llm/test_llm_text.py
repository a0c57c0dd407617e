"""Packing, mixing, scoring and near-duplicates against plain versions."""

import math
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factorloom.llm import lm_scoring, mixing, neardup, packing

WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, piece string, size int, start int"


@pytest.fixture(scope="module")
def plain_tokenizer():
    made = Tokenizer.from_file(WORDS)
    made.encode_special_tokens = True
    return made


ODD = ["", None, "a" * 5000, "word " * 9000, "Don't stop, I've 's.", "ΟΔΟΣ Σίσυφος. é, ä.", "<|endoftext|> x", "\tTab nbsp\x1cfs", "same", "same"]


@pytest.fixture(scope="module")
def docs(spark, folder):
    odd = [(-i - 1, t, None, None if i % 2 else "src0", None, "p", 1, 2) for i, t in enumerate(ODD)] + [(None, "lost", None, None, None, None, None, None)]
    real = spark.read.parquet(f"{folder}/documents.parquet").select("*", F.lit("q").alias("piece"), F.lit(1).alias("size"), F.lit(2).alias("start"))
    return real.unionByName(spark.createDataFrame(odd, DOCS))


def test_pieces_equal_the_tokenizer(docs, plain_tokenizer):
    pieces = packing.stored_pieces(docs, WORDS).collect()
    got = {}
    for r in sorted(pieces, key=lambda r: r["piece"]):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == r["piece"] * 2048 and r["length"] == len(ids) <= 2048
        got.setdefault(r["doc_id"], []).extend(ids)
    for r in docs.collect():
        assert got[r["doc_id"]] == plain_tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]


def test_packing_is_gapless_and_tight(docs):
    pieces = packing.stored_pieces(docs.unionAll(docs), WORDS)
    places = packing.pack(pieces)
    rows = pieces.join(places, "piece_id").collect()
    assert len(rows) == pieces.count()
    by = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 2048
    assert len(by) <= math.ceil(sum(by.values()) / 2048 * 1.02) + 1
    whole = {r["sequence_id"]: r for r in packing.sequences(pieces, places).collect()}
    assert {k: len(r["ids"]) // 4 for k, r in whole.items()} == by
    for r in rows:
        assert whole[r["sequence_id"]]["ids"][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]
    assert packing.pack(packing.stored_pieces(docs.where("false"), WORDS)).collect() == []


def test_merging_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "BINS_PER_TASK", 20)
    rng = np.random.default_rng(1)
    items = [(i, int(n)) for i, n in enumerate(rng.integers(1, 60, 900))] + [(10_000 + i, 60) for i in range(200)]
    df = spark.createDataFrame(items, "piece_id long, length long").repartition(16)
    df = spark.createDataFrame(df.toPandas())
    places = packing.pack(df, size=100).join(df, "piece_id").collect()
    assert len(places) == len(items)
    by = Counter()
    for r in sorted(places, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by[r["sequence_id"]]
        by[r["sequence_id"]] += r["length"]
    assert max(by.values()) <= 100 and len(by) <= 1.05 * sum(by.values()) / 100 + 1


def test_best_fit_equals_plain_search():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = rng.integers(1, 40, 60)
        bins = []
        for i in np.argsort(-n, kind="stable").tolist():
            fits = [b for b in bins if sum(n[j] for j in b) + n[i] <= 50]
            if fits:
                max(fits, key=lambda b: sum(n[j] for j in b)).append(i)
            else:
                bins.append([i])
        assert sorted(sum(n[j] for j in b) for b in packing.best_fit(n, 50)) == sorted(sum(n[j] for j in b) for b in bins)


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        share = sum(weight[s] for s in order if s not in stopped)
        over = {s for s in order if s not in stopped and rest * weight[s] / share > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in stopped else rest * weight[s] / share for s in order}
        stopped |= over


def test_mixing_targets_and_copies(docs, monkeypatch):
    rows = docs.collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    sums = Counter()
    for r in rows:
        sums[r["source"]] += size[r["doc_id"]]
    want = plain_targets(dict(sums))
    got = {r["doc_id"]: r for r in mixing.copies(docs).collect()}
    taken = Counter()
    for r in rows:
        out = got[r["doc_id"]]
        assert out["size"] == size[r["doc_id"]] and out["source_size"] == sums[r["source"]]
        assert out["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert 0 <= out["copies"] <= 3 and abs(out["copies"] - out["target"] / max(1, out["source_size"])) < 1
        taken[r["source"]] += out["copies"] * out["size"]
    largest = {s: max(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sums}
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sums)
    again = {r["doc_id"]: r["copies"] for r in mixing.copies(docs.repartition(3)).collect()}
    assert again == {i: r["copies"] for i, r in got.items()}
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)  # many sources meet salted rows
    assert again == {r["doc_id"]: r["copies"] for r in mixing.copies(docs).collect()}


def test_mix_emits_whole_rows(docs):
    mixed = mixing.mix(docs.unionAll(docs))
    assert mixed.columns == docs.columns
    wanted = mixing.copies(docs.unionAll(docs), identity=docs.columns).groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0")
    assert sorted(map(tuple, mixed.groupBy("doc_id").count().collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)
    assert mixing.mix(docs.where("false")).collect() == [] and mixing.copies(docs.where("false")).collect() == []


def test_cross_entropy_difference(spark, docs, plain_tokenizer, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK", 2000)
    goal = spark.createDataFrame([(1, "the cat sat"), (2, None), (3, "the cat")], "item_id long, text string")
    some = docs.where("doc_id < 40 or doc_id is null")
    got = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(some, goal, WORDS).collect()}
    size = plain_tokenizer.get_vocab_size()

    def model(texts):
        pairs, before, single = Counter(), Counter(), Counter()
        for t in texts:
            ids = plain_tokenizer.encode(t or "", add_special_tokens=False).ids
            for u, w in zip([None, *ids], ids):
                pairs[u, w] += 1
                before[u] += 1
                single[w] += 1
        total = sum(single.values())
        return lambda u, w: -math.log(
            (pairs[u, w] + lm_scoring.PRIOR * (single[w] + 1 / size) / (total + 1)) / (before[u] + lm_scoring.PRIOR)
        )

    rows = some.collect()
    far, near = model([r["text"] for r in rows]), model([r["text"] for r in goal.collect()])
    assert len(got) == len(rows)
    for r in rows:
        ids = plain_tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        out = got[r["doc_id"]]
        assert out["tokens"] == len(ids)
        if ids:
            want = sum(near(u, w) - far(u, w) for u, w in zip([None, *ids], ids)) / len(ids)
            assert out["score"] == pytest.approx(want, abs=1e-5)
        else:
            assert out["score"] is None
    assert lm_scoring.cross_entropy_difference(docs.where("false"), goal, WORDS).collect() == []


def shingled(text):
    words = text.lower().split()
    seen = Counter()
    out = []
    for i in range(max(1, len(words) - 4)):
        s = tuple(words[i : i + 5])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def common_run(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(best[j + 1], row[j]))
        best = row
    return best[-1]


def near_copies(rng, words, n):
    base = [words[i] for i in rng.integers(0, len(words), 120)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.integers(0, 3)):
            at = rng.integers(0, len(copy))
            copy[at : at + 1] = [] if rng.random() < 0.5 else [str(rng.integers(1e9)), "new"]
        yield " ".join(copy)


@pytest.fixture(scope="module")
def copies(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    texts = [t for _ in range(6) for t in near_copies(rng, words, 12)]
    hot = next(near_copies(rng, words, 1))
    texts += [hot] * 40 + [hot.upper() + "  "] + list(near_copies(rng, words, 30)) + ["", "  ", "one two", "One  two", "x y z a b"]
    texts += [" ".join(rng.permutation(words)[:150]) for _ in range(20)]
    rows = [(i, t, None, "s", 1, "c", 2, 3) for i, t in enumerate(texts)] + [(900, None) + (None,) * 6, (901, None) + (None,) * 6, (5, texts[5]) + (None,) * 6]
    return spark.createDataFrame(rows, DOCS.replace("start int", "comp int")).repartition(5)


def test_near_duplicates_equal_brute_force(copies):
    rows = copies.select("doc_id", "text").distinct().collect()
    texts = {r["doc_id"]: r["text"] for r in rows if r["text"] is not None}
    parts = {i: shingled(t) for i, t in texts.items()}
    parent = {r["doc_id"]: r["doc_id"] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and root(i) != root(j):
                a, b = parts[i], parts[j]
                if len(set(a) & set(b)) >= 0.4 * max(len(a), len(b)):
                    m = common_run(a, b)
                    if m / (len(a) + len(b) - m) >= 0.8:
                        parent[max(root(i), root(j))] = min(root(i), root(j))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(copies).collect()}
    assert got == {i: root(i) for i in parent}


def test_deduplicated_keeps_one_whole_row(copies):
    classes = {r["class_id"] for r in neardup.near_duplicates(copies).collect()}
    kept = neardup.deduplicated(copies)
    assert kept.columns == copies.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(classes)
    assert neardup.deduplicated(copies.where("false")).collect() == []


def test_open_buckets_join_classes(spark, monkeypatch):
    """A chain whose ends are not similar to its centre still is one class."""
    base = [f"v{i}" for i in range(100)]
    chain = [" ".join([f"u{j}" for j in range(4 * k)] + base[4 * k :]) for k in range(8)]
    df = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    got = {r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == {0}


def test_alignment_equals_longest_common_subsequence():
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = rng.integers(0, 9, rng.integers(5, 60)), rng.integers(0, 9, rng.integers(5, 60))
        if rng.random() < 0.7:
            b = np.delete(a, rng.integers(0, len(a), 2))
        ta, tb = " ".join(map(str, a)), " ".join(map(str, b))
        one, two = neardup.labelled_shingles(ta), neardup.labelled_shingles(tb)
        m = common_run(shingled(ta), shingled(tb))
        want = m / (len(one) + len(two) - m)
        got = neardup.aligned({s: i for i, s in enumerate(one.tolist())}, len(one), two)
        assert got == pytest.approx(want if want >= 0.8 else 0.0)


def test_near_copies_with_one_common_sketch_meet(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))
    rows, through_hub = [], 0
    for f in range(80):
        own = [word() for _ in range(12)]
        hub = [word() for _ in range(2)] + own[f % 6 : f % 6 + 7] + [word() for _ in range(3)]
        rows += [(3 * f, " ".join(hub)), (3 * f + 1, " ".join(own)), (3 * f + 2, " ".join([*own, word()]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs, count=1, picks=1).collect()}
    for f in range(80):
        hub, one, two = (neardup.sketches(neardup.labelled_shingles(rows[3 * f + i][1]), 1, 1)[0] for i in range(3))
        if one == two:
            assert got[3 * f + 1] == got[3 * f + 2] != got[3 * f]
            through_hub += hub == one
    assert through_hub >= 5


def test_shared_counts_equal_plain_sets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 300)
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(200)]
    texts = [t for _ in range(4) for t in near_copies(rng, words, 9)] + ["", "one two"]
    rows = [(i, i // 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "row long, comp long, text string").repartition(3)
    sized = df.select(F.lit(100).alias("length"))
    rows_got = neardup.shared_counts(df, sized).collect()
    assert all(np.frombuffer(r["parts"], "<u2").sum() == r["shared"] for r in rows_got)
    got = {r["row"]: (r["length"], r["shared"]) for r in rows_got}
    parts = [set(shingled(t)) if t else set() for t in texts]
    for i, own in enumerate(parts):
        others = set().union(*[p for j, p in enumerate(parts) if j // 3 != i // 3])
        assert got[i] == (len(own), len(own & others))


def test_shingles_of_several_classes_cost_one_sort():
    """A slice answers its chunks together: holding each against all shingles of the slice grew with the square."""
    rng = np.random.default_rng(10)
    few, comps = rng.integers(0, 40, 200).astype("uint64"), rng.integers(0, 3, 200)
    held = {v: {c for w, c in zip(few.tolist(), comps.tolist()) if w == v} for v in few.tolist()}
    assert neardup.in_several(few, comps).tolist() == [len(held[v]) > 1 for v in few.tolist()]
    many = rng.integers(0, 1 << 20, 1_500_000).astype("uint64")
    got = pd.DataFrame({"chunk": range(150), "slice": 0, "s": [neardup.mixed(x).tobytes() for x in np.split(many, 150)]})
    got["names"] = [np.arange(2).tobytes()] * 150
    got["place"] = [(x % np.uint64(2)).astype("<u4").tobytes() for x in np.split(many >> np.uint64(1), 150)]
    began = time.process_time()
    answers = neardup.answered(got)
    assert time.process_time() - began < 8
    assert answers["chunk"].tolist() == list(range(150)) and not any(map(any, answers["several"]))  # one class for each value
    got["place"] = [np.full(10_000, k % 2, "<u4").tobytes() for k in range(150)]
    flags = np.concatenate([np.unpackbits(np.frombuffer(x, "uint8")) for x in neardup.answered(got)["several"]])
    own = np.repeat(np.arange(150) % 2, 10_000)
    both = np.intersect1d(many[own == 0], many[own == 1])
    assert (flags.astype(bool) == np.isin(many, both)).all()


def test_texts_of_a_tile_are_read_once(monkeypatch):
    """A large group of near copies, all pairs open: the work of a pair is to count marks."""
    rng = np.random.default_rng(11)
    texts = [t for k in range(2) for t in near_copies(rng, [f"w{k}{i}" for i in range(90)], 30)]
    rows = pd.DataFrame({"tile": [5] * 60 + [6] * 3, "row": [*range(60), 0, 7, 33], "text": [*texts, texts[0], texts[7], texts[33]]})
    pairs = [(5, a, b) for a in range(60) for b in range(a)] + [(6, 7, 0), (6, 33, 7)]
    made, tried, shingles, aligned = [], [], neardup.labelled_shingles, neardup.aligned
    monkeypatch.setattr(neardup, "labelled_shingles", lambda t: made.append(t) or shingles(t))
    monkeypatch.setattr(neardup, "aligned", lambda *x: tried.append(x) or aligned(*x))
    got = neardup.compared(rows, pd.DataFrame(pairs, columns=["tile", "a", "b"]), 0.8)
    assert len(made) == len(rows)
    own = [shingles(t) for t in texts]
    place = [{s: i for i, s in enumerate(x.tolist())} for x in own]
    want = [(a, b, near) for _, a, b in pairs if (near := aligned(place[a], len(own[a]), own[b]))]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want)
    assert len(want) < len(pairs) / 2 and len(tried) <= 2 * len(want)


def test_every_letter_in_every_place(plain_tokenizer):
    """Words of every alphabetic code point, alone, inside and at the end, with each mark behind."""
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    some = letters[:3000] + letters[3000::17]  # the Latin, Greek and Cyrillic ones all
    words = [w for c in some for w in (c, c + ",", f"a{c}.", f"wg{c},", f"A{c}b")]
    words += ["DİYARBAKIRİ.", "ΟΔΟΣ", "ΟΔΟΣ.", "ét́,", "a.,", ".", ",,", "'s", "x's", "9a", "a" * 64 + ".", "b" * 65, "aAaA" * 16]
    own = packing.encoder(WORDS)
    for first in range(0, len(words), 400):
        part = words[first : first + 400]
        got = own.of([" ".join(part), *part])
        assert got[0] == b"".join(got[1:])
        want = plain_tokenizer.encode_batch(part, add_special_tokens=False)
        for w, ids, enc in zip(part, got[1:], want):
            assert np.frombuffer(ids, "<u4").tolist() == enc.ids, repr(w)


def test_merging_goes_on_while_a_bin_fits(spark, monkeypatch):
    monkeypatch.setattr(packing, "BINS_PER_TASK", 16)
    items = [(i, n) for i, n in enumerate([70] * 40 + [30] * 3 + [29] * 37)]
    df = spark.createDataFrame(items, "piece_id long, length long").repartition(16)
    df = spark.createDataFrame(df.toPandas()).repartition(16)
    places = packing.pack(df, size=100).join(df, "piece_id").collect()
    fills = Counter()
    for r in places:
        fills[r["sequence_id"]] += r["length"]
    one, two = sorted(fills.values())[:2]
    assert len(places) == len(items) and one + two > 100


def test_filter_of_row_numbers(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FILTER_PIECE", 1 << 9)
    texts = spark.range(20_000).select(F.col("id").alias("row"))
    wanted = texts.where("row % 97 = 5").repartition(3)
    got = {r["row"] for r in neardup.holding(texts, wanted).collect()}
    want = set(range(5, 20_000, 97))
    assert want <= got and len(got) < 3 * len(want)
    assert neardup.holding(texts, wanted.where("false")).count() < 200
    monkeypatch.setattr(neardup, "FILTER_BITS", 64)
    assert neardup.holding(texts, wanted) is texts

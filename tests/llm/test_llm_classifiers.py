"""Quality and toxicity: held-out accuracy, plain forward passes, corner cases."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factorloom.llm import quality, toxicity
from factorloom.llm.common import isotonic, one_label
from factorloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, x string, y int, language string"


def test_quality_held_out(spark):
    rows = QUERIES["op8_quality_classifier"](spark, FOLDER)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    got = rows.collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) >= 0.97


def planted(rng, n):
    """Ordinary words, and for every second text one of a few bad words somewhere in it."""
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(500)]
    bad = ["scumbag", "vileword", "nastything"]
    for i in range(n):
        text = [words[j] for j in rng.integers(0, 500, rng.integers(3, 200))]
        if i % 2:
            text.insert(rng.integers(0, len(text)), bad[rng.integers(0, 3)].upper() + ",")
        yield i, " ".join(text), i % 2


def test_toxicity_finds_planted_words(spark):
    rows = list(planted(np.random.default_rng(1), 400))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t, _ in rows] + [(900, None) + (None,) * 3, (901, "", None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 300], "doc_id long, toxic int")
    known = one_label(labels, "doc_id", "toxic")
    net = toxicity.train(docs, known, F.col("doc_id"), visits=6000)
    read = toxicity.read(docs, {"doc_id": F.col("doc_id")}, net)
    net = toxicity.calibrated(read, known, net, "doc_id")
    score = {r["doc_id"]: r["s"] for r in read.select("doc_id", toxicity.score(net, F.col("raw"), F.col("language")).alias("s")).collect()}
    assert np.mean([(score[i] >= 0.3) == y for i, _, y in rows if i >= 300]) >= 0.97
    assert score[900] == score[901] < 0.5
    direct = docs.select("doc_id", toxicity.score_text(net, F.col("text"), spark).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in direct} == pytest.approx(score)
    assert toxicity.read(docs.where("false"), {"doc_id": F.col("doc_id")}, net).collect() == []
    nothing = toxicity.train(docs, known.where("false"), F.col("doc_id"))
    assert toxicity.Reader(nothing).read(["any text"])[0][0] < -10


def held_out_toxic(spark):
    """Held-out labelled documents of the small table, and those of them that are toxic."""
    labels = one_label(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id", "toxic").collect()
    held = {r["_key"]: r["y"] for r in labels if zlib.crc32(str(r["_key"]).encode()) % 4 == 2}
    return set(held), {k for k, y in held.items() if y}


def test_toxicity_held_out_recall(spark):
    held, toxic = held_out_toxic(spark)
    found = {r["doc_id"] for r in QUERIES["op9_toxicity"](spark, FOLDER).where("held_out and predicted = 1").collect()} & held
    assert len(found & toxic) >= 0.4 * len(toxic) and len(found & toxic) >= 0.35 * len(found)


def test_toxicity_stage_held_out_recall(spark):
    held, toxic = held_out_toxic(spark)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, FOLDER).select("doc_id").collect()}
    gone = held & {r["doc_id"] for r in docs.select("doc_id").collect()} - kept
    assert len(gone & toxic) >= 0.4 * len(toxic) and len(gone & toxic) >= 0.35 * len(gone)


def test_network_equals_plain_convolution():
    rng = np.random.default_rng(2)
    texts_words = [[f"w{j}" for j in rng.integers(0, 30, 50)] for _ in range(8)]
    texts = [toxicity.bucketed(w) for w in texts_words]
    net = toxicity.start_network(texts, 1)
    rows = net.rows(texts[0])
    want = []
    for kernel, bias in zip(net.kernels, net.biases):
        width, _, count = kernel.shape
        for f in range(count):
            sums = [
                sum((net.embedding[rows[i + j, 0]] + net.embedding[rows[i + j, 1]]) @ kernel[j][:, f] for j in range(width)) + bias[f]
                for i in range(len(rows) - width + 1)
            ]
            want.append(max(0, max(sums)))
    assert np.allclose(net.pooled(rows)[0], want, atol=1e-5)
    empty, whole = toxicity.Reader(net).read([None, " ".join(texts_words[0])])
    assert empty[0] == pytest.approx(net.bias)
    assert whole[0] == pytest.approx(float(np.array(want) @ net.out + net.bias), abs=1e-4)


def test_long_texts_are_read_to_the_end(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 16)
    rng = np.random.default_rng(3)
    words = [f"w{j}" for j in rng.integers(0, 30, 500)]
    text = toxicity.bucketed(words)
    net = toxicity.start_network([text, text], 1)
    want = float(net.pooled(net.rows(text))[0] @ net.out + net.bias)
    assert toxicity.Reader(net).read([" ".join(words)])[0][0] == pytest.approx(want, abs=1e-4)


def test_one_kind_of_label_only(spark):
    docs = spark.createDataFrame([(1, "a b", "", 0, ""), (2, None, "", 0, "")], SCHEMA)
    labels = one_label(spark.createDataFrame([(1, 1), (3, None)], "doc_id long, quality int"), "doc_id", "quality")
    rows = quality.described(docs, {"doc_id": F.col("doc_id")})
    model = quality.train(quality.labelled(rows, labels, "doc_id"))
    assert {r["s"] for r in rows.select(quality.score(model, F.col("x")).alias("s")).collect()} == {1.0}
    empty = quality.train(quality.labelled(rows, labels.where("false"), "doc_id"))
    assert {r["s"] for r in docs.select(quality.score_text(empty, F.col("text")).alias("s")).collect()} == {0.5}
    assert quality.described(docs.where("false"), {"doc_id": F.col("doc_id")}).collect() == []


def test_conflicting_labels_are_left_out(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (None, 1), (4, 7)], "doc_id long, quality int")
    assert [tuple(r) for r in one_label(labels, "doc_id", "quality").collect()] == [(2, 1.0)]


def test_isotonic_rates_rise():
    x, rates = isotonic(np.arange(6.0), np.array([0, 3, 1, 0, 4, 5.0]), np.array([5, 5, 5, 0, 5, 5.0]))
    assert (np.diff(rates) > 0).all() and (np.diff(x) > 0).all() and rates.tolist() == [0.0, 0.4, 0.8, 1.0]


def plain_statistics(text):
    """The statistics of a text, character by character and word by word."""
    if not text:
        return [0.0] * quality.STATISTICS
    n, words, lines = len(text), text.split(), text.split("\n")
    kinds = {k: 0 for k in ("upper", "lower", "digit", "blank", "stop", "mark", "other")}
    for c in text:
        if ord(c) >= 128:
            kinds["other"] += 1
        elif c in "\t\n\x0b\x0c\r ":
            kinds["blank"] += 1
        elif c in ".,;:?'\"()-":
            kinds["stop"] += 1
        else:
            kinds["upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "mark"] += 1
    letters = kinds["upper"] + kinds["lower"] + kinds["other"]
    out = [math.log(1 + n), math.log(1 + len(words)), kinds["upper"] / max(1, letters)]
    out += [kinds[k] / n for k in ("digit", "blank", "stop", "mark", "other")]
    out.append(math.sqrt(kinds["mark"] / n))
    if words:
        w, lengths, distinct = len(words), [len(x) for x in words], set(words)
        mean = sum(lengths) / w
        out += [mean / 10, math.sqrt(sum((x - mean) ** 2 for x in lengths) / w) / 10, len(distinct) / w]
        out.append(math.log((1 + w) / (1 + len(distinct))))
        out.append(sum(words[i] == words[i + 1] for i in range(w - 1)) / w)
        out.append(len({(words[i], words[i + 1]) for i in range(w - 1)}) / max(1, w - 1))
        out.append(len([x for x in words if x.isupper()]) / w)
        out.append(len([x for x in distinct if not x[-1].isalnum() and x[-1] not in ".,"]) / len(distinct))
        out.append(min(1.0, max(lengths) / 100))
    else:
        out += [0.0] * 9
    filled = [x for x in lines if x.strip()]
    out += [math.log(1 + len(lines)), len(set(filled)) / max(1, len(filled)), math.log(1 + n / len(lines)) / 10]
    return [*out, sum(text.count(c) for c in ".?!") / max(1, len(words))]


ODD = [None, "", " ", "\n\n", "A", "é É ñ. ", "no  no no\nNO!", "x" * 500, "1 2 3 ; -- $$", "\x00 tab\there", "漢字 漢字"]


def test_quality_equals_a_plain_model(spark):
    """Statistics, normal equations summed over partitions, ridge weights and calibration, each by a direct way."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 300").select("doc_id", "text")
    docs = docs.unionAll(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], docs.schema)).repartition(5)
    rows = quality.described(docs, {"doc_id": F.col("doc_id")})
    x = {r["doc_id"]: r["x"] for r in rows.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, text in texts.items():
        assert x[i] == pytest.approx(plain_statistics(text), abs=1e-12), repr(text)
    labels = spark.createDataFrame([(i, float(i % 3 == 0)) for i in texts], "_key long, y double")
    known = quality.labelled(rows, labels, "doc_id").checkpoint()
    model = quality.train(known, waves=40)
    got = known.collect()
    fit, kept = [r for r in got if not r["kept"]], [r for r in got if r["kept"]]
    every = np.array([r["x"] for r in got])
    assert np.allclose(model.centre, every.mean(0)) and np.allclose(model.scale, np.where(every.std(0) > 1e-9, every.std(0), 1))

    def waves(rows):
        z = np.clip((np.array([r["x"] for r in rows]) - model.centre) / model.scale, -8, 8)
        return np.array([[*(math.sqrt(2 / 40) * math.cos(v) for v in z_i @ model.directions + model.phases), 1.0] for z_i in z])

    phi, y = waves(fit), np.array([r["y"] for r in fit])
    left = phi.T @ phi + np.diag([quality.RIDGE * len(fit)] * 40 + [1e-9])
    assert np.allclose(model.weights, np.linalg.solve(left, phi.T @ y), atol=1e-6)
    raw = waves(kept) @ model.weights
    bins = {}
    for s, r in zip(raw, kept):
        bins.setdefault(min(max(math.floor((s + 0.5) / 2 * quality.BINS), 0), quality.BINS - 1), []).append((s, r["y"]))
    sums = np.array([(np.mean([s for s, _ in v]), sum(t for _, t in v), len(v)) for _, v in sorted(bins.items())])
    knots, rates = isotonic(*sums.T)
    assert np.allclose(model.knots, knots, atol=1e-6) and np.allclose(model.rates, rates)
    told = {r["doc_id"]: r["p"] for r in rows.select("doc_id", quality.score(model, F.col("x")).alias("p")).collect()}
    order = list(told)
    want = np.interp(waves([{"x": x[i]} for i in order]) @ model.weights, knots, rates)
    assert np.allclose([told[i] for i in order], want, atol=1e-4)

"""The pipeline against plain versions of its stages."""

import gc
import weakref

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from factorloom.llm import mixing, neardup, packing, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_stages_take_effect_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == columns
        kept.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
        if i == 2:
            first = sorted({r["class_id"] for r in neardup.near_duplicates(before).collect()})
            assert kept[2] == first
        if i == 3:
            times = {r["doc_id"]: r["copies"] for r in mixing.copies(before, identity=columns).collect()}
            assert kept[3] == sorted(d for d, n in times.items() for _ in range(n))
    good = [d for d in kept[0] if d in truth]
    assert np.mean([truth[d]["quality"] for d in good]) >= 0.99
    assert len(good) >= 0.98 * sum(r["quality"] for r in truth.values())
    clean = [d for d in kept[0] if d in truth and not truth[d]["toxic"]]
    assert len([d for d in kept[1] if d in set(clean)]) >= 0.95 * len(clean)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r["length"] for r in rows) == tokens
    assert len({r["sequence_id"] for r in rows}) <= 1.02 * tokens / packing.SEQUENCE + 1


def test_run_on_the_smallest_table(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "sequence_id", "offset"] and out.count() > 0


def test_sketches_let_go_of_what_packing_kept():
    class Taken:
        def mapInPandas(self, made, schema):
            return made

    path = public_tokenizers.path("word_bpe_49k.json")
    kept = weakref.ref(packing.encoder(path))
    assert packing.encoder(path) is kept()  # from task to task
    draw = neardup.sketch_rows(Taken(), 32, 4)
    made = list(draw(iter([pd.DataFrame({"row": [1], "text_id": ["a"], "text": ["one two three four five six"]})])))
    gc.collect()
    assert made[0]["length"].tolist() == [2] and kept() is None


def test_workers_keep_no_words_of_toxicity(spark):
    docs = spark.range(0, 64, 1, 16).select("id", F.concat_ws(" ", F.lit("word"), "id").alias("text"))
    net = toxicity.start_network([toxicity.bucketed(["word", "1"])] * 2, 3)
    net.knots, net.rates = [np.array([0.0])] * 5, [np.array([0.25])] * 5
    assert toxicity.read(docs, {"id": F.col("id")}, net).count() == 64
    got = docs.select(toxicity.score_text(net, F.col("text"), spark).alias("p")).collect()
    assert [r["p"] for r in got] == [0.25] * 64

    def kept(batches):
        list(batches)
        yield pd.DataFrame({"n": [sum(isinstance(x, toxicity.Reader) for x in gc.get_objects())]})

    # Spark deals tasks out to all its idle workers in turn.
    assert [r["n"] for r in spark.range(0, 64, 1, 64).mapInPandas(kept, "n long").collect()] == [0] * 64


def test_packing_rests_with_the_words_met_first(monkeypatch):
    monkeypatch.setattr(packing.WordIds, "RESTING", 3)
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["the first words", "and others behind them"]
    found = [words.of([t])[0] for t in texts]
    words.rest()
    assert len(words.known) == 3
    assert words.of(texts) == found

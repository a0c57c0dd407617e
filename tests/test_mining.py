"""The joined mining step: stages are stored, found again, and rebuilt from the first one that changed."""

import os

import pytest
from pyspark.sql import functions as F

from factorloom.operators import factors, mining, registry
from factorloom.plans.skew import Layout
from factorloom.sources import bars

BASES = ["RANK(CLOSE - OPEN)", "RANK(VOLUME)", "DELTA(CLOSE, 3)"]
LIBRARY = [*BASES, *[f"({e}) * 2" for e in BASES]]
STAGES = ["matrix", "clusters", "exemplars", "chains", "prompt"]


@pytest.fixture(scope="module")
def weekly(spark, folder):
    return bars.weekly_brand_bars(spark, folder).checkpoint()


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([(i, f"alpha_{i + 1}", e) for i, e in enumerate(LIBRARY)], "pos long, name string, expression string")


def test_a_second_run_computes_nothing(spark, weekly, known, tmp_path):
    first = mining.mining_step(weekly, known, str(tmp_path), k=3, n=4, whitelist=["RANK"])
    assert first.built == STAGES
    picked = [(r["place"], r["expression"], r["cluster"]) for r in first.exemplars.orderBy("place").collect()]
    assert picked == [(1, BASES[0], 0), (2, BASES[1], 1), (3, BASES[2], 2), (4, f"({BASES[0]}) * 2", 0)]
    prompt = first.prompt.first()
    assert prompt["run_id"] == 0 and prompt["ops"] == ["RANK"] and all(e in prompt["prompt"] for _, e, _ in picked)
    assert first.chains.where("chain_id = 0").count() == 2
    shuffled = weekly.repartition(3).select(*weekly.columns)
    again = mining.mining_step(shuffled, known, str(tmp_path), k=3, n=4, whitelist=["RANK"])
    assert again.built == [] and again.prompt.first() == prompt
    fewer = mining.mining_step(weekly, known, str(tmp_path), k=3, n=2, whitelist=["RANK"])
    assert fewer.built == STAGES[2:] and fewer.exemplars.count() == 2
    other = mining.mining_step(weekly, known, str(tmp_path), k=3, n=4, whitelist=["RANK"], deny_fields=["open"])
    assert other.built == ["prompt"] and "OPEN" not in other.prompt.first()["prompt"].rsplit("CLOSE, ", 1)[1]
    changed = mining.mining_step(weekly.where("volume > 20"), known, str(tmp_path), k=3, n=4, whitelist=["RANK"])
    assert changed.built == STAGES


def test_an_unfinished_stage_is_built_again(weekly, known, tmp_path):
    first = mining.mining_step(weekly, known, str(tmp_path), k=3, n=4)
    want = sorted(map(tuple, first.exemplars.collect()))
    half = next(tmp_path / d for d in os.listdir(tmp_path) if d.startswith("exemplars"))
    os.remove(half / "_SUCCESS")
    again = mining.mining_step(weekly, known, str(tmp_path), k=3, n=4)
    assert again.built == ["exemplars"] and sorted(map(tuple, again.exemplars.collect())) == want


def test_digest_of_rows_in_any_order(spark):
    rows = [(1, "a", None), (2, None, 2.5), (2, None, 2.5)]
    df = spark.createDataFrame(rows, "x int, y string, z double")
    same = mining.table_digest(df)
    assert same == mining.table_digest(df.repartition(3))
    for other in (df.distinct(), df.withColumn("x", F.col("x") + 1), df.withColumnRenamed("z", "w"), df.fillna("", ["y"]), df.where("false")):
        assert mining.table_digest(other) != same


def test_replies_lengthen_the_library(spark, known):
    replies = [(2, "FA1: RANK(LOW)\nFA2: RANK(VOLUME)"), (1, "`ABS(RET)`\n\nFA9: RANK(LOW)\nnonsense("), (3, None)]
    table = spark.createDataFrame(replies, "pos int, text string")
    got = mining.take_replies(known, table).orderBy("pos").collect()
    assert [r["expression"] for r in got] == [*LIBRARY, "ABS(RET)", "RANK(LOW)"]
    assert [r["name"] for r in got][-2:] == ["alpha_7", "alpha_8"]
    assert mining.take_replies(known, table.where("false")).count() == len(LIBRARY)


def test_registered_lead_on_split_histories(spark, weekly):
    registry.register_operator(
        "NEXT_SUM", lambda x, n, over: F.sum(x).over(over.ordered.rowsBetween(0, n)), by="symbol", integers=1,
        lookback=lambda n: 0, lookahead=lambda n: n,
    )
    try:
        usual, split = (
            factors.compute_composed(weekly, ["NEXT_SUM(CLOSE, 3)"], layout=layout).toDF("date", "symbol", "x")
            for layout in (Layout(), Layout(split_symbols=True, row_limit=10))
        )
        assert usual.exceptAll(split).isEmpty() and usual.count() == split.count()
    finally:
        del registry.OPERATORS["NEXT_SUM"]

"""The driver contract, and a sample of registered queries against their SQL."""

import pytest

from catalog.check import connection, rows_of

import __spark_entry__ as contract


def test_flagship(spark):
    out = contract.entry(spark)
    assert out.columns[:2] == ["date", "symbol"] and out.count() > 0


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert sum(name[0] == "A" for name in contract.queries()) == 82


SAMPLE = ["P3_ret_filled", "P9_arithmetic", "J1_densify", "T4_correl", "X1_rank", "G4", "A026",
          "A096", "N5_ts_rank", "C1_scored_chains", "C3_match_chain", "L3_expression_profile",
          "L7_prompt_context", "K5_similarity_embeddings"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, folder, name):
    df = contract.queries()[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = connection(folder).execute(contract.oracle_sql()[name])
    assert got == rows_of([c[0] for c in result.description], result.fetchall())

"""Expression tables, chains, selection, sources and sinks on small hand-made input."""

import datetime as dt
import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import chains, library, panel, registry, selection
from factorloom.plans.durable import scratch_path
from factorloom.sources import factor_sets, panel_io


def table(spark, expressions, run=1):
    rows = [(run, i, f"n{i}", e) for i, e in enumerate(expressions)]
    return spark.createDataFrame(rows, "run_id INT, pos INT, name STRING, expression STRING")


def as_lists(rows, *key):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: [r[k] for k in (*key, "pos")]):
        out.setdefault(tuple(r[k] for k in key), []).append(r["expression"])
    return list(out.values())


# ---- chains ----


@pytest.mark.parametrize("n, sizes", [(1, [1]), (2, [1, 1]), (4, [2, 2]), (7, [3, 3, 1])])
def test_initial_chain_sizes(spark, n, sizes):
    found = as_lists(chains.initial_chains(table(spark, list("abcdefg")[:n])), "chain_id")
    assert [len(c) for c in found] == sizes
    assert sum(found, []) == list("abcdefg")[:n]


def test_scores_order_chains_and_missing_ones_get_the_mean(spark):
    scores = spark.createDataFrame(
        [(1, "n0", 1.0), (1, "n2", 5.0), (1, "other", 6.0)], "run_id INT, name STRING, score DOUBLE"
    )
    found = as_lists(chains.initial_chains(table(spark, list("abc")), scores), "chain_id")
    assert found == [["c"], ["b"], ["a"]]  # b gets (1 + 5 + 6) / 3


def test_initial_chains_spread_over_tasks(spark):
    rows = table(spark, [f"e{i}" for i in range(200)])
    usual, spread = (chains.initial_chains(rows, spread=s) for s in (False, True))
    assert usual.exceptAll(spread).isEmpty() and spread.count() == 200


def test_tokens_keep_commas(spark):
    row = spark.createDataFrame([("CORREL(CLOSE, volume, 5)",)], "e STRING")
    assert row.select(chains.tokenize(F.col("e"))).first()[0] == ["5", "CLOSE,", "CORREL", "VOLUME,"]


def brute_match(sample, candidates):
    def tokens(text):
        for c in "()-+*/":
            text = text.replace(c, " ")
        return {t.upper() for t in text.split()}

    best, best_score = 0, -1.0
    for i, chain in enumerate(candidates):
        known = set().union(*map(tokens, chain))
        own = tokens(sample)
        score = len(own & known) / len(own | known)
        if score > best_score:
            best, best_score = i, score
    return best


def test_match_equals_brute_force(spark):
    seeds = library.seed_list()
    groups = [seeds[i : i + 3] for i in range(0, 60, 3)]
    rows = [(1, c, p, e) for c, g in enumerate(groups) for p, e in enumerate(g)]
    known = spark.createDataFrame(rows, "run_id INT, chain_id INT, pos INT, expression STRING")
    wanted = [*seeds[60:], "nothing in common", ""]
    samples = spark.createDataFrame(
        [(1, i, e) for i, e in enumerate(wanted)], "run_id INT, sample_id INT, expression STRING"
    )
    got = {r["sample_id"]: r["chain_id"] for r in chains.match_chain(samples, known).collect()}
    assert got == {i: brute_match(e, groups) for i, e in enumerate(wanted)}


def test_extend_split_present_and_new(spark):
    rows = [(1, 0, i, e) for i, e in enumerate("abcde")] + [(1, 1, 0, "a"), (1, 2, 0, "x")]
    known = spark.createDataFrame(rows, "run_id INT, chain_id INT, pos INT, expression STRING")
    new = spark.createDataFrame(
        [(1, 0, "f"), (1, 1, "b"), (1, 2, "x"), (1, 3, "n")], "run_id INT, chain_id INT, new STRING"
    )
    got = as_lists(chains.extend_or_split(known, new), "chain_id", "part")
    assert got == [["a", "b", "c"], ["d", "e", "f"], ["a", "b"], ["x"], ["n"]]


def test_hints(spark):
    extra = spark.createDataFrame([(0, "  keep "), (1, "   ")], "pos INT, hint STRING")
    got = [r["hint"] for r in chains.cold_start_hints(spark, extra).orderBy("source", "pos").collect()]
    assert len(got) == 6 and got[-1] == "keep"


# ---- expression tables ----


def test_seed_library(spark):
    seeds = [r["expression"] for r in library.seed_expressions(spark).orderBy("pos").collect()]
    assert len(seeds) == 101 and len(set(seeds)) == 100
    assert seeds[-1] == "RANK(TS_MEAN(RET * VOLUME, 9))"
    assert library.named_factors(spark).count() == 82


def test_profile(spark):
    rows = table(spark, ["RANK(FOO(CLOSE, 2e5) - OPEN.x)", "3"])
    got = library.expression_profile(rows).orderBy("pos").collect()
    assert got[0]["functions"] == ["FOO", "RANK"]
    assert got[0]["variables"][:2] == ["CLOSE", "FOO"] and "e5" not in got[0]["variables"]
    assert got[1]["functions"] == [] and got[1]["variables"] == []


@pytest.mark.parametrize(
    "text, good",
    [
        ("RANK(CLOSE)", True), ("alpha001", True), (" ALPHA123 ", True), ("alpha1", False),
        ("RANK(CLOSE", False), ("CLOSE > OPEN", False), ("RANK(PRICE)", False), ("rank(CLOSE)", False),
        ("CLOSE ** -2 + 1.5", True), ("'abc'", True), ("RANK", True), ("RANK(x=CLOSE)", False),
        ("[CLOSE]", False), ("EXTRA * 2", True), ("", False), ("CORREL(CLOSE, VOLUME, 5)", True),
        (" RANK(CLOSE)", False), ("CLOSE // 2", False), ("lambda: 1", False), ("CLOSE.x", False),
    ],
)
def test_validity(spark, text, good):
    names = frozenset([*library.OPERATORS, *library.BASE_FIELDS, "EXTRA"])
    assert library.is_valid(text, names, None) is good


def test_validate_table_with_operator_whitelist(spark):
    rows = table(spark, ["RANK(CLOSE)", "SIGN(CLOSE)", "alpha002", None, "RANK(MINE)"])
    got = library.validate_candidates(rows, ["mine"], ["rank"]).orderBy("pos")
    assert [r["expression"] for r in got.collect()] == ["RANK(CLOSE)", "alpha002", "RANK(MINE)"]


def brute_replies(text):
    found = []
    for line in text.splitlines():
        line = line.strip()
        if not line:
            continue
        if ":" in line:
            line = line.split(":", 1)[1]
        line = line.strip().strip("`")
        if line:
            found.append(line)
    return found


def test_replies(spark):
    texts = [
        "FA1: RANK(CLOSE)\n\n`ABS(RET)`",
        "FA1: RANK(CLOSE)\nFA2: DELTA(CLOSE, 3)",
        "OPS-CHECKSUM: 12345678\r\nX: a:b\rlast\x0bone two\x85three \x1cfour",
        "label:\n::\n  `  `  \n`x`y`",
        "",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "run_id INT, text STRING")
    got = {}
    for r in library.parse_responses(frame).orderBy("run_id", "line").collect():
        got.setdefault(r["run_id"], []).append(r["expression"])
    assert [got.get(i, []) for i in range(len(texts))] == [brute_replies(t) for t in texts]


def test_replies_over_whole_conversations(spark, folder):
    frame = spark.read.parquet(f"{folder}/conversations.parquet")
    got = library.parse_responses(frame).orderBy("conv_id", "turn", "line").collect()
    whole = frame.orderBy("conv_id", "turn").toPandas()["text"]
    assert [r["expression"] for r in got] == [e for text in whole for e in brute_replies(text)]
    checked = library.mark_valid(library.parse_responses(frame)).toPandas()
    names = frozenset([*library.OPERATORS, *library.BASE_FIELDS])
    assert list(checked["valid"]) == [library.is_valid(e, names, None) for e in checked["expression"]]


def test_prompt(spark):
    shown = table(spark, ["RANK(CLOSE)"]).select("run_id", "pos", "expression")
    path = table(spark, ["RANK(CLOSE)", "DELTA(CLOSE, 3)"]).select("run_id", "pos", "expression")
    row = library.prompt_context(shown, path, ["CLOSE", "RET"], ["RANK", "DELTA"], 3).first()
    assert row["ops"] == ["DELTA", "RANK"]
    assert row["checksum"] == hashlib.md5(row["cards"].encode()).hexdigest()[:8]
    assert row["prompt"].startswith(f"OPS-CHECKSUM: {row['checksum']}\n")
    assert "- RANK(CLOSE)\n- DELTA(CLOSE, 3)" in row["prompt"]
    assert "仅允许使用以下字段（大写）：CLOSE, RET" in row["prompt"]
    none = library.prompt_context(shown.where("pos > 5"), path.where("pos = 0"), ["RET"]).first()
    assert library.NO_ENTRIES in none["prompt"] and none["ops"] == ["RANK"]


def test_append_names_and_dedupe(spark):
    base = spark.createDataFrame([(0, "alpha001", "alpha001"), (1, "x", "A")], "pos INT, name STRING, expression STRING")
    fresh = spark.createDataFrame([(7, "B"), (3, "A"), (9, "B")], "pos INT, expression STRING")
    every = library.append_candidates(base, fresh).orderBy("pos").collect()
    assert [(r["name"], r["expression"]) for r in every[2:]] == [("alpha_3", "A"), ("alpha_4", "B"), ("alpha_5", "B")]
    once = library.append_candidates(base, fresh, dedupe=True).orderBy("pos").collect()
    assert [(r["name"], r["expression"]) for r in once[2:]] == [("alpha_3", "B")]


# ---- selection ----


def matrix_of(spark, columns):
    rows = [(dt.date(2024, 1, 1), f"s{i:03d}", *vals) for i, vals in enumerate(zip(*columns.values()))]
    names = ", ".join(f"`{c}` DOUBLE" for c in columns)
    return spark.createDataFrame(rows, f"date DATE, symbol STRING, {names}")


COLUMNS = {
    "a": [1.0, 2.0, 3.0, 4.0, 5.0, 9.0],
    "2 * a.": [2.0, 4.0, 6.0, 8.0, 10.0, 18.0],
    "b": [5.0, 1.0, 4.0, 2.0, 3.0, 0.0],
    "-b": [-5.0, -1.0, -4.0, -2.0, -3.0, 0.0],
    "flat": [7.0] * 6,
    "odd": [float("nan"), float("inf"), None, 1e9, 0.0, 1.0],
}


def test_standardize(spark):
    got = selection.standardize_matrix(matrix_of(spark, COLUMNS)).orderBy("symbol").toPandas()
    assert (got["flat"] == 0).all()
    for name, raw in COLUMNS.items():
        clean = pd.Series([0.0 if v is None or v != v or abs(v) == float("inf") else min(v, 1e6) for v in raw])
        if name != "flat":
            want = (clean - clean.mean()) / clean.std(ddof=0)
            assert list(got[name]) == pytest.approx(list(want))


def test_gram_distances_and_similarity(spark):
    matrix = matrix_of(spark, COLUMNS)
    standard = selection.standardize_matrix(matrix).orderBy("symbol").toPandas()
    for row in selection.factor_gram(matrix).collect():
        x, y = standard[row["f1"]], standard[row["f2"]]
        assert row["gram"] == pytest.approx((x * y).sum(), abs=1e-9)
        assert row["distance2"] == pytest.approx(((x - y) ** 2).sum(), abs=1e-8)
    rho = {(r["f1"], r["f2"]): r["rho"] for r in selection.factor_similarity(matrix).collect()}
    assert rho["a", "2 * a."] == pytest.approx(1.0) and rho["b", "-b"] == pytest.approx(-1.0)
    assert rho["a", "flat"] == 0.0


def test_clusters(spark):
    matrix = matrix_of(spark, COLUMNS)
    single = selection.cluster_factors(matrix, 1).orderBy("factor_id").collect()
    assert {r["cluster"] for r in single} == {0} and single[0]["dist"] == pytest.approx(0.0, abs=1e-6)
    assert single[2]["dist"] > 1  # measured from factor 0, not from the mean
    several = selection.cluster_factors(matrix, 4).toPandas()
    assert sorted(several["cluster"].unique()) == [0, 1, 2, 3]
    by_name = several.set_index("factor")["cluster"]
    assert by_name["a"] == by_name["2 * a."] == 0
    again = selection.cluster_factors(matrix, 4).toPandas()
    assert list(again["cluster"]) == list(several["cluster"])
    assert selection.cluster_factors(matrix.select("date", "symbol"), 3).count() == 0


def test_exemplars_take_turns(spark):
    rows = [(0, "a", 0, 1.0), (1, "b", 0, 0.5), (2, "c", 0, 0.5), (3, "d", 1, 9.0)]
    groups = spark.createDataFrame(rows, selection.CLUSTERS)
    ids = [r["factor_id"] for r in selection.select_exemplars(groups, 3).orderBy("place").collect()]
    assert ids == [1, 3, 2]
    assert selection.select_exemplars(groups, 0).count() == 0


# ---- sources and sinks ----


def test_key_discovery():
    assert panel_io.key_columns(["x", "Calc_Date", "time", "CODE", "symbol"]) == ("Calc_Date", "CODE")
    with pytest.raises(ValueError):
        panel_io.key_columns(["date", "price"])


def test_load_panel_formats(spark, tmp_path):
    for suffix in ("csv", "txt"):
        path = tmp_path / f"bars.{suffix}"
        path.write_text("Trade_Date,ticker,close\n2024-01-02,A,1.5\n2024-01-01,B,2\n")
        loaded = panel_io.load_panel(spark, str(path), check_keys=True)
        assert loaded.columns == ["date", "symbol", "close"] and loaded.count() == 2
    with pytest.raises(ValueError, match="unsupported"):
        panel_io.load_panel(spark, "bars.xlsx")


def test_factor_set_round_trip(spark):
    path = scratch_path(spark, "set")
    assert factor_sets.read_factor_set(spark, path).count() == 0
    factors = table(spark, ["RANK(CLOSE - OPEN)", "alpha001"])
    for format in ("json", "parquet"):
        factor_sets.write_factor_set(factors, f"{path}-{format}", format)
        back = factor_sets.read_factor_set(spark, f"{path}-{format}", format).orderBy("pos").collect()
        assert [r["expression"] for r in back] == ["RANK(CLOSE - OPEN)", "alpha001"]


def test_factor_values_round_trip(spark):
    path = scratch_path(spark, "values")
    matrix = matrix_of(spark, COLUMNS)
    factor_sets.write_factor_values(matrix, path)
    one = factor_sets.read_factor_values(spark, path, ["2 * a."])
    assert one.count() == 6 and {r["factor"] for r in one.collect()} == {"2 * a."}
    assert factor_sets.read_factor_values(spark, path).where("value is null").count() == 1


def test_long_and_wide(spark):
    matrix = matrix_of(spark, {"a": [1.0, None], "b.c": [3.0, 4.0]})
    long = panel.to_long(matrix)
    assert long.count() == 4
    assert panel.to_wide(long, ["a", "b.c"]).orderBy("symbol").collect() == matrix.orderBy("symbol").collect()


def test_registered_operator_must_declare_lookback():
    with pytest.raises(ValueError):
        registry.register_operator("X", lambda x, over: x, by="symbol")

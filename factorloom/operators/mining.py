"""One step of factor mining, from a panel and a library of expressions to a prompt and a longer library.

Each stage is a stored table named after a digest of everything it was made
from: the rows of the panel, the expressions, the parameters.  A step that is
started again, with the same inputs, reads what is complete and continues
behind the last complete stage; a changed parameter rebuilds from its stage on.
A stage counts as complete when its writer's success mark is there, so a table
that a lost job left half written is written anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.operators import chains, factors, library, panel as panels, selection

# Distances to a cluster's centre that agree to so many digits are ties.
DISTANCE_DIGITS = 3


def table_digest(df: DataFrame) -> str:
    """Digest of a table's columns and rows, whatever their order; one aggregate row comes back."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    row = [F.xxhash64(F.lit(seed), *cols, *[c.isNull() for c in cols]) for seed in (1, 2)]
    sums = [F.sum(r.cast("decimal(38,0)")) for r in row]
    told = df.agg(F.count(F.lit(1)), *sums, *[F.bit_xor(r) for r in row]).first()
    return _digest(df.dtypes, [str(x) for x in told])


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:20]


class Stages:
    """Stored stage tables in one folder; ``built`` names those that had to be made."""

    def __init__(self, spark, folder: str):
        self._spark, self._folder = spark, folder
        self.built: list[str] = []

    def table(self, name: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self._folder}/{name}-{key}"
        if not self._complete(path):
            build().write.mode("overwrite").parquet(path)
            self.built.append(name)
        return self._spark.read.parquet(path)

    def _complete(self, path: str) -> bool:
        jvm = self._spark.sparkContext._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


@dataclass(frozen=True)
class Step:
    """Tables of one step, and the stages that were computed for it."""

    matrix: DataFrame  # date, symbol, f0, f1, ...: one column per distinct expression
    clusters: DataFrame  # factor_id, factor, cluster, dist
    exemplars: DataFrame  # place, factor_id, expression, cluster, turn, score
    chains: DataFrame  # run_id, chain_id, pos, expression
    prompt: DataFrame  # run_id, ops, cards, checksum, prompt
    built: list[str]


def mining_step(
    panel: DataFrame,
    expressions: DataFrame,
    folder: str,
    *,
    k: int = 12,
    n: int = 24,
    whitelist: Iterable[str] = (),
    deny_fields: Iterable[str] = (),
    max_new: int = library.DEFAULT_MAX_NEW,
    run: int = 0,
) -> Step:
    """Factor matrix, ``k`` clusters, ``n`` exemplars, their chains and the prompt that shows them.

    ``expressions``: ``pos, name, expression``, a library of a size that one plan
    evaluates.  An exemplar's score is its mean absolute value over the panel;
    the prompt shows all exemplars and the chain of the highest scores.
    """
    spark = panel.sparkSession
    listed = [r["expression"].strip() for r in expressions.orderBy("pos").select("expression").collect()]
    listed = list(dict.fromkeys(listed))
    stages = Stages(spark, folder)
    allowed = sorted(set(whitelist))
    names = {e: f"f{i}" for i, e in enumerate(listed)}

    key = _digest(table_digest(panel), listed)
    matrix = stages.table("matrix", key, lambda: _matrix(panel, names))
    key = _digest(key, "clusters", k)
    clusters = stages.table("clusters", key, lambda: selection.cluster_factors(matrix, k))
    key = _digest(key, "exemplars", n, DISTANCE_DIGITS)
    exemplars = stages.table("exemplars", key, lambda: _exemplars(matrix, clusters, names, n))
    key = _digest(key, "chains", run)
    chained = stages.table("chains", key, lambda: _chains(exemplars, run))
    fields = panels.allowed_inputs(panel, deny_fields)
    key = _digest(key, "prompt", fields, allowed, max_new)
    prompt = stages.table("prompt", key, lambda: _prompt(exemplars, chained, fields, allowed, max_new, run))
    return Step(matrix, clusters, exemplars, chained, prompt, stages.built)


def _matrix(panel: DataFrame, names: dict[str, str]) -> DataFrame:
    made = factors.compute_factors(panel, list(names))
    # A named factor's column is its lower-case token.
    label = {e: (e.lower() if e.lower() in made.columns else e) for e in names}
    return made.select(*panels.KEYS, *[F.col(f"`{label[e]}`").alias(f) for e, f in names.items()])


def _exemplars(matrix: DataFrame, clusters: DataFrame, names: dict[str, str], n: int) -> DataFrame:
    spark = matrix.sparkSession
    near = clusters.withColumn("dist", F.round("dist", DISTANCE_DIGITS))
    chosen = selection.select_exemplars(near, n)
    texts = spark.createDataFrame([(f, e) for e, f in names.items()], "factor string, expression string")
    sizes = matrix.agg(*[F.avg(F.abs(f)).alias(f) for f in names.values()])  # one row
    scores = sizes.unpivot([], list(names.values()), "factor", "score")
    kept = chosen.join(F.broadcast(texts), "factor").join(F.broadcast(scores), "factor", "left")
    return kept.select("place", "factor_id", "expression", "cluster", "turn", F.coalesce("score", F.lit(0.0)).alias("score"))


def _chains(exemplars: DataFrame, run: int) -> DataFrame:
    rows = exemplars.select(
        F.lit(run).alias("run_id"), F.col("place").cast("long").alias("pos"), F.col("expression").alias("name"), "expression",
        F.round("score", 9).alias("score"),
    )
    return chains.initial_chains(rows.drop("score"), rows.select("run_id", "name", "score"))


def _prompt(exemplars, chained, fields, whitelist, max_new, run) -> DataFrame:
    shown = exemplars.select(F.lit(run).alias("run_id"), F.col("place").cast("long").alias("pos"), "expression")
    path = chained.where("chain_id = 0").select("run_id", F.col("pos").cast("long").alias("pos"), "expression")
    return library.prompt_context(shown, path, fields, whitelist, max_new)


def take_replies(
    expressions: DataFrame, replies: DataFrame, fields: Iterable[str] = (), operators: Iterable[str] | None = None
) -> DataFrame:
    """The library with the valid new expressions of ``replies`` (``pos, text``) behind it, each once."""
    lines = library.parse_responses(replies.select("pos", "text"))
    valid = library.validate_candidates(lines, fields, operators)
    place = F.col("pos").cast("decimal(20,0)") * F.lit(1 << 32) + F.col("line")
    ordered = valid.select(place.alias("pos"), "expression")
    return library.append_candidates(expressions, ordered, dedupe=True)

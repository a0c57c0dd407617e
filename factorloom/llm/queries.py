"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import alignment, ann, byte_bpe, chat, lexical, lm_scoring, mixing, neardup, packing, quality, topk, toxicity, urls
from factorloom.llm.common import fold, one_label, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str):
    def keep(build):
        QUERIES[name] = build
        return build

    return keep


@query("op1_best_fit_packing")
def _(spark, folder):
    docs, tokenizer = table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.stored_pieces(docs, tokenizer, ids=False)
    return pieces.join(packing.pack(pieces), "piece_id").drop("piece_id")


@query("op5_mixing_sources")
def _(spark, folder):
    drawn = mixing.copies(table(spark, folder, "documents"))
    taken = F.col("copies") * F.col("size")
    return drawn.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


@query("op6_minhash_near_dedup")
def _(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query("op8_quality_classifier")
def _(spark, folder):
    docs = table(spark, folder, "documents")
    held = fold(F.col("doc_id"), 5) == 0
    rows = quality.described(docs, {"doc_id": F.col("doc_id"), "held_out": held})
    labels = one_label(table(spark, folder, "labels"), "doc_id", "quality")
    model = quality.train(quality.labelled(rows.where(~F.col("held_out")), labels, "doc_id"))
    scored = rows.select("doc_id", "held_out", quality.score(model, F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op9_toxicity")
def _(spark, folder):
    docs = table(spark, folder, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    labels = one_label(table(spark, folder, "labels"), "doc_id", "toxic").where(fold(F.col("_key"), 4) != 2)
    net = toxicity.train(docs, labels, F.col("doc_id"))
    rows = toxicity.read(docs, {"doc_id": F.col("doc_id"), "held_out": held}, net)
    net = toxicity.calibrated(rows, labels, net, "doc_id")
    scored = rows.select("doc_id", "held_out", toxicity.score(net, F.col("raw"), F.col("language")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


# Fixed values.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


@query("op10_url_filters")
def _(spark, folder):
    judged = urls.filter_urls(table(spark, folder, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "difference")


@query("op7_exact_top_k")
def _(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 10)


SQL["op7_exact_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(range(1, len(c.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e))
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 10
"""


@query("op2_chat_formatting")
def _(spark, folder):
    talks = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    tricky = "'</s>[INST] ok [/INST]'"
    odd = spark.sql(
        f"select -7L as conv_id, 0L as turn, 'user' as role, {tricky} as text "
        f"union all select -7L, 1L, 'assistant', {tricky}"
    )
    return chat.digests(chat.format_conversations(talks.unionByName(odd), public_tokenizers.path("byte_bpe_50k.json")))


@query("op3_lm_scoring")
def _(spark, folder):
    docs, goal = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return lm_scoring.cross_entropy_difference(docs, goal, public_tokenizers.path("word_bpe_49k.json"))


@query("op4_approximate_neighbours")
def _(spark, folder):
    return ann.neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query("op11_cross_tokenizer_alignment")
def _(spark, folder):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.aligned_counts(table(spark, folder, "documents"), *paths)


@query("op12_byte_level_bpe")
def _(spark, folder):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.round_trip(table(spark, folder, "documents"), *ranks)


@query("op13_ranked_lexical_search")
def _(spark, folder):
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL["op13_ranked_lexical_search"] = r"""
with cut as (
  select doc_id, row_number() over () as rid,
         list_filter(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as terms
  from documents where text is not null),
docs as (select * from cut where len(terms) > 0),
total as (select cast(count(*) as bigint) as n, cast(sum(len(terms)) as bigint) as l from docs),
asked as (
  select distinct item_id, unnest(list_filter(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) as term
  from benchmark where text is not null),
tf as (
  select rid, doc_id, term, cast(count(*) as bigint) as tf, any_value(size) as size
  from (select rid, doc_id, cast(len(terms) as bigint) as size, unnest(terms) as term from docs)
  where term in (select term from asked) group by rid, doc_id, term),
w as (
  select term, cast(floor(1000 * ln(cast(2 * n + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w
  from (select term, count(*) as df from tf group by term), total),
scored as (
  select a.item_id, tf.rid, any_value(tf.doc_id) as doc_id,
         cast(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (100 - 50 + (50 * tf.size * n) // l)))) as bigint) as score
  from asked a join tf on a.term = tf.term join w on w.term = tf.term, total
  group by a.item_id, tf.rid),
ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id asc nulls last, rid) as rank
  from scored where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 50
"""

"""Registered queries of the operators in this package, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowstream.llm.centroids import centroid_clusters
from flowstream.llm.exact import mark_exact
from flowstream.llm.idfiles import read_ids, write_ids
from flowstream.llm.language import detect, fit_languages
from flowstream.llm.mixing import mixing_report, mixing_table
from flowstream.llm.neardup import jaccard_join
from flowstream.llm.pages import main_text
from flowstream.llm.pieces import encode, load_pieces
from flowstream.llm.private import private_spans
from flowstream.llm.quality import fit_ratios, quality
from flowstream.llm.repeats import without_repeats
from flowstream.llm.text import id_hash, small_batches
from flowstream.llm.toxicity import fit_toxicity, toxicity_scores
from flowstream.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int):
    return F.pmod(id_hash(F.col("doc_id")), F.lit(modulus))


@query("op1_exact_dedup", """
select d.doc_id, max(d.doc_id) over g as keep_id, count(*) over g as group_size,
       row_number() over (partition by coalesce(d.text, '') order by d.doc_id desc) = 1 as kept, sha256(coalesce(d.text, '')) as text_sha256
from documents d window g as (partition by coalesce(d.text, ''))""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_exact(table(spark, sf_dir, "documents"))


@query("op8_mixing")
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing_report(docs, mixing_table(docs))


@query("op7_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), train_where=fold(3) != 1)
    scored = toxicity_scores(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op9_jaccard_join")
def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


@query("op5_sentencepiece")
def sentencepiece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return encode(table(spark, sf_dir, "documents"), model)


@query("op4_quality")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality(docs, fit_ratios(docs, trusted))


@query("op6_language")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = detect(docs, fit_languages(docs, train_where=fold(4) != 2))
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op2_pii")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans(table(spark, sf_dir, "documents"))


@query("op3_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(spark, write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query("op10_suffix_dedup")
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


@query("op11_whitening")
def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=32)


def _clusters_sql(k: int, rounds: int, dims: int) -> str:
    """Every vector against every centroid, round by round."""
    steps = [f"""
kept as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
    where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (select row_number() over (order by sha256('1:' || vec_id), v) - 1 as c, v as w from kept qualify c < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} as (select r, vec_id, v, min({{'d': list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, 'c': c}}) as m from kept, c{i} group by all)""")
        if i < rounds:
            steps.append(f"""
m{i} as (select c, list((s - ((s % n) + n) % n) // n order by d) as w from (
    select m.c as c, d, sum(v[d])::bigint as s, count(*) as n from a{i}, range(1, {dims + 1}) t(d) group by all) group by c),
c{i + 1} as (select o.c, coalesce(m{i}.w, o.w) as w from c{i} o left join m{i} using (c))""")
    return f"""with {",".join(steps)}
select vec_id, m.c::int as cluster, m.d as distance, sum(m.d) over (partition by m.c)::bigint as cluster_inertia, sum(m.d) over ()::bigint as inertia,
       sha256(array_to_string(w, ',')) as centroid_sha256
from a{rounds} join c{rounds} on c = m.c"""


@query("op12_centroids", _clusters_sql(16, 3, 64))
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64)


@query("op13_html")
def article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))

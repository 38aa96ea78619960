"""Registered queries of the operators: thin applications with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierscope.llm import collocations, cover_tree, html_template, language_id, merkle, packing, pii, quality_lm, quality_rules, retrieval_packing, simhash, tokens, url_graph
from tierscope.sources.tables import read_table

def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


ORACLES["op1_quality_rules"] = quality_rules.oracle_sql()


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digests(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(read_table(spark, sf_dir, "pages"))


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents"))


@query
def op7_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge(read_table(spark, sf_dir, "pages"))


ORACLES["op7_url_graph"] = url_graph.oracle_sql()


@query
def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(read_table(spark, sf_dir, "embeddings"))


# Exact by brute force: all pairs of valid vectors of a label, then reachability.
ORACLES["op6_cover_tree"] = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
g as (select * from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from g a join g b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
      where list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) as (select vec_id, vec_id from v union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as component_id from r group by a)
select vec_id, (select count(*) from l where l.a = v.vec_id) as n_links, component_id, vec_id = component_id as kept from v join c on c.a = v.vec_id
"""


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = collocations.oracle_sql()


@query
def op12_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing.digests(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(read_table(spark, sf_dir, "documents"))


ORACLES["op13_merkle_manifest"] = merkle.oracle_sql()

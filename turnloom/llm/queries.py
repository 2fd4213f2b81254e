"""The registered queries of the package, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import chat_tree, dart_minhash, dual_tree, maxent_lm, mixing, multiprobe, piece_codec, pivot_topk, source_audit, token_files, toxicity, tree_forest, url_filter

QUERIES = {}

RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"),
         url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.severity_of(table(spark, folder, "documents"), table(spark, folder, "labels"), passing=["doc_id"])


@query
def op2_maxent_lm(spark: SparkSession, folder: str) -> DataFrame:
    return maxent_lm.score_texts(table(spark, folder, "documents"))


@query
def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose texts are made of control strings."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    index, tree = chat_tree.prefix_tree(turns.unionByName(tricky), tokenizer_file("byte_bpe_50k.json"))
    return chat_tree.read_conversations(index, tree, tokenizer_file("byte_bpe_50k.json"))


@query
def op4_pivot_topk(spark: SparkSession, folder: str) -> DataFrame:
    return pivot_topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op5_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return piece_codec.encode_and_decode(documents, tokenizer_file("piece_bpe_32k.model"))


@query
def op6_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return dart_minhash.classes(table(spark, folder, "documents"))


@query
def op7_multiprobe_search(spark: SparkSession, folder: str) -> DataFrame:
    return multiprobe.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture_report(table(spark, folder, "documents"))


@query
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_file_report(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


@query
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Listed: the canonical form of every address that was met with a tracking parameter."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    tracked = pages.where(F.col("url").rlike(r"[?&](utm_source|ref)="))
    listed = tracked.select(url_filter.canonical(url_filter.host_of("url"), url_filter.path_of("url")).alias("key"))
    judged = url_filter.filter_urls(pages, listed, RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op11_dual_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    return dual_tree.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op12_tree_forest(spark: SparkSession, folder: str) -> DataFrame:
    return tree_forest.near_duplicates(table(spark, folder, "embeddings"))


@query
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_audit.divergence(table(spark, folder, "documents"))

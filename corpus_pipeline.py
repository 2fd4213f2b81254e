"""The corpus pipeline: toxic documents go, one document of each group of near-duplicates stays, sources are mixed to
target weights, and the mixture is encoded to piece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm import dart_minhash, mixing, piece_codec, toxicity
from turnloom.llm.common import keep
from turnloom.llm.queries import table, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an expected severity under the cut, by a model fitted on labelled documents among them."""
    scored = toxicity.severity_of(docs, table(spark, sf_dir, "labels"))
    return scored.where("NOT rejected").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id."""
    return dart_minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture; one that is taken twice is there twice."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids in place of each text, and whether they decode to it."""
    return piece_codec.encode_and_decode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mix_sources", mix_sources),
          ("piece_codec", encode_pieces)]
#: SQL can neither fit the severity model nor sign texts; tests/llm checks each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

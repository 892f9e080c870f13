"""A training corpus from ``documents``: each stage takes what the one before it kept, written and read again.

toxicity      drops documents that the lexicon takes as toxic
near_dedup    keeps the least doc_id of each group of near duplicates (five words, similarity 0.8)
personal_data replaces personal data by its kind in brackets
mixing        takes documents, some of them several times, so that the sources meet their target weights
byte_pairs    encodes the texts; decoding them again gives every text back (``round_trip``)
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from locusloom.llm import bpe, mixing, near_dedup, pii, toxicity
from locusloom.llm.common import stage, table
from locusloom.llm.queries import tokenizer_content


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each_group(docs, width=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def _tokens(ids: list[list[int]], texts: list[str]) -> list[pa.Array]:
    return [pa.array(ids, type=pa.list_(pa.int32())), pa.array([len(r) for r in ids], type=pa.int64()), pa.array(texts, type=pa.string())]


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = bpe.Outputs({"ids": "array<int>", "n_tokens": "bigint", "decoded": "string"}, _tokens)
    rows = bpe.tokenized(docs, tokenizer_content(), made)
    same = "coalesce(text, '') = decoded AS round_trip"
    return rows.selectExpr("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", same)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("byte_pairs", encode),
]

#: The lexicon, the mix and the tokens aren't SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

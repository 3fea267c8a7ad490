"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import blocks, bpe, flatgraph, hostrules, importance, langid, linededup, minhash, mixing, oracles, token_counts


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(spark, _read(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.main_text(_read(spark, sf_dir, "pages"), ["page_id", "url"])


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, _read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op7_hostrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(spark, _read(spark, sf_dir, "documents"))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(spark, _read(spark, sf_dir, "documents"))


def op9_flatgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatgraph.near_duplicates(spark, _read(spark, sf_dir, "embeddings"))


def op10_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_blocks": op2_blocks,
    "op3_bpe": op3_bpe,
    "op4_minhash": op4_minhash,
    "op5_token_counts": op5_token_counts,
    "op6_langid": op6_langid,
    "op7_hostrules": op7_hostrules,
    "op8_linededup": op8_linededup,
    "op9_flatgraph": op9_flatgraph,
    "op10_importance": op10_importance,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.plan_sql(),
    "op4_minhash": oracles.MINHASH,
    "op7_hostrules": hostrules.SQL,
    "op8_linededup": oracles.LINEDEDUP,
    "op9_flatgraph": oracles.FLATGRAPH,
}

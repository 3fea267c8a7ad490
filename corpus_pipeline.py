"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns the columns of documents; the last returns token digests.

Defined results of the stages: extra columns, whatever their names, are kept by all but the last;
ids may be null or repeated, and each row has a verdict of its own; an empty table gives an
empty one. A null or empty text is kept or rejected by the quality classifier like any other
(its log ratio is 0), stays in line dedup if nothing was cut, links with nothing in near-dedup,
takes no words in mixing, so that it comes as often as its source's certain copies, and has
no tokens. Of repeated rows line dedup cuts the lines of the later ones, and near-dedup keeps one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, importance, linededup, minhash, mixing, queries
from loomgraph.llm._scratch import Scratch, numbered
from loomgraph.llm._text import n_words

#: Up to so many keys (8 bytes each) are broadcast; more are joined by a shuffle.
_BROADCAST_KEYS = 1_000_000


#: The number of a row in its stage: ids may be null or repeated.
_ROW = "_loom_row"


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of numbered ``docs`` but those of ``gone``, without their numbers."""
    gone = Scratch(docs.sparkSession, "verdicts").save(gone.select(_ROW), "rejected")
    if gone.count() <= _BROADCAST_KEYS:
        gone = F.broadcast(gone)
    return docs.join(gone, _ROW, "left_anti").drop(_ROW)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = numbered(Scratch(spark, "quality"), docs, _ROW)
    return _without(docs, importance.resample(spark, docs, labels, row=_ROW).filter("NOT kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go, and documents of which nothing is left."""
    cleaned = linededup.clean(spark, docs)
    left = cleaned.filter((F.col("n_cut") == 0) | (n_words(F.col("text")) > 0))
    size = F.when(F.col("n_cut") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", size).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, null last; of rows with equal ids one."""
    scratch = Scratch(spark, "near-dedup")
    docs = numbered(scratch, docs, _ROW)
    found = scratch.save(minhash.near_duplicates(spark, docs, key=_ROW).select(_ROW, "component_id"), "components")
    order = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", _ROW)
    first = found.join(docs.select(_ROW, "doc_id"), _ROW).groupBy("component_id").agg(F.min(order).alias("o")).select(F.col(f"o.{_ROW}"))
    return _without(docs, found.join(first, _ROW, "left_anti"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; rows are repeated as the mix takes them."""
    return mixing.mix(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of each row."""
    return bpe.digests(docs, queries.tokenizer("word_bpe_49k.json"), cache_bytes=16 << 20)  # the heap is full by now


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("mixing sources", mix),
    ("bpe encoding", encode),
]

#: Numpy models and hashes decide in these stages; SQL can't express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

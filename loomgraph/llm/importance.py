"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, one of target texts (documents labelled
good), one of all texts, give each document the log of the ratio of its chances.
Gumbel noise is added and the k largest sums are kept, which samples k documents
without replacement in proportion to the ratio. k follows from the share of good
documents among the labelled ones, unless it is given.

N-grams are single words, pairs of words, and runs: a word after itself counts as one
n-gram whatever the word. Words are runs of letters and digits, or of signs, in lower
case. Both models count all texts; target texts are the labelled ones, up to a bound. The counts
have a fixed size, and partial sums are added up in Spark.

Defined results: a null or empty text has no n-grams and log ratio 0; rows without a
label belong to the raw texts only; a label or a document with a null key labels
nothing; a document with several labels is good if any says so; repeated rows have
equal scores, and equal noise if their keys are equal; extra columns are not read;
an empty table gives an empty table; without good labels all ratios are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import _textvec as tv
from loomgraph.llm._counts import summed
from loomgraph.llm._ordered_cut import ordered_cut
from loomgraph.llm._scratch import Scratch, ship
from loomgraph.llm._worker import lean
from loomgraph.llm.mixing import uniform

#: Hash buckets of each model; the last one counts runs of one word.
BUCKETS = 1 << 16
_RUN = BUCKETS - 1

#: Class of each byte: 0 white space, 1 letters and digits (and all of UTF-8 beyond ASCII), 2 signs.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = 0


def _tokens(buf: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens and for each row the index of its first token, one more at the end."""
    kind = _CLASS[buf]
    change = np.ones(len(buf) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[offsets] = True
    edges = np.flatnonzero(change)
    begin, end = edges[:-1], edges[1:]
    keep = kind[begin] > 0
    begin, end = begin[keep], end[keep]
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * tv._powers(tv._BASE, len(buf)), out=total[1:])
    hashes = tv.mix((total[end] - total[begin]) * tv._powers(tv._INVERSE, len(buf))[begin] + (end - begin).astype(np.uint64))
    return hashes, np.searchsorted(begin, offsets)


def _features(buf: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, row by row, and the offsets of the rows."""
    hashes, first = _tokens(buf, offsets, values)
    shift = np.uint64(64 - 16)
    one = ((hashes * np.uint64(0x9FB21C651E98DF25)) >> shift).astype(np.int64)
    two = np.full(len(hashes), -1, np.int64)
    if len(hashes) > 1:
        pair = tv.mix(hashes[:-1] * tv._BASE + hashes[1:]) >> shift
        two[:-1] = np.where(hashes[:-1] == hashes[1:], _RUN, pair.astype(np.int64))
        two[first[1:-1][first[1:-1] > 0] - 1] = -1  # a pair doesn't cross rows
    both = np.stack([one, two], axis=1).ravel()
    return both, first * 2


def _slices(column: pa.Array):
    buf, offsets = tv.buffers(column)
    values = tv.byte_values(lower=True)
    for a, b in tv.row_slices(offsets):
        yield a, b, _features(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], values)


def models(docs: DataFrame, good: DataFrame, key: str = "doc_id", text: str = "text", smooth: float = 1.0) -> np.ndarray:
    """Log ratio of target to raw chance for each bucket.

    :param good: column ``key``, distinct: the keys of target documents, few enough to be broadcast.
    """
    ship(docs.sparkSession)

    def count(batch: pa.RecordBatch, counters: np.ndarray) -> None:
        marked = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, (found, offsets) in _slices(batch.column(0)):
            counters[:BUCKETS] += np.bincount(found + 1, minlength=BUCKETS + 1)[1:]
            mask = np.repeat(marked[lo:hi], np.diff(offsets))
            counters[BUCKETS:] += np.bincount(found[mask] + 1, minlength=BUCKETS + 1)[1:]

    marks = F.broadcast(good.select(F.col(key).alias("_good"), F.lit(True).alias("_is")))  # bounded by the caller
    marked = docs.join(marks, docs[key] == marks["_good"], "left").select(F.col(text), F.coalesce("_is", F.lit(False)).alias("good"))
    raw, target = summed(marked, 2 * BUCKETS, count).astype(float).reshape(2, BUCKETS)
    if not target.sum():
        return np.zeros(BUCKETS)
    chance = lambda x: np.log((x + smooth) / (x.sum() + smooth * BUCKETS))
    return chance(target) - chance(raw)


def log_ratios(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text", row: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, the columns ``row`` and ``log_ratio``, the sum of the log ratios of its n-grams."""
    ship(docs.sparkSession)
    named = [key, *row]
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in named), T.StructField("log_ratio", T.DoubleType())])
    table = np.concatenate([[0.0], weights])

    def run(batches):
        for b in batches:
            out = np.zeros(b.num_rows)
            for lo, hi, (found, offsets) in _slices(b.column(len(named))):
                total = np.concatenate([[0.0], np.cumsum(table[found + 1])])
                out[lo:hi] = total[offsets[1:]] - total[offsets[:-1]]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(named)], pa.array(out)], names=schema.names)

    return docs.select(*named, F.col(text)).mapInArrow(lean(run), schema)


def resample(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", keep: int | None = None, max_labelled: int = 500_000, seed: int = 1, row: str | None = None) -> DataFrame:
    """Per row: key, ``row`` if named, log_ratio, gumbel_key (with noise), kept.

    :param labels: key and ``quality`` (1: good).
    :param keep: number of rows to keep; None: the share of good among labelled documents, of all rows.
    :param row: a column of ``docs`` that tells rows with equal keys apart.
    :param max_labelled: the target model is fitted on about so many good labelled documents at most, those of the
        least random numbers. Their keys (8 bytes each) are broadcast. The raw model always counts all rows.
    """
    scratch = Scratch(spark, "importance")
    known = labels.filter(F.col(key).isNotNull() & F.col(quality).isNotNull()).groupBy(key).agg(F.max(quality).alias("q"))
    good = scratch.save(known.filter("q = 1").select(key), "good")
    if (n_good := good.count()) > max_labelled:
        good = good.filter(uniform(F.col(key), seed + 1) < max_labelled / n_good)
    weights = models(docs, good, key, text)
    named = [key] if row is None else [key, row]
    scored = log_ratios(docs, weights, key, text, tuple(named[1:]))
    noise = -F.log(-F.log((uniform(F.col(key), seed) * float((1 << 52) - 2) + 1) / float(1 << 52)))
    scored = scored.withColumn("gumbel_key", F.col("log_ratio") + noise)
    z = F.col("gumbel_key")
    scored = scratch.save(scored.withColumns({"at": (1 - z / (1 + F.abs(z))) / 2, "one": F.lit(1).cast("long"), "g": F.lit(0), "apart": uniform(F.concat_ws(":", *named), seed + 2)}), "scored")
    if keep is None:
        n, share = scored.count(), known.agg(F.avg((F.col("q") == 1).cast("double"))).first()[0]
        keep = n if share is None else round(n * share)
    budgets = spark.range(1).select(F.lit(0).alias("g"), F.lit(float(keep)).alias("budget"))
    cut = ordered_cut(scratch, scored, budgets, "g", ["at", "apart"], "one")
    scratch.keep_only(scored, *scratch.named("last"))
    return cut.select(*named, "log_ratio", "gumbel_key", F.col("chosen").alias("kept"))

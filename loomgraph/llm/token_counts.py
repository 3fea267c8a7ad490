"""Token counts from distinct pre-tokens, without ids.

A text is cut into pre-tokens, pieces of text that no merge can cross. The pieces
of each distinct pre-token are counted once, joined to the pre-token frequencies of
each document and summed; no ids are made.

Frequent pre-tokens (the head) are found first, by summaries of a fixed size that
each task makes of all its texts: whatever has more than two in ``summary`` of all
pre-tokens is among them. Their counts, ``head`` keys of 64 characters at most, are
broadcast, so most frequencies are summed where they are made. The rest is dealt and
sorted by pre-token, so that each is counted once where its rows meet, and its counts
go back to the documents' rows. Any head gives the same result, and the plan is the
same at every size. A pre-token of more than 64 characters has its SHA-256 as key and
is counted by each task that meets it, so no long text is shuffled.

Defined results: a null text has no tokens and no bytes; an empty text the same;
repeated rows (each has its own result), null keys, ties and extra columns change
nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm._scratch import Scratch, numbered, ship
from loomgraph.llm._worker import lean

_MARK = "▁"  # stands for a space in pieces
_PRE_TOKEN = re.compile(f"{_MARK}+[^{_MARK}]*")
_LONGEST_KEY = 64
_AT_ONCE = 1 << 20
#: Keys of the head, and keys of the summary of one task.
HEAD, SUMMARY = 200_000, 50_000
#: Rows of one batch that a task hands on.
_BATCH_ROWS = 100_000
_ROW = "_loom_row"


def pre_tokens(text: str | None) -> Iterable[str]:
    """The pre-tokens of a text; those of a long one are made one at a time."""
    if not text:
        return []
    marked = _MARK + text.replace(" ", _MARK)
    return _PRE_TOKEN.findall(marked) if len(text) <= _AT_ONCE else (m[0] for m in _PRE_TOKEN.finditer(marked))


def key_of(pre_token: str) -> str:
    """The pre-token itself, which begins with a space mark, or the digest of a long one, which doesn't."""
    return pre_token if len(pre_token) <= _LONGEST_KEY else hashlib.sha256(pre_token.encode()).hexdigest()


class PieceCounter:
    """Counts the pieces a sentencepiece BPE model gives a text.

    Exact for models that put a dummy space first, escape spaces, don't change
    the text otherwise, and have no piece with a space mark after another
    character: then no merge crosses the border before a run of space marks.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(self.model.get_piece_size()):
            if re.search(f"[^{_MARK}]{_MARK}", self.model.id_to_piece(i)):
                raise ValueError(f"piece {i} crosses a pre-token border")

    def pieces(self, pre_token: str) -> int:
        """Number of pieces of one pre-token, which begins with a space mark."""
        return len(self.model.encode(pre_token[1:])) if len(pre_token) > 1 else 1

    def count(self, text: str | None) -> int:
        return sum(n * self.pieces(p) for p, n in Counter(pre_tokens(text)).items())


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def _shrink(seen: Counter, size: int) -> Counter:
    """The ``size`` most frequent keys, each less the next one's frequency: what is lost of any key is a ``size``-th of all at most."""
    if len(seen) <= size:
        return seen
    top = seen.most_common(size + 1)
    return Counter({p: n - top[-1][1] for p, n in top if n > top[-1][1]})


def frequent(texts: DataFrame, path: str, head: int, summary: int) -> DataFrame:
    """From a column of texts: ``head`` frequent keys at most, with their number of pieces (columns pre, pieces)."""
    ship(texts.sparkSession)
    schema = T.StructType([T.StructField("pre", T.StringType()), T.StructField("n", T.LongType()), T.StructField("pieces", T.LongType())])

    def summarise(batches):
        seen = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(pre_tokens(t.as_py()))
                if len(seen) > 4 * summary:
                    seen = _shrink(seen, summary)
        seen = _shrink(seen, summary)
        known = [None if len(p) <= _LONGEST_KEY else counter(path).pieces(p) for p in seen]
        yield pa.RecordBatch.from_arrays([pa.array(map(key_of, seen), pa.string()), pa.array(seen.values(), pa.int64()), pa.array(known, pa.int64())], names=schema.names)

    def count(batches):
        c = counter(path)
        for b in batches:
            n = [c.pieces(p) if known is None else known for p, known in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=schema.names)

    met = texts.mapInArrow(lean(summarise), schema).groupBy("pre").agg(F.sum("n").alias("n"), F.max("pieces").alias("pieces"))
    return met.orderBy(F.desc("n"), "pre").limit(head).repartition(16).mapInArrow(lean(count), schema).select("pre", "pieces")


def frequencies(docs: DataFrame, path: str, head: dict[str, int], key: str, text: str) -> DataFrame:
    """Of each row of numbered ``docs``: id, row, n_bytes, known (tokens of the head's pre-tokens), rest (pre, n and, of long ones, pieces)."""
    spark = docs.sparkSession
    ship(spark)
    rest = T.StructType([T.StructField("pre", T.StringType()), T.StructField("n", T.LongType()), T.StructField("pieces", T.LongType())])
    schema = T.StructType([
        T.StructField("id", docs.schema[key].dataType), T.StructField("row", T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("known", T.LongType()), T.StructField("rest", T.ArrayType(rest)),
    ])
    shared = spark.sparkContext.broadcast(head)

    def batch(b, start, known, ends, pre, n, long):
        entries = pa.StructArray.from_arrays([pa.array(pre, pa.string()), pa.array(n, pa.int64()), pa.array(long, pa.int64())], names=rest.names)
        part = b.slice(start, len(known))
        return pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(known, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], names=schema.names)

    def run(batches):
        counts = shared.value
        for b in batches:
            start, known, ends, pre, n, long = 0, [], [0], [], [], []
            for t in b.column(3):
                total = 0
                for p, k in Counter(pre_tokens(t.as_py())).items():
                    name = p if len(p) <= _LONGEST_KEY else key_of(p)
                    found = counts.get(name)
                    if found is None:
                        pre.append(name)
                        n.append(k)
                        long.append(counter(path).pieces(p) if name is not p else None)
                    else:
                        total += k * found
                known.append(total)
                ends.append(len(pre))
                if len(pre) >= _BATCH_ROWS:
                    yield batch(b, start, known, ends, pre, n, long)
                    start, known, ends, pre, n, long = start + len(known), [], [0], [], [], []
            yield batch(b, start, known, ends, pre, n, long)

    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    return docs.select(F.col(key).alias("id"), F.col(_ROW).alias("row"), size.alias("n_bytes"), F.col(text).alias("text")).mapInArrow(lean(run), schema)


def counted_once(rest: DataFrame, path: str) -> DataFrame:
    """From row, pre, n, pieces (of long ones): row and n_tokens of each entry, every distinct pre counted once."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        c, last, of_last = counter(path), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            runs = pc.run_end_encode(b.column(1))
            ends = runs.run_ends.to_numpy()
            starts = np.append(0, ends[:-1])
            pieces = []
            for p, known in zip(runs.values.to_pylist(), b.column(3).take(pa.array(starts)).to_pylist()):
                if p != last:
                    last, of_last = p, c.pieces(p) if known is None else known
                pieces.append(of_last)
            n = b.column(2).to_numpy() * np.repeat(np.array(pieces, np.int64), ends - starts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=schema.names)

    return rest.repartition("pre").sortWithinPartitions("pre").mapInArrow(lean(run), schema)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 4096, head: int = HEAD, summary: int = SUMMARY) -> DataFrame:
    """Per row: ``key``, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-counts")
    docs = numbered(scratch, docs, _ROW)
    first = {r["pre"]: r["pieces"] for r in frequent(docs.select(F.col(text)), path, head, summary).collect()}
    summed = scratch.save(frequencies(docs, path, first, key, text), "summed")
    rest = counted_once(summed.select("row", F.explode("rest").alias("e")).select("row", "e.pre", "e.n", "e.pieces"), path)
    counted = summed.select("id", "row", "n_bytes", "known").join(rest.groupBy("row").agg(F.sum("n_tokens").alias("rest")), "row", "left")
    n = F.col("known") + F.coalesce("rest", F.lit(0))
    return counted.select(F.col("id").alias(key), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))

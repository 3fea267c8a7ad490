"""Repeated runs of lines, found with a suffix array and cut out.

Each document is a sequence of line IDs (lines without a word are passed over). A
suffix array orders all suffixes of these sequences. It is built by distributed prefix
doubling: the rank of a suffix by its first 2k lines follows from its rank by the
first k and the rank by the first k of the suffix k lines on; ranks are places in a
range-partitioned sort of the distinct pairs. Suffixes with equal ranks by the
first m lines make up an interval of the array with a longest common prefix of at
least m lines. In each interval the earliest suffix, by key and place, is the
original; in all the others these lines are later copies.

A run is cut if it has ``min_words`` words or more. A line has at least one word, so
doubling ends at ``min_words`` lines, whatever the data. A maximal repeated run of
enough words is the union of the shortest windows of enough words that start or end
in it, so windows are all that intervals are looked up for, and their union is exact.

Only suffixes whose first k lines occur twice go on to 2k: the others are alone in
their interval. Counts and first places are partial aggregates, joins on a common line
or run are skewed ones that adaptive execution splits, and windows of Spark are over
the lines of one document.

Only DataFrame functions are used. Lines are compared by 96 bits of hash, as their
words with one space between them.

Defined results: a null text stays null and has no lines; an empty text stays empty;
lines without a word are kept; a run that overlaps its own copy keeps its
first lines; repeated rows are documents of their own, in the order of their rows, so the
later ones are copies; null keys come first in order; extra columns are kept by :func:`clean`; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm._scratch import Scratch, numbered
from loomgraph.llm._text import n_words, n_words_spaced, spaced


#: A copy is met with the origin of its run in one of so many parts, so that a run found very often is no hot key.
_PARTS = 8
#: The number of a document's row.
ROW = "_loom_row"


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each line with a word: _key, _row, ord (place among them), raw (place among all lines), h1, h2, words."""
    all_lines = F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(spaced(x).alias("line"), i.alias("raw")))
    worded = F.filter(all_lines, lambda x: F.length(x["line"]) > 0)
    each = docs.select(F.col(key).alias("_key"), F.col(ROW).alias("_row"), F.posexplode(worded).alias("ord", "x"))
    line = F.col("x.line")
    return each.select("_key", "_row", "ord", F.col("x.raw").alias("raw"), F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"), n_words_spaced(line).cast("int").alias("words"))


def _ranked(scratch: Scratch, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs that occur twice, with ``rank``, a number that sorts as (a, b) does."""
    twice = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(a, b)
    placed = twice.repartitionByRange(a, b).sortWithinPartitions(a, b).withColumn("rank", F.monotonically_increasing_id())
    return scratch.save(placed, "ranks")


def suffix_ranks(scratch: Scratch, lines: DataFrame, depth: int) -> list[DataFrame]:
    """For k = 1, 2, 4, .. up to ``depth``: the suffixes whose first k lines occur twice, with their rank by these.

    Each table has the columns of a suffix (_row, ord, and at k = 1 _key, raw and words) and ``rank``.
    """
    ids = _ranked(scratch, lines, "h1", "h2")
    levels = [scratch.save(lines.join(ids, ["h1", "h2"]).drop("h1", "h2"), "suffixes")]
    k = 1
    while 2 * k <= depth:
        order = Window.partitionBy("_row").orderBy("ord")
        ahead = F.lead(F.struct("ord", "rank"), k).over(order)
        pairs = levels[-1].select("_row", "ord", F.col("rank").alias("r1"), ahead.alias("x"))
        pairs = scratch.save(pairs.filter(F.col("x.ord") == F.col("ord") + k).select("_row", "ord", "r1", F.col("x.rank").alias("r2")), "pairs")
        ranks = _ranked(scratch, pairs, "r1", "r2")
        levels.append(scratch.save(pairs.join(ranks, ["r1", "r2"]).drop("r1", "r2"), "suffixes"))
        k *= 2
    return levels


def _windows(suffixes: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs of enough words that start or that end at a line: _key, _row, start, m, raws."""
    seq = Window.partitionBy("_row").orderBy("ord")
    lined = suffixes.select("_key", "_row", "ord", "raw", "words", (F.sum("words").over(seq) - F.col("words")).alias("upto"))
    lined = lined.withColumn("past", F.col("upto") + F.col("words"))
    forth = Window.partitionBy("_row").orderBy("upto").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("_row").orderBy("past").rangeBetween(1 - min_words, 0)
    runs = []
    for frame in (forth, back):
        run = lined.select("_key", "_row", F.min("ord").over(frame).alias("start"), F.max("ord").over(frame).alias("end"), F.sum("words").over(frame).alias("w"), F.collect_list("raw").over(frame).alias("raws"))
        whole = (F.size("raws") == F.col("end") - F.col("start") + 1) & (F.col("w") >= min_words)
        runs.append(run.filter(whole).select("_key", "_row", "start", F.size("raws").alias("m"), "raws"))
    return runs[0].union(runs[1]).dropDuplicates(["_row", "start", "m"])


def later_copies(scratch: Scratch, docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """Lines to cut of documents numbered by ``ROW``: _row, cut (sorted places among all lines of the text).

    Documents without later copies have no row.
    """
    lines = scratch.save(_lines(docs, key, text), "lines")
    levels = suffix_ranks(scratch, lines, min_words)
    windows = _windows(levels[0], min_words)
    level = F.floor(F.log2("m")).cast("int")
    windows = scratch.save(windows.withColumns({"level": level, "second": (F.col("start") + F.col("m") - F.pow(F.lit(2), level)).cast("int")}), "windows")
    ranks = None
    for j, table in enumerate(levels):
        one = table.select("_row", "ord", F.lit(j).alias("level"), "rank")
        ranks = one if ranks is None else ranks.union(one)
    # the first and the last 2**level lines of a window, which overlap, stand for all of it
    at = lambda start, rank: ranks.select("_row", F.col("ord").alias(start), "level", F.col("rank").alias(rank))
    met = windows.join(at("start", "p"), ["_row", "start", "level"]).join(at("second", "q"), ["_row", "second", "level"])
    met = scratch.save(met.withColumn("part", F.pmod(F.xxhash64("_row"), F.lit(_PARTS)).cast("int")), "intervals")
    origin = met.groupBy("m", "p", "q").agg(F.min(F.struct("_key", "_row", "start")).alias("o"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    origin = origin.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    copies = met.join(origin, ["m", "p", "q", "part"]).filter((F.col("_row") != F.col("o._row")) | (F.col("start") != F.col("o.start")))
    gone = copies.select("_row", F.explode("raws").alias("raw"))
    return scratch.save(gone.groupBy("_row").agg(F.array_sort(F.collect_set("raw")).alias("cut")), "cuts")


def clean(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` with later copies of runs of lines cut out of ``text``, and ``n_cut``, the number of lines cut."""
    scratch = Scratch(spark, "linededup")
    rows = numbered(scratch, docs, ROW)
    cuts = later_copies(scratch, rows, key, text, min_words)
    scratch.keep_only(cuts)
    met = rows.join(cuts.hint("merge").select(F.col("_row").alias(ROW), F.col("cut").alias("_loom_cut")), ROW, "left")  # the same plan at any size
    cut = F.col("_loom_cut")
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(cut, i)), "\n")
    n_cut = F.coalesce(F.size(cut), F.lit(0)).cast("long")
    return met.select(*(F.when(cut.isNull(), F.col(text)).otherwise(left).alias(text) if c == text else F.col(c) for c in docs.columns if c != "n_cut"), F.greatest(n_cut, F.lit(0)).alias("n_cut"))


def digests(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """Per row: key, n_lines (of the text given, 0 if null), n_cut, n_words (left), text_sha256 (of the text left)."""
    held = docs.select(F.col(key), F.col(text), F.coalesce(F.size(F.split(F.col(text), "\n")), F.lit(0)).cast("long").alias("n_lines"))
    done = clean(spark, held, key, text, min_words)
    return done.select(key, F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), "n_cut", n_words(F.col(text)).alias("n_words"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_sha256"))

"""Near-duplicate documents by min-max hashing.

Each permutation of the shingles gives two signature values, its minimum and its
maximum, so a signature of 160 values costs 80 hash evaluations. Bands of four
minima, or of four maxima, from different permutations are bucket keys: two
documents of similarity 0.75 miss all 40 bands with a chance below 1e-6.

Documents with equal shingle sets form a class, and classes are linked. A bucket
doesn't emit its pairs. In rounds, a pivot of each bucket is compared with the
members that are not yet in the pivot's component; buckets within one component are
done. The first round takes a few bands only, so that a member of a group of copies meets
its pivot in a few buckets and not in all 40; the second takes what is still mixed in
all of them.

Buckets that are still mixed after these rounds hold documents that share a passage
and little else. Their documents are dealt anew by an exact rule: sorted from rare
to common shingles, two documents of similarity 0.75 share one of the first
n - ceil(0.75 n) + 1 of the larger and the first n - ceil(6/7 n) + 1 of the
smaller (there the pivots are). The order needs to be one for all but not exact, so
rareness is read from a table of counters of fixed size. The rounds go on over
these buckets, with more pivots each time, until all are done; nothing is capped.
Links are confirmed on the full shingle sets.

Defined results: null or empty texts and texts without words have no shingles
and link with nothing; a text of fewer than five words is one shingle; repeated
rows are copies of each other; a null key takes no part in the smallest key of a
component; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import _textvec as tv
from loomgraph.llm._components import components
from loomgraph.llm._counts import summed
from loomgraph.llm._scratch import Scratch, ship
from loomgraph.llm._worker import lean

_ROWS = 4
_PERMUTATIONS = 80
_FLIP = tv.stream(_PERMUTATIONS, 11)
_TIMES = tv.stream(_PERMUTATIONS, 12) | np.uint64(1)
_SALT = tv.stream(2 * _PERMUTATIONS // _ROWS, 13)
#: Bands of each round over their buckets, before the rest is dealt anew.
_BAND_ROUNDS = (4, 40)
_COUNTERS = 1 << 18
#: Up to so many keys (8 bytes each) are broadcast; more are joined by a shuffle.
_BROADCAST_KEYS = 1_000_000
#: Up to so many rows of a few numbers are broadcast.
_BROADCAST_ROWS = 100_000
#: Up to so many links of a round are joined into components on the driver (16 bytes each).
_DRIVER_LINKS = 100_000
#: In each round over rare shingles a bucket has so many times the pivots of the last.
_MORE_PIVOTS = 4
#: Tasks for each core that count shingles: each sends a table of counters.
_COUNT_TASKS = 4


def _min_max(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of each permutation over each segment of ``flat``."""
    low = np.empty((_PERMUTATIONS, len(starts)), np.uint64)
    high = np.empty_like(low)
    work = np.empty_like(flat)
    for k in range(_PERMUTATIONS):
        np.bitwise_xor(flat, _FLIP[k], out=work)
        np.multiply(work, _TIMES[k], out=work)
        low[k] = np.minimum.reduceat(work, starts)
        high[k] = np.maximum.reduceat(work, starts)
    return low, high


def _bands(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    keys = []
    for values in (low, high):
        for g in range(0, _PERMUTATIONS, _ROWS):
            key = np.full(values.shape[1], _SALT[len(keys)], np.uint64)
            for r in range(_ROWS):
                key = tv.mix(key * tv._BASE + values[g + r])
            keys.append(key)
    return np.stack(keys, axis=1)


def _sets(column: pa.Array, width: int):
    """Yield (from row, to row, list of shingle sets) over runs of rows of bounded size."""
    buf, offsets = tv.buffers(column)
    values = tv.byte_values(lower=True)
    for a, b in tv.row_slices(offsets):
        words, first = tv.word_hashes(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], values)
        yield a, b, tv.shingles(words, first, width)


def _digest(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each set and two 64-bit sums that stand for its content."""
    size = np.array([len(x) for x in own], np.int64)
    one = np.array([x.sum(dtype=np.uint64) for x in own], np.uint64)
    two = np.array([tv.mix(x).sum(dtype=np.uint64) for x in own], np.uint64)
    return size, one.view(np.int64), two.view(np.int64)


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """Per row: key, n (shingles), k1 and k2 (content of the set), bands (null without shingles)."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("n", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            for lo, hi, own in _sets(b.column(1), width):
                size, one, two = _digest(own)
                full = np.flatnonzero(size)
                lengths = np.where(size > 0, 2 * _PERMUTATIONS // _ROWS, 0)
                flat = np.zeros(0, np.int64)
                if len(full):
                    starts = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                    flat = _bands(*_min_max(np.concatenate([own[i] for i in full]), starts)).ravel().view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(size), pa.array(one), pa.array(two), made], names=schema.names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), schema)


def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """Per row: key, n, k1, k2 and the full set as sorted hashes."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("n", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("items", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            for lo, hi, own in _sets(b.column(1), width):
                size, one, two = _digest(own)
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                flat = np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64)
                made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(size), pa.array(one), pa.array(two), made], names=schema.names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), schema)


def _if_few(df: DataFrame, most: int) -> DataFrame:
    """``df`` (a written table, or columns of one) marked for a broadcast if it has ``most`` rows at most."""
    return F.broadcast(df) if df.count() <= most else df


def near_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest key of the component), kept (key = component_id).

    Links need 100 * intersection >= ``percent`` * union of the sets of ``width``-word shingles.
    """
    scratch = Scratch(spark, "minhash")
    signed = scratch.save(signatures(docs, key, text, width), "signatures")
    grouped = signed.filter("n > 0").groupBy("n", "k1", "k2").agg(F.min("key").alias("rep"), F.first("bands").alias("bands"))
    classes = scratch.save(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")

    each = classes.select("cid", "n", F.posexplode("bands").alias("band", "bucket")).select("cid", "n", "bucket", "band", F.lit(0).alias("pos"), F.lit(True).alias("short"))
    shared = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("bucket")
    members = scratch.save(each.join(shared, "bucket"), "members")
    linked = None
    if not members.isEmpty():
        used = members.select("cid").distinct()
        involved = scratch.save(classes.drop("bands").join(used, "cid", "left_semi"), "involved")
        reps = involved.select(F.col("rep").alias("_rep")).distinct()
        if docs.schema[key].dataType in (T.IntegerType(), T.LongType()) and involved.count() <= _BROADCAST_KEYS:
            reps = F.broadcast(reps)
        texts = docs.join(reps, F.col(key).eqNullSafe(F.col("_rep")), "left_semi").select(F.col(key), F.col(text))
        full = shingle_sets(texts, key, text, width).drop("key").join(_if_few(involved.select("cid", "n", "k1", "k2"), _BROADCAST_ROWS), ["n", "k1", "k2"])
        sets = scratch.save(full.select("cid", "items"), "sets")
        linked = _link(scratch, members, sets, percent)

    if linked is None:
        scratch.keep_only(signed, classes)
        named = classes.select("n", "k1", "k2", F.col("rep").alias("component_id"))
    else:
        placed = classes.drop("bands").join(linked.withColumnRenamed("node", "cid"), "cid", "left")
        placed = scratch.save(placed.withColumn("comp", F.coalesce("comp", "cid")), "placed")
        scratch.keep_only(signed, placed)
        least = placed.groupBy("comp").agg(F.min("rep").alias("component_id"))
        named = placed.join(least, "comp").select("n", "k1", "k2", "component_id")
    out = signed.drop("bands").join(named, ["n", "k1", "k2"], "left").withColumn("component_id", F.coalesce("component_id", "key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def _link(scratch: Scratch, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Components of classes (node, comp), from buckets (bucket, cid, n, pos, short) and full sets (cid, items).

    A pair is asked for if, at the overlap its sizes need, the bucket's shingle is early enough (``pos``) in both.
    ``short`` marks where that can be so for the smaller of two.
    """
    comp, pivots_wanted, turn, asked, later = None, 1, 0, None, None
    while True:
        if turn < len(_BAND_ROUNDS):
            # a bucket's members are all of one band: later bands wait
            members, later = members.filter(F.col("band") < _BAND_ROUNDS[turn]), members.filter(F.col("band") >= _BAND_ROUNDS[turn])
        if comp is None:
            placed = members.withColumn("comp", F.col("cid"))
        else:
            placed = members.join(_if_few(comp.withColumnRenamed("node", "cid"), _BROADCAST_ROWS), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        placed = scratch.save(placed, "placed")
        mixed = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("short").alias("any")).filter("lo < hi AND any").select("bucket")
        live = scratch.save(placed.join(mixed, "bucket", "left_semi"), "live")
        if turn >= len(_BAND_ROUNDS) and live.isEmpty():
            return comp
        if turn == len(_BAND_ROUNDS):
            left = _if_few(scratch.save(live.select("cid").distinct(), "left"), _BROADCAST_KEYS)
            members, turn = scratch.save(_rare_buckets(scratch, sets.join(left, "cid", "left_semi"), percent), "rare"), turn + 1
            continue
        part = F.pmod(F.xxhash64("cid", F.lit(turn)), F.lit(pivots_wanted))
        chosen = live.filter("short").groupBy("bucket", part.alias("part")).agg(F.min(F.struct("n", "cid", "comp", "pos")).alias("p"))
        pivots = scratch.save(chosen.select("bucket", F.col("p.cid").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.comp").alias("pcomp"), F.col("p.pos").alias("ppos")), "pivots")
        close = 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")
        least = F.ceil(percent * (F.col("n") + F.col("pn")) / (100 + percent))
        early = (F.col("pos") <= F.col("n") - least) & (F.col("ppos") <= F.col("pn") - least)
        met = live.join(pivots, "bucket").filter((F.col("comp") != F.col("pcomp")) & close & early)
        pairs = met.select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()
        if asked is not None:
            pairs = pairs.join(asked, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, "pairs")
        asked = pairs if asked is None else asked.union(pairs)
        if asks := pairs.count():
            left, right = sets.select(F.col("cid").alias("a"), F.col("items").alias("x")), sets.select(F.col("cid").alias("b"), F.col("items").alias("y"))
            if asks <= _BROADCAST_ROWS:  # only sets that are asked for move
                right = right.join(F.broadcast(pairs.select("b")), "b", "left_semi")
            both = left.join(_if_few(pairs, _BROADCAST_ROWS), "a").join(right, "b").withColumn("i", F.size(F.array_intersect("x", "y")))
            links = both.filter(100 * F.col("i") >= percent * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b")
            comp = _merge(scratch, comp, scratch.save(links, "links"))
        rest = live.select("bucket", "cid", "n", "pos", "short", "band").join(pivots.select("bucket", F.col("pivot").alias("cid")), ["bucket", "cid"], "left_anti")
        members = scratch.save(rest if turn + 1 >= len(_BAND_ROUNDS) else rest.unionByName(later.select(*rest.columns)), "members")
        pivots_wanted, turn = pivots_wanted * _MORE_PIVOTS if turn > len(_BAND_ROUNDS) else 1, turn + 1


def _rare_buckets(scratch: Scratch, sets: DataFrame, percent: int) -> DataFrame:
    """Buckets (bucket, cid, n, pos, short, band): each set's rarest shingles, as many as a link to any set needs, and their places."""
    shift = np.uint64(64 - 18)
    slot = lambda items: (items.view(np.uint64) * np.uint64(0x9FB21C651E98DF25) >> shift).astype(np.int64)

    def count(batch: pa.RecordBatch, counters: np.ndarray) -> None:
        items = batch.column(1).flatten().to_numpy()
        counters += np.bincount(slot(items), minlength=_COUNTERS)

    context = sets.sparkSession.sparkContext
    few = sets.select("cid", "items").coalesce(_COUNT_TASKS * context.defaultParallelism)
    common = context.broadcast(summed(few, _COUNTERS, count).astype(np.int32))
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("cid", T.LongType()), T.StructField("n", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("short", T.BooleanType())])

    def run(batches):
        often = common.value
        for b in batches:
            cids, buckets, short = b.column(0).to_numpy(), [], []
            for items in b.column(1):
                x = items.values.to_numpy()
                wanted = len(x) - -(-len(x) * percent // 100) + 1
                buckets.append(x[np.lexsort((x, often[slot(x)]))[:wanted]])
                # the larger set is no smaller: the overlap is 2t / (1 + t) of this one at least
                short.append(np.arange(len(buckets[-1])) < len(x) - -(-2 * percent * len(x) // (100 + percent)) + 1)
            wide = np.array([len(x) for x in buckets], np.int64)
            size = np.array([len(x.values) for x in b.column(1)], np.int64)
            place = np.concatenate([*map(np.arange, wide), np.zeros(0, np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*buckets, np.zeros(0, np.int64)])), pa.array(np.repeat(cids, wide)), pa.array(np.repeat(size, wide)), pa.array(place), pa.array(np.concatenate([*short, np.zeros(0, bool)]))], names=schema.names)

    each = scratch.save(sets.select("cid", "items").mapInArrow(lean(run), schema), "each")
    shared = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.max("short").alias("any")).filter("m > 1 AND any").select("bucket")
    return each.join(shared, "bucket").withColumn("band", F.lit(0))


def _merge(scratch: Scratch, comp: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Components after ``links`` are added to those of ``comp``."""
    n = links.count()
    if comp is None or not n:
        return components(scratch, links, n, _DRIVER_LINKS) if n else comp
    at = lambda side: _if_few(comp.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_comp")), _BROADCAST_ROWS)
    moved = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    more = components(scratch, moved, n, _DRIVER_LINKS)
    if more is None:
        return comp
    # nodes of ``more`` are components so far, each named by one of its nodes, or nodes that are new
    step = _if_few(more.select(F.col("node").alias("comp"), F.col("comp").alias("to")), _BROADCAST_ROWS)
    known = comp.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    new = more.join(_if_few(comp.select("node"), _BROADCAST_KEYS), "node", "left_anti")
    return scratch.save(known.unionByName(new.select("node", "comp")), "comp")

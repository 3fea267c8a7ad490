"""Near-duplicate embeddings by search in a robust-pruned flat graph.

Equal vectors of one label are one class and are linked by their number. Classes of a label
with more rows than a region holds are dealt to overlapping regions: each to the cells of its
nearest centres, as far as a vector in range of it may be at home there. Centres are sampled
from the rows dealt; a cell that is still too large is dealt again by centres of its own, so
no table of centres is ever gathered, and each task deals a bounded block of rows. Where centres
can't part a cell (all within range of each other) it is split at random, and every two
of its parts meet in a region.

In a region a graph is built on small overlapping cluster shards: every vector's near
neighbours in a shard are robust-pruned (no kept neighbour is much closer to another kept one than
to the vector), and its lists from all of its shards, and those that name it, are
united with a few random links. Then each vector is searched for: a greedy search with a
beam walks from the region's medoids to the query, and from what is in range, the query's own
place included, the search spreads over neighbours in range, or nearly so, until nothing new
is found. A search that has met a sixteenth of the region looks at all of it. What was
found is verified by cosine in double precision, and a link found from one end holds for both.
A pair that shares several regions is counted in the first of them.

The links of a bounded sample of classes are then counted by brute force over all classes in
blocks (:func:`missed`). If too many are missed, all is done again with twice the cells for each
vector. :func:`audit` measures a result in the same way.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without a label, link with nothing; vectors of different
length aren't compared; repeated rows are linked with each other; a null vec_id takes no
part in the smallest id of a component; extra columns are not read; an empty table
gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._components import components
from loomgraph.llm._scratch import Scratch, ship
from loomgraph.llm._worker import lean, release

#: Rows of a region; one of up to half as many more isn't split.
REGION_ROWS = 4096
#: Centres of one dealing, and rows dealt by one task.
_CENTRES, _DEAL_ROWS = 256, 8192
#: Nearest cells of a vector, to begin with and at most; they are doubled while the audit misses more than a share of the links.
CELLS, MAX_CELLS, MISSED = 4, 32, 0.02
#: Classes whose links the audit counts, about.
_AUDITED = 512
_SHARD, _OVERLAP, _NEAR, _OUT, _RANDOM = 256, 3, 32, 12, 2
_ALPHA = 1.2
_BEAM, _STEP, _WIDE, _MEDOIDS, _BLOCK = 12, 2, 32, 16, 256
#: The search spreads over neighbours down to this much below the range, in single precision; candidates are verified after.
_SLACK, _CLOSE = 0.03, 1e-4


def build_graph(x: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Links of unit vectors ``x``, both ways: (indptr, indices); row i links to indices[indptr[i]:indptr[i + 1]]."""
    n = len(x)
    rng = np.random.default_rng(seed)
    source, target = [np.repeat(np.arange(n), _RANDOM)], [rng.integers(0, max(n, 1), _RANDOM * n)]
    for own in _shards(x, rng):
        dots = x[own] @ x[own].T
        np.fill_diagonal(dots, -np.inf)
        near = min(_NEAR, len(own) - 1)
        if near < 1:
            continue
        close = np.argpartition(-dots, near - 1, axis=1)[:, :near] if near < len(own) else None
        kept = _prune(dots, close)
        who, at = np.nonzero(kept >= 0)
        source.append(own[who])
        target.append(own[kept[who, at]])
    p, q = np.concatenate(source).astype(np.int64), np.concatenate(target).astype(np.int64)
    return links_of(n, np.concatenate([p, q]), np.concatenate([q, p]))


def _shards(x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Overlapping clusters of rows: each row is in those of its nearest sampled rows. Large ones are cut at random."""
    n = len(x)
    if n <= 2 * _SHARD:
        return [np.arange(n)] if n else []
    centres = x[rng.choice(n, -(-n // _SHARD) * _OVERLAP, replace=False)]
    nearest = np.concatenate([np.argpartition(-(x[a : a + 1024] @ centres.T), _OVERLAP - 1, axis=1)[:, :_OVERLAP] for a in range(0, n, 1024)])
    order = np.argsort(nearest, axis=None, kind="stable")
    cell, row = nearest.ravel()[order], order // _OVERLAP
    out = []
    for own in np.split(row, np.flatnonzero(np.diff(cell)) + 1):
        out += np.array_split(rng.permutation(own), -(-len(own) // (2 * _SHARD)))
    return out


def links_of(n: int, source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct links as (indptr, indices)."""
    key = np.unique(source[source != target] * np.int64(n) + target[source != target])
    return np.searchsorted(key // max(n, 1), np.arange(n + 1)), key % max(n, 1)


def _prune(dots: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Robust pruning of each row's candidates: the nearest stays and rules out those that are much nearer to it."""
    m, c = pool.shape
    rows = np.arange(m)
    away = 1 - dots[rows[:, None], pool]
    order = np.argsort(away, axis=1, kind="stable")
    pool, away = np.take_along_axis(pool, order, 1), np.take_along_axis(away, order, 1)
    alive = np.isfinite(away)
    out = np.full((m, _OUT), -1, np.int64)
    for k in range(_OUT):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = np.argmax(alive, axis=1)
        nearest = pool[rows, first]
        out[some, k] = nearest[some]
        alive &= (_ALPHA * (1 - dots[nearest[:, None], pool]) > away) & some[:, None]
        alive[rows, first] = False
    return out


def _medoids(x: np.ndarray, seed: int = 1) -> np.ndarray:
    """The members nearest to the means of a few clusters."""
    k = min(_MEDOIDS, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(2):
        own = np.argmax(x @ centres.T, axis=1)
        centres = np.stack([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
    return np.unique(np.argmax(centres @ x.T, axis=1))


class Search:
    """Range search for members of a graph, in blocks of queries."""

    def __init__(self, x: np.ndarray, links: tuple[np.ndarray, np.ndarray], least: float):
        self.x, self.links, self.least = x, links, least
        self.entries = _medoids(x)
        indptr, indices = links
        # the first links of each member, for the walk; place n stands for none
        self.first = np.full((len(x) + 1, _WIDE), len(x), np.int64)
        many = np.minimum(np.diff(indptr), _WIDE)
        who = np.repeat(np.arange(len(x)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.first[who, at] = indices[indptr[who] + at]

    def block(self, a: int, b: int) -> np.ndarray:
        """found[i, j]: member j is met in range of query a + i, but for rounding."""
        x, n, m = self.x, len(self.x), b - a
        q, rows = x[a:b], np.arange(m)[:, None]
        score = np.full((m, n + 1), -np.inf, x.dtype)  # place n takes what is written for unused places
        slot = np.zeros((m, n + 1), np.int32)
        score[:, self.entries] = q @ x[self.entries].T
        self._walk(q, rows, score)
        score[rows[:, 0], np.arange(a, b)] = 1
        done = np.zeros((m, n), bool)
        while True:  # spread from what is in range, or nearly so
            open_ = (score[:, :n] >= self.least - _SLACK) & ~done
            if not open_.any():
                break
            done |= open_
            wide = np.flatnonzero((done.sum(axis=1) > max(64, n // 16)) & ~done.all(axis=1))
            if len(wide):
                score[wide, :n] = q[wide] @ x.T
                done[wide], open_[wide] = True, False
            who, at = np.nonzero(open_)
            for s in range(0, len(who), 4096):
                self._look(q, score, slot, who[s : s + 4096], at[s : s + 4096])
        found = score[:, :n] >= self.least - _CLOSE
        found[rows[:, 0], np.arange(a, b)] = False
        return found

    def _walk(self, q: np.ndarray, rows: np.ndarray, score: np.ndarray) -> None:
        """Greedy search with a beam from the medoids."""
        n, m = len(self.x), len(q)
        width = min(_BEAM, len(self.entries))
        near = score[:, self.entries]
        top = np.argpartition(-near, width - 1, axis=1)[:, :width]
        beam, worth = self.entries[top], np.take_along_axis(near, top, 1)
        fresh = np.ones((m, width), bool)
        for _ in range(n):
            ranked = np.where(fresh, worth, -np.inf)
            step = min(_STEP, ranked.shape[1])
            best = np.argpartition(-ranked, step - 1, axis=1)[:, :step]
            going = np.take_along_axis(ranked, best, 1) > -np.inf
            if not going.any():
                break
            np.put_along_axis(fresh, best, False, 1)
            around = self.first[np.where(going, np.take_along_axis(beam, best, 1), n)].reshape(m, -1)
            around[(score[rows, around] > -np.inf)] = n
            live = np.flatnonzero((around < n).any(axis=1))
            dots = np.full(around.shape, -np.inf, score.dtype)
            if len(live):
                dots[live] = np.einsum("mcd,md->mc", self.x[np.minimum(around[live], n - 1)], q[live])
                dots[around == n] = -np.inf
                score[rows, around] = dots
            score[:, n] = -np.inf
            # a member met twice in one step may stand twice in the beam: it is looked around twice
            beam, worth = np.concatenate([beam, around], axis=1), np.concatenate([worth, dots], axis=1)
            fresh = np.concatenate([fresh, dots > -np.inf], axis=1)
            if beam.shape[1] > _BEAM:
                keep = np.argpartition(-worth, _BEAM - 1, axis=1)[:, :_BEAM]
                beam, worth, fresh = (np.take_along_axis(v, keep, 1) for v in (beam, worth, fresh))

    def _look(self, q: np.ndarray, score: np.ndarray, slot: np.ndarray, who: np.ndarray, at: np.ndarray) -> None:
        """Score the neighbours of member at[i] for query who[i]."""
        indptr, indices = self.links
        many = indptr[at + 1] - indptr[at]
        around = indices[np.repeat(indptr[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        who = np.repeat(who, many)
        new = score[who, around] == -np.inf
        who, around = who[new], around[new]
        slot[who, around] = np.arange(len(who))  # of several the last one stays
        last = slot[who, around] == np.arange(len(who))
        who, around = who[last], around[last]
        for s in range(0, len(who), 1 << 15):
            i, j = who[s : s + (1 << 15)], around[s : s + (1 << 15)]
            score[i, j] = np.einsum("ij,ij->i", q[i], self.x[j])


def links_within(raw: np.ndarray, least: float) -> np.ndarray:
    """A symmetric matrix of all links found among vectors, verified in double precision."""
    n = len(raw)
    norm = np.sqrt((raw * raw).sum(axis=1))
    unit = raw / norm[:, None]
    x = unit.astype(np.float32)
    search = Search(x, build_graph(x), least)
    out = np.zeros((n, n), bool)
    for a in range(0, n, _BLOCK):
        b = min(n, a + _BLOCK)
        i, j = np.nonzero(search.block(a, b))
        if len(i) > 16 * (b - a):
            some, at = np.unique(j, return_inverse=True)
            cosine = (raw[a:b] @ raw[some].T / (norm[a:b, None] * norm[some]))[i, at]
        else:
            cosine = np.einsum("ij,ij->i", raw[a + i], raw[j]) / (norm[a + i] * norm[j])
        sure = cosine >= least
        out[a + i[sure], j[sure]] = True
    return out | out.T


def _parts(linked: np.ndarray) -> np.ndarray:
    """For each row the smallest row of its component."""
    n = len(linked)
    root = np.full(n, -1)
    for a in range(n):
        if root[a] >= 0:
            continue
        edge = np.array([a])
        root[a] = a
        while len(edge):
            edge = np.flatnonzero(linked[edge].any(axis=0) & (root < 0))
            root[edge] = a
    return root


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(axis=1))[:, None]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks)]).astype(np.float64).reshape(-1, dim)


def _first_common(near: np.ndarray, i: np.ndarray, j: np.ndarray, path: list[int]) -> np.ndarray:
    """Whether the cells on ``path`` are the first that members i and j share, at each level; ``near`` is (member, level, cell)."""
    out = np.ones(len(i), bool)
    for level, own in enumerate(path):
        x, y = near[i, level], near[j, level]
        shared = (x[:, :, None] == y[:, None, :]).any(axis=2) & (x >= 0)
        out &= np.where(shared, x, np.iinfo(np.int32).max).min(axis=1) == own
    return out


def _path(cell: int) -> list[int]:
    """Numbers of the cells that led to a cell, the first one first."""
    out = []
    while cell:
        out.append((cell - 1) % _CENTRES)
        cell = (cell - 1) // _CENTRES
    return out[::-1]


def _search_region(least: float, schema: pa.Schema):
    def run(rows: pa.Table) -> pa.Table:
        rid, copies, side = (rows[c].to_numpy() for c in ("rid", "copies", "side"))
        linked = links_within(_matrix(rows["embedding"], rows["dim"][0].as_py()), least)
        if rows["i"][0].as_py() != rows["j"][0].as_py():
            linked &= side[:, None] != side[None, :]
        path = _path(rows["cell"][0].as_py())
        if path:
            near = _matrix(rows["near"], len(rows["near"][0])).astype(np.int32).reshape(len(rid), len(path), -1)
        count = np.zeros(len(rid))
        a, b = np.nonzero(np.triu(linked))
        for s in range(0, len(a), 1 << 18):
            i, j = a[s : s + (1 << 18)], b[s : s + (1 << 18)]
            if path:
                first = _first_common(near, i, j, path)
                i, j = i[first], j[first]
            count += np.bincount(i, copies[j], len(rid)) + np.bincount(j, copies[i], len(rid))
        root = rid[_parts(linked)]
        some = (count > 0) | (root != rid)
        del linked
        release()
        return pa.Table.from_arrays([pa.array(rid[some]), pa.array(root[some]), pa.array(count[some].astype(np.int64))], schema=schema)

    return run


def _cells(x: np.ndarray, c: np.ndarray, least: float, cells: int) -> np.ndarray:
    """For each unit vector of ``x`` its nearest centres, -1 where there is none that counts, in order of their numbers.

    A cell counts if a vector at a cosine of ``least`` may be at home in it. With n the unit normal of the plane between
    the centres of the row's home and of the cell, a vector v of that cell has n.v <= 0, so its angle to the row
    is at least arcsin(n.row).
    """
    reach = math.sqrt(max(0.0, 1 - max(least, 0.0) ** 2))
    dots = x @ c.T
    home = np.argmax(dots, axis=1)
    if cells < len(c):
        near = np.argpartition(-dots, cells - 1, axis=1)[:, :cells]
        near[~(near == home[:, None]).any(axis=1), 0] = home[~(near == home[:, None]).any(axis=1)]
    else:
        near = np.broadcast_to(np.arange(len(c)), dots.shape)
    apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("md,mkd->mk", c[home], c[near])))
    ok = dots.max(axis=1)[:, None] - np.take_along_axis(dots, near, 1) <= reach * apart + 1e-9
    out = np.full((len(x), cells), -1, np.int32)
    out[:, : near.shape[1]] = np.where(ok, near, -1)
    return np.sort(out, axis=1)


def _apart(c: np.ndarray, closest: float) -> np.ndarray:
    """Those of the unit vectors ``c`` that have no earlier one of them at a cosine of ``closest``."""
    kept, left = [], np.arange(len(c))
    while len(left):
        kept.append(left[0])
        left = left[1:][c[left[1:]] @ c[left[0]] < closest]
    return c[kept]


def _deal_block(least: float, cells: int, schema: pa.Schema):
    """Rows of one block and the centres of their cell: each row once for each of its new cells."""

    def run(rows: pa.Table, centres: pa.Table) -> pa.Table:
        n, dim = rows.num_rows, rows["dim"][0].as_py() if rows.num_rows else 1
        drawn = [_matrix(pa.chunked_array([v.values]), dim) for v in centres["centres"]] if n else []
        near = np.full((n, cells), -1, np.int32)
        if drawn and len(drawn[0]):
            c = _apart(_unit(drawn[0]), 2 * max(least, 0.0) ** 2 - 1)
            x = _unit(_matrix(rows["embedding"], dim))
            near = np.concatenate([_cells(x[a : a + 1024], c, least, cells) for a in range(0, n, 1024)])
        else:
            near[:, -1] = 0
        who, at = np.nonzero(near >= 0)
        parent = rows["cell"].to_numpy()[who]
        before = rows["near"].to_pylist() if n else []
        kinds = dict(zip(schema.names, schema.types))
        made = {"cell": pa.array(parent * _CENTRES + 1 + near[who, at], pa.int64()), "near": pa.array([[*before[i], *near[i].tolist()] for i in who.tolist()], pa.list_(pa.int32()))}
        taken = rows.take(pa.array(who))
        return pa.Table.from_arrays([(made[f] if f in made else taken[f].combine_chunks()).cast(kinds[f]) for f in schema.names], schema=schema)

    return run


def _deal(scratch: Scratch, classes: DataFrame, least: float, cells: int) -> DataFrame:
    """Classes dealt to cells: rid, label, dim, copies, embedding, cell, near (cells of each level), size (rows of the cell)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    group = ["label", "dim", "cell"]
    columns = ["rid", "label", "dim", "copies", "embedding", "cell", "near", "was"]
    left = classes.select("rid", "label", "dim", "copies", "embedding", F.lit(0).cast("long").alias("cell"), F.array().cast("array<int>").alias("near"), F.lit(1 << 60).alias("was"))
    out = None
    for level in range(7):
        counted = left.join(left.groupBy(*group).agg(F.count(F.lit(1)).alias("size")), group)
        # dealt again while that makes it smaller
        large = (F.col("size") > REGION_ROWS * 3 // 2) & (F.col("size") < 0.9 * F.col("was")) & F.lit(level < 6)
        sized = scratch.save(counted, "sized")
        settled = sized.filter(~large)
        out = settled if out is None else out.unionByName(settled)
        rest = sized.filter(large)
        if rest.isEmpty():
            break
        wanted = F.least(F.ceil(F.col("size") * cells / REGION_ROWS), F.lit(_CENTRES)).cast("int")
        drawn = F.pmod(F.xxhash64("rid", F.lit(level)), F.lit(1 << 40)).cast("double") / float(1 << 40)
        blocks = F.ceil(F.col("size") / _DEAL_ROWS).cast("int")
        some = rest.withColumn("u", drawn).filter(F.col("u") < 2.0 * wanted / F.col("size"))
        listed = some.groupBy(*group, "size").agg(F.sort_array(F.collect_list(F.struct("u", "embedding"))).alias("all"))
        listed = listed.select(*group, F.slice(F.col("all.embedding"), F.lit(1), wanted).alias("centres"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        parted = rest.drop("was").withColumnRenamed("size", "was").withColumn("block", F.pmod(F.xxhash64("rid", F.lit(9)), F.ceil(F.col("was") / _DEAL_ROWS)).cast("int"))
        schema = left.select(*columns).schema
        key = [*group, "block"]
        run = _deal_block(least, cells, to_arrow_schema(schema))
        left = scratch.save(parted.groupBy(*key).cogroup(listed.groupBy(*key)).applyInArrow(run, schema), "dealt")
    return out.drop("was")


def _linked(scratch: Scratch, classes: DataFrame, least: float, cells: int) -> DataFrame:
    """Links found: rid, root (a class of its component), n (links to rows of other classes)."""
    dealt = _deal(scratch, classes, least, cells)
    parts = F.when(F.col("size") <= REGION_ROWS * 3 // 2, 1).otherwise(F.ceil(F.col("size") / (REGION_ROWS // 2))).cast("int")
    dealt = dealt.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rid", F.lit(5)), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other"), "side": F.col("part") <= F.col("other")})
    schema = "rid long, root long, n long"
    run = _search_region(least, pa.schema([("rid", pa.int64()), ("root", pa.int64()), ("n", pa.int64())]))
    rows = met.select("label", "dim", "cell", "i", "j", "side", "rid", "copies", "near", "embedding")
    return scratch.save(rows.groupBy("label", "dim", "cell", "i", "j").applyInArrow(run, schema), "found")


def missed(classes: DataFrame, counts: DataFrame, least: float, seed: int = 7) -> float:
    """Share of the links of a bounded sample of classes that ``counts`` (rid, n) lacks, by brute force over all classes in blocks.

    :param classes: rid, label, dim, copies, embedding.
    """
    spark, total = classes.sparkSession, classes.count()
    drawn = F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    asked = classes.filter(drawn < _AUDITED / max(total, 1)).select("rid", "label", "dim", "embedding").limit(2 * _AUDITED).collect()
    queries: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for kind in {(r["label"], r["dim"]) for r in asked}:
        own = [r for r in asked if (r["label"], r["dim"]) == kind]
        queries[kind] = np.array([r["rid"] for r in own]), _unit(np.array([r["embedding"] for r in own], np.float64))
    held = spark.sparkContext.broadcast(queries)

    def run(batches):
        for b in batches:
            label, dim, out = b.column(1).to_pylist(), b.column(2).to_numpy(), {}
            kinds = np.array([hash((x, d)) for x, d in zip(label, dim.tolist())])
            for kind in set(zip(label, dim.tolist())):
                if kind not in held.value:
                    continue
                rows = b.take(pa.array(np.flatnonzero(kinds == hash(kind))))
                rid, copies = rows.column(0).to_numpy(), rows.column(3).to_numpy()
                x = _unit(_matrix(pa.chunked_array([rows.column(4)]), kind[1]))
                asks, q = held.value[kind]
                near = (q @ x.T >= least) & (asks[:, None] != rid[None, :])
                for r, n in zip(asks.tolist(), (near * copies).sum(axis=1).tolist()):
                    out[r] = out.get(r, 0) + n
            out = {r: n for r, n in out.items() if n}
            yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.int64()), pa.array(out.values(), pa.int64())], names=["rid", "true"])

    true = classes.select("rid", "label", "dim", "copies", "embedding").mapInArrow(lean(run), "rid long, true long").groupBy("rid").agg(F.sum("true").alias("true"))
    row = true.join(counts, "rid", "left").agg(F.sum("true").alias("t"), F.sum(F.least("true", F.coalesce("n", F.lit(0)))).alias("g")).first()
    return 1 - row["g"] / row["t"] if row["t"] else 0.0


def _numbered(scratch: Scratch, table: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """All rows (rid, key, label, dim, h1, h2, embedding; these null unless sound) and the classes of equal sound vectors."""
    v = F.col(vector)
    sound = F.col(label).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    sound = F.coalesce(sound, F.lit(False))
    numbered = table.select(F.col(key).alias("key"), F.when(sound, F.col(label)).alias("label"), F.when(sound, F.size(v)).alias("dim"), F.when(sound, v).alias("embedding"))
    numbered = numbered.withColumn("rid", F.monotonically_increasing_id())
    # rows that link with nothing have hashes of their own, so that they don't meet in one task
    hashed = numbered.withColumns({"h1": F.when(F.col("dim") > 0, F.xxhash64("embedding")).otherwise(F.col("rid")), "h2": F.when(F.col("dim") > 0, F.hash("embedding"))})
    everything = scratch.save(hashed, "vectors")
    classes = everything.filter("dim > 0").groupBy("label", "dim", "h1", "h2").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    return everything, scratch.save(classes, "classes")


def near_duplicates(spark: SparkSession, table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """Per row: key, n_links (other rows linked directly), component_id (smallest key reachable), kept (key = component_id)."""
    ship(spark)
    scratch = Scratch(spark, "flatgraph")
    everything, classes = _numbered(scratch, table, key, vector, label)
    cells = CELLS
    while True:
        found = _linked(scratch, classes, least, cells)
        counts = found.groupBy("rid").agg(F.sum("n").alias("n"))
        if cells >= MAX_CELLS or missed(classes, counts, least) <= MISSED:
            break
        cells *= 2

    placed = classes.select("label", "dim", "h1", "h2", "rid", "copies").join(counts, "rid", "left")
    mapping = components(scratch, found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    if mapping is None:
        placed = placed.withColumn("comp", F.col("rid"))
    else:
        placed = placed.join(mapping.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    placed = placed.select("label", "dim", "h1", "h2", "comp", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"))
    named = everything.select("rid", "key", "label", "dim", "h1", "h2").join(placed, ["label", "dim", "h1", "h2"], "left")
    named = scratch.save(named.select("key", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("comp", "rid").alias("comp")), "placed")
    scratch.keep_only(named)
    smallest = named.groupBy("comp").agg(F.min("key").alias("component_id"))
    return named.join(smallest, "comp").select(F.col("key").alias(key), F.col("n").alias("n_links"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def audit(spark: SparkSession, table: DataFrame, result: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> float:
    """Share of the links of about 512 classes of equal vectors that ``result`` has, by brute force over all rows in blocks."""
    ship(spark)
    scratch = Scratch(spark, "audit")
    everything, classes = _numbered(scratch, table, key, vector, label)
    got = result.select(F.col(key).alias("key"), F.col("n_links").alias("n"))
    counts = everything.join(classes.select("rid", "copies"), "rid").join(got, "key").select("rid", (F.col("n") - F.col("copies") + 1).alias("n"))
    return 1 - missed(classes, counts.groupBy("rid").agg(F.max("n").alias("n")), least)

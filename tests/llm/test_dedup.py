"""Near-duplicates of texts and vectors, and repeated lines, against brute force."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

from loomgraph.llm import flatgraph, linededup, minhash, oracles
from loomgraph.llm._components import components
from loomgraph.llm._scratch import Scratch, numbered
from odd import ROWS

W = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute_minhash(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(len(rows), links)
    least = {}
    for r, (i, _) in zip(root, rows):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(str((i, len(s), least.get(r), i == least.get(r))) for r, s, (i, _) in zip(root, sets, rows))


def near_copies(seed, n=160):
    """Groups of edited copies, documents around a common passage, and unrelated ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6)))
    bases = [[word() for _ in range(r.choice([6, 30, 120]))] for _ in range(6)]
    passage = [word() for _ in range(60)]
    out = []
    for i in range(n):
        kind = r.random()
        if kind < 0.6:
            text = list(r.choice(bases))
            for _ in range(r.randrange(7)):
                text[r.randrange(len(text))] = word()
        elif kind < 0.8:
            text = passage + [word() for _ in range(r.randrange(3, 40))]
        else:
            text = [word() for _ in range(r.randrange(1, 80))]
        out.append((i, r.choice([" ", "\n", "  "]).join(text).replace("a", r.choice("aA"))))
    return out


@pytest.mark.parametrize("rows", [near_copies(1), near_copies(2), ROWS, [(5, "a b c"), (5, "other words"), (5, None)]])
def test_minhash(spark, docs_of, rows):
    got = minhash.near_duplicates(spark, docs_of(rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(str((r[0], r[1], r[2], r[0] == r[2])) for r in got.collect()) == brute_minhash(rows)


def test_minhash_rare_buckets(spark, docs_of, monkeypatch):
    """The exact rule for mixed buckets alone, without any round over the bands."""
    monkeypatch.setattr(minhash, "_BAND_ROUNDS", ())
    rows = near_copies(3, 120)
    assert sorted(str((r[0], r[1], r[2], r[0] == r[2])) for r in minhash.near_duplicates(spark, docs_of(rows)).collect()) == brute_minhash(rows)


@pytest.mark.parametrize("most", [0, 5])
def test_minhash_large(spark, docs_of, monkeypatch, most):
    """Tables too large for a broadcast or for the driver take the other way to the same result."""
    for name in ("_BROADCAST_KEYS", "_BROADCAST_ROWS", "_DRIVER_LINKS"):
        monkeypatch.setattr(minhash, name, most)
    rows = near_copies(4, 100)
    assert sorted(str((r[0], r[1], r[2], r[0] == r[2])) for r in minhash.near_duplicates(spark, docs_of(rows)).collect()) == brute_minhash(rows)


def test_minhash_work(spark, docs_of, monkeypatch):
    """Few tables are written, also for long chains of links, and sets that no pair asks for aren't shuffled."""
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: (saved.append(name), save(self, df, name))[1])
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(300)]
    rows = [(i, " ".join(passage + [word() for _ in range(150 + r.randrange(60))])) for i in range(60)]
    rows += [(1000 + 2 * i + k, t + " x" * k) for i, t in enumerate(" ".join(word() for _ in range(800)) for _ in range(60)) for k in (0, 1)]
    chain = [word() for _ in range(500)]
    rows += [(2000 + i, " ".join(chain[4 * i : 4 * i + 80])) for i in range(100)]
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(True).head().totalShuffleWrite()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        got = sorted(str((r[0], r[1], r[2], r[0] == r[2])) for r in minhash.near_duplicates(spark, docs_of(rows)).collect())
        moved = shuffled() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == brute_minhash(rows)
    assert moved < 4_000_000
    assert len(saved) < 40


@pytest.mark.parametrize("small", [0, 6, 1000])
def test_components(spark, small):
    r = random.Random(small)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(x, x + 1) for x in range(300, 400)] + [(7, 7)]
    edges = spark.createDataFrame(links, "a long, b long")
    for n in (None, len(links)):
        got = {x.node: x.comp for x in components(Scratch(spark, "test"), edges, n, small).collect()}
        root = roots(401, links)
        assert set(got) == {x for a, b in links if a != b for x in (a, b)}
        assert len(set(got.values())) == len({root[x] for x in got}) == len({(root[x], y) for x, y in got.items()})


def test_minhash_empty(spark, docs_of):
    assert minhash.near_duplicates(spark, docs_of([]).limit(0)).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(spark, docs_of([(1, None)])).collect()] == [(1, 0, 1, True)]


def brute_lines(rows, min_words):
    """Cut lines by comparing all runs of enough words, longest runs included."""
    docs = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [(k, " ".join(W.findall(x))) for k, x in enumerate(all_lines) if W.search(x)]
        docs.append((i, all_lines, kept))
    first, cut = {}, [set() for _ in docs]
    order = sorted(range(len(docs)), key=lambda d: (docs[d][0] is not None, docs[d][0] or 0))
    for d in order:
        kept = docs[d][2]
        for a in range(len(kept)):
            words = 0
            for b in range(a, len(kept)):
                words += kept[b][1].count(" ") + 1
                if words >= min_words:
                    run = tuple(x[1] for x in kept[a : b + 1])
                    if first.setdefault(run, (d, a)) != (d, a):
                        cut[d] |= {x[0] for x in kept[a : b + 1]}
    return [(i, len(c), None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in c)) for (i, t), (_, lines, _), c in zip(rows, docs, cut)]


def lined(seed, n=60):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcdefghijk") * 2 for _ in range(r.randrange(1, 9))) for _ in range(14)]
    out = []
    for i in range(n):
        text = [r.choice(pool) if r.random() < 0.7 else f"own {i} {k}" for k in range(r.randrange(1, 12))]
        out.append((i, "\n".join(x for line in text for x in ([line, ""] if r.random() < 0.1 else [line]))))
    return out


@pytest.mark.parametrize("min_words", [1, 5, 20])
def test_lines(spark, docs_of, min_words):
    rows = [*lined(min_words), (100, None), (101, ""), (102, "a\na\na\na\na\na"), (103, "é ß\n" * 30), (104, "x y\t z\n" * 9)]
    want = brute_lines(rows, min_words)
    got = {r["doc_id"]: (r["n_cut"], r["text"]) for r in linededup.clean(spark, docs_of(rows), min_words=min_words).collect()}
    assert got == {i: (n, t) for i, n, t in want}
    digest = {r["doc_id"]: r["text_sha256"] for r in linededup.digests(spark, docs_of(rows), min_words=min_words).collect()}
    assert digest == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, _, t in want}


def test_lines_repeated_rows(spark, docs_of):
    """Of repeated rows the first stays whole, also by the SQL; a null key comes first."""
    text = "\n".join(f"line {k} of a run" for k in range(12))
    cuts = lambda docs: sorted(map(str, ((r["doc_id"], r["n_cut"]) for r in linededup.clean(spark, docs).collect())))
    assert cuts(docs_of([(7, text), (7, text), (8, text), (None, text)])) == sorted(map(str, [(None, 0), (7, 12), (7, 12), (8, 12)]))
    docs = docs_of([(7, text), (7, text), (8, text), (8, "own\n" + text), (8, "own\n" + text), (9, None), (9, None)])
    assert cuts(docs) == sorted(map(str, [(7, 0), (7, 12), (8, 12), (8, 12), (8, 13), (9, 0), (9, 0)]))
    given = duckdb.connect()
    given.register("arrow", docs.toArrow())
    given.execute("CREATE TABLE documents AS SELECT * FROM arrow")
    got = linededup.digests(spark, docs)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, given.execute(f"SELECT {', '.join(got.columns)} FROM ({oracles.LINEDEDUP})").fetchall()))
    done = linededup.clean(spark, docs_of(ROWS).withColumnRenamed("size", "n_cut").withColumnRenamed("key", "cut").withColumnRenamed("kept", "_row"))
    assert sorted(done.columns) == sorted({*docs_of(ROWS).columns, "n_cut", "cut", "_row"} - {"size", "key", "kept"})
    assert done.count() == len(ROWS)
    assert linededup.clean(spark, docs_of(ROWS).limit(0)).count() == 0


def test_row_numbers(spark, tmp_path):
    """Rows of files have the same numbers in whatever parts they are read; other rows are written."""
    for k in range(3):
        spark.range(k * 100, k * 100 + 90).selectExpr("id", "id % 7 AS x", "'t' AS _loom_file").coalesce(1).write.parquet(str(tmp_path / f"t/{k}"))
    docs = spark.read.parquet(str(tmp_path / "t/*"))
    given = numbered(Scratch(spark, "test"), docs, "_row")
    assert given.columns == ["id", "x", "_loom_file", "_row"]
    want = {r["id"]: r["_row"] for r in given.collect()}
    assert len(set(want.values())) == len(want) == 270
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        assert {r["id"]: r["_row"] for r in given.select("id", "_row").collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    few = numbered(Scratch(spark, "test"), docs.filter("x = 3").drop("x"), "_row")
    assert {r["id"]: r["_row"] for r in few.collect()} == {i: n for i, n in want.items() if i % 7 == 3}
    for other in (docs.unionByName(docs), docs.selectExpr("id", "explode(array(1, 2)) AS k"), spark.range(5)):
        rows = numbered(Scratch(spark, "test"), other, "_row")
        assert len({r["_row"] for r in rows.collect()}) == other.count()


def test_suffix_ranks_sort_suffixes(spark, docs_of):
    """Ranks order suffixes by their first k lines, ties included."""
    rows = lined(9, 25)
    scratch = Scratch(spark, "test")
    lines = linededup._lines(numbered(scratch, docs_of(rows), linededup.ROW), "doc_id", "text")
    ids = {}
    for r in lines.collect():
        ids.setdefault(r["_row"], []).append((r["ord"], (r["h1"], r["h2"])))
    ids = {k: [x for _, x in sorted(v)] for k, v in ids.items()}
    for j, level in enumerate(linededup.suffix_ranks(scratch, lines.cache(), 8)):
        got = sorted((r["rank"], tuple(ids[r["_row"]][r["ord"] : r["ord"] + 2**j])) for r in level.collect())
        assert all((a[0] == b[0]) == (a[1] == b[1]) and a[1] <= b[1] for a, b in zip(got, got[1:]))


def brute_vectors(rows, least=0.98):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float)
        return v / np.sqrt((v * v).sum())

    units = [unit(v) for _, v, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if units[a] is not None and units[b] is not None and rows[a][2] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= least]
    root, n = roots(len(rows), links), [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    smallest = {}
    for r, (i, _, _) in zip(root, rows):
        if i is not None:
            smallest[r] = min(i, smallest.get(r, i))
    return sorted(str((i, k, smallest.get(r), i == smallest.get(r))) for r, k, (i, _, _) in zip(root, n, rows))


def vectors(seed, n=300, d=16):
    r = np.random.default_rng(seed)
    base = r.normal(size=(5, d))
    out = []
    for i in range(n):
        v = base[r.integers(5)] + r.normal(size=d) * r.choice([0.02, 0.1]) if r.random() < 0.5 else r.normal(size=d)
        out.append((i, [float(np.float32(x)) for x in v], int(r.integers(3))))
    nan, inf = float("nan"), float("inf")
    return [*out, (900, None, 1), (901, [], 1), (902, [0.0] * d, 1), (903, [nan] * d, 1), (904, [inf] + [1.0] * (d - 1), 1), (905, [None] + [1.0] * (d - 1), 1), (906, [1.0] * d, None), (907, [1.0] * d, 1), (907, [1.0] * d, 1), (None, [1.0] * d, 1), (908, [1.0] * 3, 1), (909, [2.0] * 3, 1)]


@pytest.mark.parametrize(("region", "cells"), [(4096, 4), (40, 4), (30, 2)])
def test_vectors(spark, monkeypatch, region, cells):
    """One region, many regions, and regions that are dealt several times."""
    monkeypatch.setattr(flatgraph, "REGION_ROWS", region)
    monkeypatch.setattr(flatgraph, "CELLS", cells)
    monkeypatch.setattr(flatgraph, "MISSED", 0.0)
    monkeypatch.setattr(flatgraph, "_DEAL_ROWS", 70)
    rows = vectors(region)
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, rid int")
    got = flatgraph.near_duplicates(spark, table)
    assert sorted(str((r[0], r[1], r[2], r[0] == r[2])) for r in got.collect()) == brute_vectors(rows)
    assert flatgraph.audit(spark, table, got) == 1.0
    assert flatgraph.near_duplicates(spark, table.limit(0)).count() == 0


@pytest.mark.parametrize("d", [3, 6, 64])
def test_vectors_of_a_large_label(spark, d):
    """More rows than two regions hold, with production parameters: all links, counted at both ends."""
    r = np.random.default_rng(d)
    x = r.normal(size=(9000, d))
    if d == 64:
        x[3000:] = x[r.integers(0, 3000, 6000)] + 0.12 * r.normal(size=(6000, d))
    x = x.astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = flatgraph.near_duplicates(spark, table)
    unit = flatgraph._unit(x.astype(np.float64))
    true = np.concatenate([(unit[a : a + 1000] @ unit.T >= 0.98).sum(axis=1) - 1 for a in range(0, 9000, 1000)])
    found = np.array([n for _, n in sorted((r["vec_id"], r["n_links"]) for r in got.collect())])
    assert true.sum() > 500
    assert (found <= true).all()
    assert found.sum() >= 0.999 * true.sum()
    assert flatgraph.audit(spark, table, got) >= 0.999


def hot_neighbours(copies=200, d=16):
    """Two groups of exact copies at a cosine of 0.985, one more group on the far side of each, and other vectors."""
    r = np.random.default_rng(8)
    a, b = np.linalg.qr(r.normal(size=(d, 2)))[0].T
    at = lambda turn: math.cos(turn) * a + math.sin(turn) * b
    step = math.acos(0.985)
    every = [*[at(0)] * copies, *[at(step)] * copies, *[at(-step)] * 20, *[at(2 * step)] * 20, *r.normal(size=(160, d))]
    return [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(every)]


def test_vectors_hot_neighbours(spark, monkeypatch):
    """Groups of copies that draw centres of their own lose no link to their neighbours."""
    monkeypatch.setattr(flatgraph, "REGION_ROWS", 40)
    rows = hot_neighbours()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = flatgraph.near_duplicates(spark, table)
    assert sorted(str((r[0], r[1], r[2], r[0] == r[2])) for r in got.collect()) == brute_vectors(rows)


def test_cells_hold_all_in_range():
    """With all cells at hand, the home of each vector in range is one of a vector's cells."""
    r = np.random.default_rng(4)
    for d in (2, 3, 16):
        x = flatgraph._unit(r.normal(size=(600, d)) * r.choice([1, 0.2], size=(1, d)))
        c = x[r.choice(600, 30)]
        near, at = flatgraph._cells(x, c, 0.98, 30), np.argmax(x @ c.T, axis=1)
        i, j = np.nonzero(x @ x.T >= 0.98)
        assert (near[i] == at[j, None]).any(axis=1).all()
        few = flatgraph._cells(x, c, 0.98, 4)
        assert few.shape == (600, 4)
        assert (few == at[:, None]).any(axis=1).all()


def test_search_in_a_region():
    """Against all pairs: spread out, in groups, and one large group of near copies."""
    r = np.random.default_rng(1)
    base = r.normal(size=(100, 32))
    groups = base[r.integers(0, 100, 1200)] + r.normal(size=(1200, 32)) * r.choice([0.05, 0.2], size=(1200, 1))
    hot = np.concatenate([base[:1] + 0.1 * r.normal(size=(900, 32)), r.normal(size=(300, 32))])
    for raw in (r.normal(size=(1500, 3)), groups, hot, base[:1], base[:2]):
        got, unit = flatgraph.links_within(raw, 0.98), flatgraph._unit(raw)
        true = unit @ unit.T >= 0.98
        np.fill_diagonal(true, False)
        assert (got == got.T).all()
        assert not (got & ~true).any()
        assert got.sum() >= 0.999 * true.sum()


def test_pairs_are_counted_in_one_cell():
    near = np.array([[[0, 1, 3]], [[-1, 1, 3]], [[-1, -1, 3]]])
    i, j = np.array([0, 0, 1]), np.array([1, 2, 2])
    assert [flatgraph._first_common(near, i, j, [c]).tolist() for c in (0, 1, 3)] == [[False] * 3, [True, False, False], [False, True, True]]
    assert flatgraph._path((5 + 1) * flatgraph._CENTRES + 1 + 7) == [5, 7]


def test_recall_on_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert flatgraph.audit(spark, table, flatgraph.near_duplicates(spark, table)) >= 0.9

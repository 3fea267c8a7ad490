"""The pipeline's stages on the smallest tables, each against its own input, and the whole against plain Python."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomgraph.llm import bpe, importance, linededup, minhash, mixing, queries
from loomgraph.llm._scratch import Scratch, shared_dir
from odd import ODD
from test_dedup import W, brute_lines, brute_minhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    scratch = Scratch(spark, "test-pipeline")
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    given = {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = docs
        docs = scratch.save(stage(spark, docs, SF), name.replace(" ", "-"))
        if name != "bpe encoding":
            assert docs.dtypes == first.dtypes
        given[name, "out"] = docs
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = importance.resample(spark, given["quality classifier"], labels).filter("kept")
    assert ids(given["quality classifier", "out"]) == ids(kept)
    cut = {r["doc_id"]: r for r in linededup.clean(spark, given["line dedup"]).collect()}
    left = {r["doc_id"]: r for r in given["line dedup", "out"].collect()}
    assert set(left) == {i for i, r in cut.items() if not r["n_cut"] or r["text"].strip()}
    assert all(left[i]["text"] == cut[i]["text"] and left[i]["n_chars"] == len(cut[i]["text"]) for i in left)
    assert ids(given["minhash near-dedup", "out"]) == ids(minhash.near_duplicates(spark, given["minhash near-dedup"]).filter("kept"))
    plan = mixing.plan(spark, given["mixing sources"]).collect()
    assert ids(given["mixing sources", "out"]) == sorted(r["doc_id"] for r in plan for _ in range(r["copies"]))
    coder = bpe.PrefixBpe(queries.tokenizer("word_bpe_49k.json"))
    want = {r["doc_id"]: next(coder.digests([r["text"]])) for r in given["bpe encoding"].collect()}
    assert all(tuple(r)[1:] == want[r["doc_id"]] for r in docs.collect())
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def planted(spark):
    """The smallest documents with odd texts, copies, near copies and a passage that several share; ids are unique."""
    r = random.Random(11)
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    own = lambda n: " ".join("".join(r.choice("etaoinsr") for _ in range(r.randrange(2, 8))) for _ in range(n))
    texts = [*ODD, *(rows[k][1] for k in (0, 0, 0, 5, 9))]
    for k in range(10, 40, 3):
        words = rows[k][1].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    passage = "\n".join(own(12) for _ in range(6))
    texts += [f"{own(30)}\n{passage}\n{own(40)}" for _ in range(9)]
    return rows + [(10_000 + k, t, "en", r.choice(["a", "b", None])) for k, t in enumerate(texts)]


def brute_quality(rows, labels):
    """Plain counts of hashed n-grams, log ratios and Gumbel noise; the rows of the largest sums."""
    good = {}
    for i, q in labels:
        good[i] = max(q, good.get(i, q))
    values = importance.tv.byte_values(lower=True)

    def grams(text):
        buf = np.frombuffer((text or "").encode(), np.uint8)
        found, _ = importance._features(buf, np.array([0, len(buf)]), values)
        return found[found >= 0]

    raw, target = np.ones(importance.BUCKETS), np.ones(importance.BUCKETS)
    for i, t, *_ in rows:
        np.add.at(raw, grams(t), 1)
        if good.get(i) == 1:
            np.add.at(target, grams(t), 1)
    weights = np.log(target / target.sum()) - np.log(raw / raw.sum())

    def total(row):
        u = int(hashlib.md5(f"1:{row[0]}".encode()).hexdigest()[:13], 16) / (1 << 52)
        return weights[grams(row[1])].sum() - math.log(-math.log((u * ((1 << 52) - 2) + 1) / (1 << 52)))

    return sorted(rows, key=total)[len(rows) - round(len(rows) * sum(q == 1 for q in good.values()) / len(good)) :]


def brute_pipeline(rows, labels):
    """Rows and the number of rows after each stage."""
    sizes = []
    rows = brute_quality(rows, labels)
    sizes.append(len(rows))
    cut = {i: (n, t) for i, n, t in brute_lines([x[:2] for x in rows], 50)}
    rows = [(i, cut[i][1], *rest) for i, _, *rest in rows if not cut[i][0] or W.search(cut[i][1])]
    sizes += [len(rows), sum(cut[x[0]][0] > 0 for x in rows)]
    kept = {x for x in brute_minhash([x[:2] for x in rows]) if x.endswith("True)")}
    kept = {int(x[1:].split(",")[0]) for x in kept} | {x[0] for x in rows if not W.search(x[1] or "")}
    rows = [x for x in rows if x[0] in kept]
    sizes.append(len(rows))
    given = pa.table({name: [x[k] for x in rows] for k, name in enumerate(("doc_id", "text", "lang", "source"))})
    copies = dict(duckdb.connect().register("documents", given).execute(f"SELECT doc_id, copies FROM ({mixing.plan_sql()})").fetchall())
    coder = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    coder.no_truncation()
    coder.no_padding()
    out = []
    for i, t, *_ in rows:
        ids = coder.encode(t or "", add_special_tokens=False).ids
        decoded = coder.decode(ids, skip_special_tokens=False)
        out += [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] * copies[i]
    return out, sizes


def test_against_brute_force(spark, tmp_path):
    rows = planted(spark)
    held = [(*x, None if x[1] is None else len(x[1]), "extra") for x in rows]
    spark.createDataFrame(held, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(x["doc_id"], x["quality"]) for x in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    labels += [(i, 1) for i, t, *_ in rows if i >= 10_000 and t and len(t) > 40]
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want, sizes = brute_pipeline(rows, labels)
    first, second, cut, third = sizes
    assert len(rows) > first >= second > third  # each stage has something to do
    assert cut > 3 and len({x[0] for x in want}) < len(want)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(x) for x in got) == sorted(want)


def test_null_and_repeated_ids(spark, docs_of):
    """Each row has its own verdict, and of a group of near-duplicates one row stays."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    docs = docs_of([(None, a), (None, a), (None, b), (7, c), (7, c), (3, b), (None, "w"), (9, None), (9, None)])
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert got.dtypes == docs.dtypes
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, [(None, a), (3, b), (7, c), (None, "w"), (9, None), (9, None)]))
    first = spark.read.parquet(f"{SF}/documents.parquet")
    docs = first.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    kept = importance.resample(spark, docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept")
    got = corpus_pipeline.quality(spark, docs, SF)
    assert got.dtypes == docs.dtypes
    assert 0 < got.filter("doc_id IS NULL").count() == kept.filter("doc_id IS NULL").count() < docs.filter("doc_id IS NULL").count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark, "test-empty").save(stage(spark, docs, SF), name.replace(" ", "-"))
        assert docs.count() == 0


def test_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == named.rstrip("/") if named else "checkpoints" in shared_dir(spark)

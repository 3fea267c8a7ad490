import random

import pytest

import model
from loomgraph.config import BadNameError, GraphError, MixedTypesError, MultivalStrategy, PrefixNotFoundError, StoreConfig, StoreSetupError, UnknownNamespaceError, VocabStrategy
from loomgraph.functions.terms import RDF_TYPE, TRIPLE, XSD
from loomgraph.operators import match
from loomgraph.operators.fold import fold
from loomgraph.operators.store import GraphStore
from loomgraph.sources import read_data
from loomgraph.streaming.ingest import into_store

V, I = "http://garden.example/terms#", "http://garden.example/things#"
GARDEN = f"""
@prefix g: <{V}> . @prefix t: <{I}> .
t:pot a g:Bed , g:Movable ; g:near t:plot7 ; g:storedIn t:shed .
t:rose g:grows t:plot7 ; a g:Shrub ; g:colour "red" , "pink" , "red" .
t:plot7 t:area "14 m2" ; g:area "12 m2" ; g:label "sunny corner" ; a g:Bed .
t:mint g:colour "green" ; g:grows t:pot , t:plot7 .
"""
PREFIXES = {"g": V, "t": I}
IGNORED = {"vocab_strategy": VocabStrategy.IGNORE}


def garden(spark, **how):
    return model.of_graph(fold(read_data(spark, GARDEN), StoreConfig(custom_prefixes=PREFIXES, **how)))


def test_ignore_overwrite(spark):
    """The later of two predicates with one local part wins; a node may be known as a target only."""
    labels, props, edges = garden(spark, **IGNORED)
    assert labels == {I + "pot": {"Resource", "Bed", "Movable"}, I + "rose": {"Resource", "Shrub"}, I + "plot7": {"Resource", "Bed"}, I + "mint": {"Resource"}, I + "shed": {"Resource"}}
    assert props == {I + "plot7": {"area": "12 m2", "label": "sunny corner"}, I + "rose": {"colour": "red"}, I + "mint": {"colour": "green"}}
    assert edges == {(I + a, e, I + b) for a, e, b in [("pot", "near", "plot7"), ("pot", "storedIn", "shed"), ("rose", "grows", "plot7"), ("mint", "grows", "plot7"), ("mint", "grows", "pot")]}


def test_shorten(spark):
    labels, props, edges = garden(spark)
    assert props[I + "plot7"] == {"t__area": "14 m2", "g__area": "12 m2", "g__label": "sunny corner"}
    assert {e[1] for e in edges} == {"g__near", "g__storedIn", "g__grows"}
    assert labels[I + "pot"] == {"Resource", "g__Bed", "g__Movable"}


def test_keep_and_map(spark):
    assert {e[1] for e in garden(spark, vocab_strategy=VocabStrategy.KEEP)[2]} == {V + "near", V + "storedIn", V + "grows"}
    mapped = garden(spark, vocab_strategy=VocabStrategy.MAP, custom_mappings=[("g", "grows", "GROWS_IN"), ("g", "Shrub", "Plant")])
    assert {e[1] for e in mapped[2]} == {"near", "storedIn", "GROWS_IN"}
    assert mapped[0][I + "rose"] == {"Resource", "Plant"}
    assert garden(spark, vocab_strategy=VocabStrategy.MAP, custom_mappings=[("g", "Grows", "X")]) == garden(spark, **IGNORED)


def test_arrays(spark):
    many = {**IGNORED, "multival_strategy": MultivalStrategy.ARRAY}
    _, props, _ = garden(spark, **many)
    assert props[I + "plot7"] == {"area": ["14 m2", "12 m2"], "label": ["sunny corner"]}
    assert props[I + "rose"] == {"colour": ["red", "pink"]}
    _, props, _ = garden(spark, **many, multival_props=[("g", "colour")])
    assert (props[I + "rose"], props[I + "mint"], props[I + "plot7"]) == ({"colour": ["red", "pink"]}, {"colour": ["green"]}, {"area": "12 m2", "label": "sunny corner"})
    assert garden(spark, **IGNORED, multival_props=[("g", "colour")]) == garden(spark, **IGNORED)


def test_strict_names(spark):
    def commit(text, **how):
        store = GraphStore(spark, StoreConfig(custom_prefixes={"t": I}, **how), in_memory=True).open()
        store.parse(data=text)
        try:
            store.commit()
        finally:
            assert store.num_nodes() == 0

    with pytest.raises(UnknownNamespaceError, match="terms#"):
        commit(GARDEN)
    with pytest.raises(BadNameError):
        commit("<http://a> <http://x/> 1 .", vocab_strategy=VocabStrategy.IGNORE)
    with pytest.raises(BadNameError):
        commit("<http://a> a _:b .", vocab_strategy=VocabStrategy.IGNORE)


def test_types_of_an_array(spark):
    store = GraphStore(spark, StoreConfig(vocab_strategy=VocabStrategy.IGNORE, multival_strategy=MultivalStrategy.ARRAY), in_memory=True).open()
    store.parse(data='<http://a> <http://x/p> 1, "one" .')
    with pytest.raises(MixedTypesError):
        store.commit()
    assert store.num_nodes() == 0


def test_config():
    c = StoreConfig(custom_prefixes={"a": "http://a/"})
    with pytest.raises(PrefixNotFoundError):
        c.set_custom_mapping("none", "x", "y")
    with pytest.raises(PrefixNotFoundError):
        c.set_multival_prop("none", "x")
    with pytest.raises(GraphError):
        c.set_custom_prefix("b", "http://a/")
    c.set_custom_prefix("sch", "http://b/")
    assert c.prefixes()["sch"] == "http://b/"
    c.set_custom_mapping("sch", "x", "y")
    c.delete_custom_prefix("sch")
    c.delete_custom_prefix("sch")
    assert c.custom_mappings == {"http://b/x": "y"}
    assert c.prefixes()["sch"] == "http://schema.org/"
    c.set_multival_prop("sch", "p")
    c.set_multival_prop("sch", "p")
    assert c.multival_props == ["http://schema.org/p"]
    c.set_default_prefix("zz", "http://zz/")
    assert "zz" not in StoreConfig().prefixes()
    assert c.as_dict()["batch_size"] == 5000


def test_fine_print(spark):
    text = f"""@prefix v: <{V}> .
    v:a a "a literal, so a property" ; v:uri "dropped" ; v:p "x" .
    v:a v:knows _:b . _:b v:p "y" . v:a v:knows _:b . v:b v:knows v:b ."""
    labels, props, edges = model.of_graph(fold(read_data(spark, text), StoreConfig(vocab_strategy=VocabStrategy.IGNORE)))
    assert labels == {V + "a": {"Resource"}, "bnode://b": {"Resource"}, V + "b": {"Resource"}}
    assert props == {V + "a": {"type": "a literal, so a property", "p": "x"}, "bnode://b": {"p": "y"}}
    assert edges == {(V + "a", "knows", "bnode://b"), (V + "b", "knows", V + "b")}


def random_triples(seed, n=250):
    r = random.Random(seed)
    nodes = [(f"{I}n{k}", "iri") for k in range(6)] + [(f"b{k}", "bnode") for k in range(3)]
    out = []
    for _ in range(n):
        s, sk = r.choice(nodes)
        kind = r.random()
        if kind < 0.5:
            out.append((s, sk, r.choice([V, I]) + f"p{r.randrange(4)}", f"v{r.randrange(5)}", "literal"))
        elif kind < 0.7:
            out.append((s, sk, RDF_TYPE, V + f"C{r.randrange(4)}", "iri"))
        else:
            o, ok = r.choice(nodes)
            out.append((s, sk, V + f"e{r.randrange(3)}", o, ok))
    return out


def frame(spark, rows, start=0):
    return spark.createDataFrame([(("", 0, start + i), s, sk, p, o, ok, XSD + "string" if ok == "literal" else None, None, None) for i, (s, sk, p, o, ok) in enumerate(rows)], TRIPLE)


@pytest.mark.parametrize("strategy", list(VocabStrategy))
@pytest.mark.parametrize("multi", [{}, {"multival_strategy": MultivalStrategy.ARRAY}, {"multival_strategy": MultivalStrategy.ARRAY, "multival_props": [("g", "p1")]}])
def test_against_model(spark, strategy, multi):
    config = StoreConfig(custom_prefixes=PREFIXES, custom_mappings=[("g", "e1", "LINK")], vocab_strategy=strategy, **multi)
    rows = random_triples(len(strategy.name) * 10 + len(multi))
    assert model.of_graph(fold(frame(spark, rows).repartition(5), config)) == model.fold(rows, config)


def test_batches_give_the_same(spark, tmp_path):
    config = StoreConfig(custom_prefixes=PREFIXES, multival_strategy=MultivalStrategy.ARRAY, multival_props=[("g", "p1")], vocab_strategy=VocabStrategy.KEEP)
    rows = random_triples(3)
    want = model.fold(rows, config)
    with GraphStore(spark, config, path=str(tmp_path / "g")) as store:
        for k in range(0, len(rows), 100):
            store.add_all(frame(spark, rows[k : k + 100], k))
            store.commit()
        assert model.of_graph(store.graph()) == want
        store.compact()
        assert model.of_graph(store.graph()) == want
    again = GraphStore(spark, config, path=str(tmp_path / "g")).open(create=False)
    assert model.of_graph(again.graph()) == want
    again.add_all(frame(spark, rows))
    again.add_all(frame(spark, rows))
    assert again.close() == 2 * len(rows)
    assert model.of_graph(GraphStore(spark, config, path=str(tmp_path / "g")).open().graph())[0] == want[0]


def test_store_life(spark, tmp_path):
    config = StoreConfig(vocab_strategy=VocabStrategy.IGNORE)
    with pytest.raises(StoreSetupError):
        GraphStore(spark, config)
    with pytest.raises(StoreSetupError):
        GraphStore(spark, config, path="x", in_memory=True)
    with pytest.raises(GraphError):
        GraphStore(spark, config, path=str(tmp_path / "none")).open(create=False)
    store = GraphStore(spark, config, in_memory=True)
    with pytest.raises(GraphError):
        store.add(("http://a", RDF_TYPE, "http://x/C"))
    assert not store.is_open()
    store.open()
    store.add(("http://a", RDF_TYPE, "http://x/C"))
    store.add((("bnode", "b"), "http://x/p", ("literal", "3", XSD + "integer")))
    store.add(("http://a", "http://x/knows", ("bnode", "b")))
    store.commit(commit_nodes=True)
    assert (store.num_nodes(), store.num_edges()) == (2, 0)
    store.commit(commit_rels=True)
    assert (store.num_nodes(), store.num_edges()) == (2, 1)
    assert len(store) == 0
    with pytest.raises(NotImplementedError):
        store.remove(("http://a", None, None))
    store.add(("http://z", RDF_TYPE, "http://x/C"))
    assert store.close(commit_pending=False) == 4
    store.open()
    assert store.num_nodes() == 2
    store.clear()
    assert store.num_nodes() == 0


def test_switching_strategy(spark):
    store = GraphStore(spark, StoreConfig(vocab_strategy=VocabStrategy.IGNORE), in_memory=True).open()
    store.parse(data='<http://a> <http://x/p> "1" .')
    store.commit()
    store.config.set_multival_strategy(MultivalStrategy.ARRAY)
    store.parse(data='<http://a> <http://x/p> "2" .')
    store.commit()
    assert model.of_graph(store.graph())[1] == {"http://a": {"p": ["1", "2"]}}
    store.config.set_multival_strategy(MultivalStrategy.OVERWRITE)
    store.parse(data='<http://a> <http://x/p> "3" .')
    store.commit()
    assert model.of_graph(store.graph())[1] == {"http://a": {"p": "3"}}


def test_stream(spark, tmp_path):
    config = StoreConfig(vocab_strategy=VocabStrategy.IGNORE)
    rows = random_triples(8)
    for k in range(3):
        frame(spark, rows[k::3]).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    store = GraphStore(spark, config, path=str(tmp_path / "g")).open()
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(TRIPLE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        into_store(stream, store, str(tmp_path / "offsets")).awaitTermination()
    labels, _, edges = model.of_graph(store.graph())
    want = model.fold(rows, config)
    assert (labels, edges) == (want[0], want[2])
    assert store.last_batch("stream") == 2


def test_matches(spark):
    g = fold(read_data(spark, GARDEN), StoreConfig(**IGNORED, multival_strategy=MultivalStrategy.ARRAY, multival_props=[]))
    assert [r["uri"] for r in match.nodes(g).collect()] == sorted(I + n for n in ("pot", "rose", "plot7", "mint", "shed"))
    assert {r["uri"] for r in match.longer_than(g, "colour", 1).collect()} == {I + "rose"}
    assert {r["uri"] for r in match.by_label(g, "Bed").collect()} == {I + "pot", I + "plot7"}
    g = fold(read_data(spark, GARDEN), StoreConfig(**IGNORED))
    rows = {tuple(r) for r in match.hop_values(g, "grows", ["colour"], ["label", "area"]).collect()}
    assert rows == {(I + "rose", I + "plot7", "red", "sunny corner", "12 m2"), (I + "mint", I + "plot7", "green", "sunny corner", "12 m2"), (I + "mint", I + "pot", "green", None, None)}
    t = read_data(spark, GARDEN)
    assert match.pattern(t, "?x", V + "grows", "?x").count() == 0
    # four of its own, three links to it, and of the neighbours' literals and types: two of pot, three of rose, one of mint
    assert match.describe(t, I + "plot7").count() == 4 + 3 + 2 + 3 + 1


def test_empty(spark):
    g = fold(spark.createDataFrame([], TRIPLE), StoreConfig())
    assert model.of_graph(g) == ({}, {}, set())


def test_adding_in_batches(spark, tmp_path):
    """The driver holds a batch at most; with a path, batches wait in files until the commit."""
    config = StoreConfig(**IGNORED, batch_size=3)
    store = GraphStore(spark, config, path=str(tmp_path / "g")).open()
    for k in range(8):
        store.add((f"http://x/{k}", V + "near", "http://x/0"), context="http://ctx/1", quoted=k == 1)
        assert len(store._rows) < 3
    assert len(list((tmp_path / "g/pending").iterdir())) == 2
    assert {r["graph"] for t in store._pending for r in t.collect()} == {"http://ctx/1"}
    store.commit(commit_nodes=True)
    assert not list((tmp_path / "g/pending").iterdir())
    assert store.num_edges() == 0
    store.commit()
    assert (store.num_nodes(), store.num_edges(), store.close()) == (8, 8, 8)


def test_failed_and_rival_commits(spark, tmp_path):
    """A failed commit leaves no files, and of two writers one is told."""
    path = tmp_path / "g"
    config = StoreConfig(**IGNORED, multival_strategy=MultivalStrategy.ARRAY)
    store, rival = GraphStore(spark, config, path=str(path)).open(), GraphStore(spark, config, path=str(path)).open()
    store.parse(data='<http://a> <http://x/p> 1 .')
    store.commit()
    files = sorted(path.glob("log/*"))
    store.parse(data='<http://a> <http://x/p> "one" .')
    with pytest.raises(MixedTypesError):
        store.commit()
    assert sorted(path.glob("log/*")) == files
    rival.parse(data='<http://b> <http://x/p> 2 .')
    with pytest.raises(GraphError, match="another writer"):
        rival.commit()
    assert sorted(path.glob("log/*")) == files
    assert store.num_nodes() == 1
    rival.open()
    rival.parse(data='<http://b> <http://x/p> 2 .')
    rival.commit()
    assert rival.num_nodes() == 2


def test_nodes_with_props(spark):
    g = fold(read_data(spark, GARDEN), StoreConfig(custom_prefixes=PREFIXES, **IGNORED, multival_strategy=MultivalStrategy.ARRAY, multival_props=[("g", "colour")]))
    rows = {r["uri"]: (r["labels"], [(p["prop"], [v["lex"] for v in p["vals"]], p["scalar"]) for p in r["props"]]) for r in match.nodes_with_props(g).collect()}
    assert rows == {
        I + "pot": (["Bed", "Movable", "Resource"], []),
        I + "rose": (["Resource", "Shrub"], [("colour", ["red", "pink"], False)]),
        I + "plot7": (["Bed", "Resource"], [("area", ["12 m2"], True), ("label", ["sunny corner"], True)]),
        I + "mint": (["Resource"], [("colour", ["green"], False)]),
        I + "shed": (["Resource"], []),
    }

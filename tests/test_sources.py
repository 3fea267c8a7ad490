import json

import pytest
from pyspark.errors import PySparkException

from loomgraph.config import GraphError
from loomgraph.functions.terms import RDF, XSD
from loomgraph.sources import format_of, jsonld, rdfxml, read_data, read_files, turtle

COLUMNS = ["subj", "subj_kind", "pred", "obj", "obj_kind", "dtype", "lang", "graph"]


def rows(df):
    return {tuple(r) for r in df.select(*COLUMNS).collect()}


def test_ntriples(spark):
    text = r'''
# a comment
<http://a> <http://p> "x\t\"q\"\\n é \U0001F600"@en-GB .
_:b1 <http://p> <http://c>. # after
<http://a><http://p>"5"^^<http://t> .
<http://a> <http://p> "" .
<http://a> <http://p> _:b1 <http://g> .
'''
    assert rows(read_data(spark, text, "nquads")) == {
        ("http://a", "iri", "http://p", 'x\t"q"\\n é 😀', "literal", None, "en-GB", None),
        ("b1", "bnode", "http://p", "http://c", "iri", None, None, None),
        ("http://a", "iri", "http://p", "5", "literal", "http://t", None, None),
        ("http://a", "iri", "http://p", "", "literal", XSD + "string", None, None),
        ("http://a", "iri", "http://p", "b1", "bnode", None, None, "http://g"),
    }
    with pytest.raises(PySparkException, match="not a statement"):
        read_data(spark, "<http://a> nonsense .", "nt").collect()


def test_order_over_files(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"f{f}.nt").write_text("".join(f'<http://s> <http://p> "{f}-{i:04d}" .\n' for i in range(500)))
    got = read_files(spark, str(tmp_path / "*.nt")).repartition(7).orderBy("ord").select("obj").collect()
    assert [r[0] for r in got] == [f"{f}-{i:04d}" for f in range(3) for i in range(500)]


def test_turtle_forms():
    text = """@base <http://b/> . @prefix : <http://d/> . PREFIX x: <http://x/>
    <r> :p 1, -2.5, 3e1, true, 'single', '''long 'quoted' \\u00e9''', "t"^^x:dt, "l"@de ; ;
        :q [ :r (1 :two) ; a :C ] .
    x:a\\,b :p x:c.d , () . [ :p :o ] . _:n.1 :p _:n.1 ."""
    got = list(turtle.triples(text))
    objects = [(r[3], r[4], r[5], r[6]) for r in got if r[0] == "http://b/r" and r[2] == "http://d/p"]
    assert objects == [
        ("1", "literal", XSD + "integer", None), ("-2.5", "literal", XSD + "decimal", None), ("3e1", "literal", XSD + "double", None), ("true", "literal", XSD + "boolean", None),
        ("single", "literal", XSD + "string", None), ("long 'quoted' é", "literal", XSD + "string", None), ("t", "literal", "http://x/dt", None), ("l", "literal", None, "de"),
    ]
    assert ("http://x/a,b", "iri", "http://d/p", "http://x/c.d", "iri", None, None, None) in got
    assert ("http://x/a,b", "iri", "http://d/p", RDF + "nil", "iri", None, None, None) in got
    assert ("n.1", "bnode", "http://d/p", "n.1", "bnode", None, None, None) in got
    assert sum(r[2] == RDF + "rest" for r in got) == 2


@pytest.mark.parametrize("bad", ["<http://a> <http://p>", "x:a x:p 1 .", '<http://a> <http://p> "x .', '"s" <http://p> 1 .', "<http://a> . "])
def test_turtle_errors(bad):
    with pytest.raises(ValueError, match=r"."):
        list(turtle.triples(bad))


def test_trig():
    got = list(turtle.triples("@prefix : <http://d/> . :g { :a :p 1 . :b :p 2 } GRAPH :h { :c :p 3 } :d :p 4 ."))
    assert [(r[3], r[7]) for r in got] == [("1", "http://d/g"), ("2", "http://d/g"), ("3", "http://d/h"), ("4", None)]


def test_jsonld():
    doc = {
        "@context": {"s": "http://s/", "@vocab": "http://v/", "knows": {"@id": "s:knows", "@type": "@id"}, "when": {"@id": "s:when", "@type": "http://t/date"}, "seq": {"@id": "s:seq", "@container": "@list"}, "off": None},
        "@id": "http://me", "@type": ["Person", "s:Thing"], "knows": ["http://you", {"@id": "_:b", "name": "Bea"}], "when": "today", "seq": [1, 2.5], "off": 1, "flag": True, "n": None,
        "title": {"@value": "Hallo", "@language": "de"}, "address": {"city": "X"},
    }
    got = list(jsonld.triples(json.dumps(doc)))
    flat = {r[2:7] for r in got if r[0] == "http://me"}
    assert {
        (RDF + "type", "http://v/Person", "iri", None, None), (RDF + "type", "http://s/Thing", "iri", None, None), ("http://s/knows", "http://you", "iri", None, None), ("http://s/knows", "b", "bnode", None, None),
        ("http://s/when", "today", "literal", "http://t/date", None), ("http://v/flag", "true", "literal", XSD + "boolean", None), ("http://v/title", "Hallo", "literal", None, "de"),
    } <= flat
    assert not any(p.endswith(("off", "/n")) for p, *_ in flat)
    assert ("b", "bnode", "http://v/name", "Bea", "literal", XSD + "string", None, None) in got
    assert any(r[2] == "http://v/city" and r[1] == "bnode" for r in got)
    assert sum(r[2] == RDF + "first" for r in got) == 2
    assert list(jsonld.triples('[{"@id": "http://only"}]')) == []
    with pytest.raises(ValueError, match="remote"):
        list(jsonld.triples('{"@context": "http://schema.org/", "@id": "x"}'))


def test_rdfxml():
    text = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:v="http://v/" xml:lang="en">
    <v:Person rdf:about="http://me" v:nick="M"><v:name>Me</v:name><v:age rdf:datatype="http://t/int">3</v:age>
    <v:knows rdf:resource="http://you"/><v:home rdf:parseType="Resource"><v:city>X</v:city></v:home><v:pet><v:Dog/></v:pet></v:Person></rdf:RDF>"""
    got = list(rdfxml.triples(text))
    mine = {r[2:7] for r in got if r[0] == "http://me"}
    assert {(RDF + "type", "http://v/Person", "iri", None, None), ("http://v/nick", "M", "literal", None, "en"), ("http://v/name", "Me", "literal", None, "en"), ("http://v/age", "3", "literal", "http://t/int", None), ("http://v/knows", "http://you", "iri", None, None)} <= mine
    assert any(r[1] == "bnode" and r[2] == "http://v/city" for r in got)
    assert any(r[1] == "bnode" and r[3] == "http://v/Dog" for r in got)
    with pytest.raises(ValueError, match="document type"):
        list(rdfxml.triples('<!DOCTYPE x [<!ENTITY a "b">]><x/>'))


def test_formats_agree(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('@prefix v: <http://v/> . v:a v:p "x" ; a v:C ; v:q v:b .')
    (tmp_path / "a.nt").write_text('<http://v/a> <http://v/p> "x" .\n<http://v/a> <%stype> <http://v/C> .\n<http://v/a> <http://v/q> <http://v/b> .\n' % RDF)
    (tmp_path / "a.jsonld").write_text(json.dumps([{"@id": "http://v/a", "@type": ["http://v/C"], "http://v/p": [{"@value": "x"}], "http://v/q": [{"@id": "http://v/b"}]}]))
    (tmp_path / "a.rdf").write_text('<rdf:RDF xmlns:rdf="%s" xmlns:v="http://v/"><v:C rdf:about="http://v/a" v:p="x"><v:q rdf:resource="http://v/b"/></v:C></rdf:RDF>' % RDF)
    one = rows(read_files(spark, str(tmp_path / "a.ttl")))
    assert len(one) == 3
    for name in ("a.nt", "a.jsonld", "a.rdf"):
        assert rows(read_files(spark, str(tmp_path / name))) == one


def test_blank_node_scope(spark, tmp_path):
    for f in "ab":
        (tmp_path / f"{f}.ttl").write_text("_:x <http://p> [ <http://q> 1 ] .")
    path = str(tmp_path / "*.ttl")
    assert read_files(spark, path).filter("pred = 'http://p'").select("subj").distinct().count() == 1
    assert read_files(spark, path).filter("pred = 'http://q'").select("subj").distinct().count() == 2
    assert read_files(spark, path, bnode_scope="file").filter("pred = 'http://p'").select("subj").distinct().count() == 2


def test_refusals(spark):
    with pytest.raises(GraphError):
        read_files(spark, "https://example.org/x.ttl")
    with pytest.raises(GraphError):
        format_of("x.unknown")


def test_a_bad_line_is_an_error_in_every_plan(spark):
    """Also where the columns that hold it aren't asked for."""
    bad = read_data(spark, "<http://a> <http://p> <http://b> .\nnot a statement\n", "nt")
    for ask in (lambda: bad.select("subj", "obj").collect(), lambda: bad.count(), lambda: bad.select("graph").distinct().collect()):
        with pytest.raises(PySparkException, match="not a statement"):
            ask()
    one_pass = read_data(spark, '<http://a> <http://p> "x" .', "nt")._jdf.queryExecution().optimizedPlan().toString()
    assert one_pass.count("regexp_replace") <= 2 and "regexp_extract" not in one_pass

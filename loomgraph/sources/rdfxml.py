"""RDF/XML. Documents with a document type are refused, so no entity is ever expanded."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from loomgraph.functions.terms import RDF, XSD
from loomgraph.sources._documents import Row, parse_each, read_each, scope_of

_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + RDF + "}"


def _iri(tag: str) -> str:
    return tag[1:].replace("}", "", 1)


class _Reader:
    def __init__(self, base: str, scope: str):
        self.base, self.scope, self.count, self.rows = base, scope, 0, []

    def fresh(self) -> tuple[str, str]:
        self.count += 1
        return (f"genid{self.scope}-{self.count}", "bnode")

    def full(self, x: str) -> str:
        return urljoin(self.base, x) if self.base else x

    def node(self, e, lang: str | None) -> tuple[str, str]:
        lang = e.get(_XML + "lang", lang)
        if (about := e.get(_R + "about")) is not None:
            me = (self.full(about), "iri")
        elif (own := e.get(_R + "ID")) is not None:
            me = (self.full("#" + own), "iri")
        elif (name := e.get(_R + "nodeID")) is not None:
            me = (name, "bnode")
        else:
            me = self.fresh()
        if e.tag != _R + "Description":
            self.rows.append((*me, RDF + "type", _iri(e.tag), "iri", None, None, None))
        self.attributes(me, e, lang)
        items = 0
        for child in e:
            pred = _iri(child.tag)
            if pred == RDF + "li":
                items += 1
                pred = f"{RDF}_{items}"
            self.property(me, pred, child, lang)
        return me

    def attributes(self, me: tuple[str, str], e, lang: str | None) -> None:
        for key, value in e.attrib.items():
            if key == _R + "type":
                self.rows.append((*me, RDF + "type", self.full(value), "iri", None, None, None))
            elif key[0] == "{" and not key.startswith((_R, _XML)):
                self.rows.append((*me, _iri(key), value, "literal", None if lang else XSD + "string", lang, None))

    def property(self, me: tuple[str, str], pred: str, e, lang: str | None) -> None:
        lang = e.get(_XML + "lang", lang) or None
        how = e.get(_R + "parseType")
        if how == "Resource":
            inner = self.fresh()
            self.rows.append((*me, pred, *inner, None, None, None))
            for child in e:
                self.property(inner, _iri(child.tag), child, lang)
        elif how == "Collection":
            cells = [self.fresh() for _ in e]
            nil = (RDF + "nil", "iri")
            self.rows.append((*me, pred, *(cells[0] if cells else nil), None, None, None))
            for n, child in enumerate(e):
                self.rows.append((*cells[n], RDF + "first", *self.node(child, lang), None, None, None))
                self.rows.append((*cells[n], RDF + "rest", *(cells[n + 1] if n + 1 < len(cells) else nil), None, None, None))
        elif how == "Literal":
            text = (e.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in e)
            self.rows.append((*me, pred, text, "literal", RDF + "XMLLiteral", None, None))
        elif (target := e.get(_R + "resource")) is not None:
            obj = (self.full(target), "iri")
            self.rows.append((*me, pred, *obj, None, None, None))
            self.attributes(obj, e, lang)
        elif (name := e.get(_R + "nodeID")) is not None:
            self.rows.append((*me, pred, name, "bnode", None, None, None))
        elif len(e):
            self.rows.append((*me, pred, *self.node(e[0], lang), None, None, None))
        else:
            dtype = e.get(_R + "datatype")
            self.rows.append((*me, pred, e.text or "", "literal", self.full(dtype) if dtype else None if lang else XSD + "string", None if dtype else lang, None))


def triples(text: str | None, base: str = "") -> Iterator[Row]:
    """Triples of one document."""
    if not text or not text.strip():
        return
    if re.search(r"<!DOCTYPE|<!ENTITY", text, re.I):
        raise ValueError("documents with a document type aren't read")
    root = ElementTree.fromstring(text)  # noqa: S314  entities were ruled out
    reader = _Reader(root.get(_XML + "base", base), scope_of(text, base))
    for e in root if root.tag == _R + "RDF" else [root]:
        reader.node(e, root.get(_XML + "lang"))
    yield from reader.rows


def parse(documents: DataFrame) -> DataFrame:
    return parse_each(documents, triples)


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_each(spark, path, triples)

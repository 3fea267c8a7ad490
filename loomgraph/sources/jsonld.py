"""JSON-LD: expanded documents, and compact ones with an inline context. No context is ever fetched."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession

from loomgraph.functions.terms import RDF, XSD
from loomgraph.sources._documents import Row, parse_each, read_each, scope_of


class _Context:
    """Terms of an inline context: name to (IRI, type, language, container)."""

    def __init__(self, base: str = ""):
        self.terms: dict[str, dict] = {}
        self.vocab: str | None = None
        self.base, self.language = base, None

    def extended(self, given) -> _Context:
        out = _Context(self.base)
        out.terms, out.vocab, out.language = dict(self.terms), self.vocab, self.language
        for part in given if isinstance(given, list) else [given]:
            if part is None:
                out = _Context(self.base)
            elif isinstance(part, str):
                raise ValueError(f"context {part!r} is remote; only inline contexts are read")
            else:
                out._add(part)
        return out

    def _add(self, part: dict) -> None:
        for key in ("@vocab", "@base", "@language"):
            if key in part:
                setattr(self, key[1:], part[key])
        for name, value in part.items():
            if not name.startswith("@"):
                self.terms[name] = value if isinstance(value, dict) else {"@id": value}

    def iri(self, name: str, vocab: bool) -> str | None:
        """Full IRI, keyword or blank node of a name; None if it stands for nothing."""
        if name.startswith(("@", "_:")):
            return name
        if vocab and name in self.terms:
            target = self.terms[name].get("@id", name)
            if target is None:
                return None
            return self.iri(target, True) if target != name else target
        prefix, colon, rest = name.partition(":")
        if colon and not rest.startswith("//") and prefix in self.terms:
            return (self.iri(prefix, True) or "") + rest
        if re.match(r"[A-Za-z][\w+.-]*:", name):
            return name
        if vocab:
            return self.vocab + name if self.vocab is not None else None
        return urljoin(self.base, name) if self.base else name


class _Reader:
    def __init__(self, scope: str):
        self.count, self.scope = 0, scope
        self.graph: str | None = None

    def fresh(self) -> str:
        self.count += 1
        return f"_:genid{self.scope}-{self.count}"

    @staticmethod
    def term(iri: str) -> tuple[str, str]:
        return (iri[2:], "bnode") if iri.startswith("_:") else (iri, "iri")

    def node(self, x: dict, context: _Context) -> tuple[str, list[Row]]:
        """The node's id and its triples, those of nested nodes before the link to them."""
        if "@context" in x:
            context = context.extended(x["@context"])
        keys = {k: context.iri(k, True) for k in x}
        told = next((x[k] for k, i in keys.items() if i == "@id"), None)
        me = context.iri(told, False) if told is not None else self.fresh()
        subject, rows = self.term(me), []
        for key, value in x.items():
            iri = keys[key]
            if iri is None or iri in {"@context", "@id", "@index"}:
                continue
            many = value if isinstance(value, list) else [value]
            if iri == "@type":
                for t in many:
                    if (c := context.iri(t, True)) is None and ":" not in t:
                        continue
                    rows.append((*subject, RDF + "type", *self.term(c or t), None, None, self.graph))
            elif iri == "@graph":
                outer, self.graph = self.graph, me if len([i for i in keys.values() if i not in {"@context", "@graph"}]) else self.graph
                for item in many:
                    rows += self.node(item, context)[1]
                self.graph = outer
            elif iri == "@reverse":
                for name, items in value.items():
                    for item in items if isinstance(items, list) else [items]:
                        other, inner = self.node(item, context)
                        rows += [*inner, (*self.term(other), context.iri(name, True), *subject, None, None, self.graph)]
            elif not iri.startswith("@") and ":" in iri:
                how = context.terms.get(key, {})
                container = how.get("@container")
                if container == "@language" and isinstance(value, dict):
                    many = [{"@value": v, "@language": lang} for lang, vs in value.items() for v in (vs if isinstance(vs, list) else [vs])]
                elif container == "@list":
                    many = [{"@list": many}]
                for item in many:
                    obj, inner = self.value(item, how, context)
                    rows += inner
                    if obj:
                        rows.append((*subject, iri, *obj, self.graph))
        return me, rows

    def value(self, item, how: dict, context: _Context) -> tuple[tuple | None, list[Row]]:
        """An object (text, kind, datatype, language) and triples that come with it."""
        if item is None:
            return None, []
        if isinstance(item, dict):
            keys = {context.iri(k, True): v for k, v in item.items()}
            if "@value" in keys:
                kind = context.iri(keys["@type"], True) if keys.get("@type") else None
                return self.literal(keys["@value"], kind, keys.get("@language")), []
            if "@list" in keys:
                return self.listed(keys["@list"] if isinstance(keys["@list"], list) else [keys["@list"]], how, context)
            if "@set" in keys:
                raise ValueError("nested @set")
            me, rows = self.node(item, context)
            return (*self.term(me), None, None), rows
        kind = how.get("@type")
        if isinstance(item, str) and kind in {"@id", "@vocab"}:
            return (*self.term(context.iri(item, kind == "@vocab") or item), None, None), []
        language = how.get("@language", context.language) if isinstance(item, str) and not kind else None
        return self.literal(item, context.iri(kind, True) if kind else None, language), []

    def listed(self, items: list, how: dict, context: _Context) -> tuple[tuple, list[Row]]:
        rows, cells = [], [self.fresh() for _ in items]
        for n, item in enumerate(items):
            obj, inner = self.value(item, {k: v for k, v in how.items() if k != "@container"}, context)
            after = self.term(cells[n + 1]) if n + 1 < len(cells) else (RDF + "nil", "iri")
            rows += [*inner, (*self.term(cells[n]), RDF + "first", *obj, self.graph), (*self.term(cells[n]), RDF + "rest", *after, None, None, self.graph)]
        return (*(self.term(cells[0]) if cells else (RDF + "nil", "iri")), None, None), rows

    @staticmethod
    def literal(x, kind: str | None, language: str | None) -> tuple | None:
        if x is None:
            return None
        if isinstance(x, bool):
            return ("true" if x else "false", "literal", kind or XSD + "boolean", None)
        if isinstance(x, int):
            return (str(x), "literal", kind or XSD + "integer", None)
        if isinstance(x, float):
            whole = x.is_integer() and abs(x) < 1e21 and kind is None
            return (str(int(x)), "literal", XSD + "integer", None) if whole else (repr(x), "literal", kind or XSD + "double", None)
        return (x, "literal", None if language else kind or XSD + "string", language)


def triples(text: str | None, base: str = "") -> Iterator[Row]:
    """Triples of one document. Objects with nothing but an id give none."""
    found = json.loads(text) if text and text.strip() else []
    reader = _Reader(scope_of(text or "", base))
    for item in found if isinstance(found, list) else [found]:
        yield from reader.node(item, _Context(base))[1]


def parse(documents: DataFrame) -> DataFrame:
    return parse_each(documents, triples)


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_each(spark, path, triples)

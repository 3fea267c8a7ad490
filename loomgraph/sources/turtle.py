"""Turtle, with TriG's graph blocks: a tokenizer and a parser by recursive descent."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession

from loomgraph.functions.terms import RDF, XSD
from loomgraph.sources._documents import Row, parse_each, read_each, scope_of

_NAME = r"(?:[\w·À-￿-]|\.(?=[\w·:%\\À-￿.-]*[\w·:%\\À-￿-])|:|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])"
_TOKENS = re.compile(
    rf"""(?P<skip>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{{}}|^`\x00-\x20]*>)
    |(?P<string>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<bnode>_:[\w·À-￿](?:[\w·À-￿-]|\.(?=[\w·À-￿.-]*[\w·À-￿-]))*)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+)(?![\w:]))
    |(?P<name>(?:[A-Za-zÀ-￿](?:[\wÀ-￿.-]*[\wÀ-￿-])?)?:(?:{_NAME})*)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>\^\^|[.;,\[\](){{}}])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), text) if "\\" in text else text


class _Parser:
    def __init__(self, text: str, base: str):
        self.text, self.base = text, base
        self.prefixes: dict[str, str] = {}
        self.count, self.scope = 0, scope_of(text, base)
        self.graph: str | None = None
        self.out: list[Row] = []
        self.tokens = self._scan()
        self.kind, self.value, self.at = next(self.tokens)

    def _scan(self) -> Iterator[tuple[str, str, int]]:
        at, n = 0, len(self.text)
        while at < n:
            m = _TOKENS.match(self.text, at)
            if not m:
                self._fail(at)
            at = m.end()
            if m.lastgroup != "skip":
                yield m.lastgroup, m[0], m.start()
        yield "end", "", n

    def _fail(self, at: int):
        raise ValueError(f"line {self.text.count(chr(10), 0, at) + 1}: unexpected {self.text[at : at + 20]!r}")

    def take(self, expected: str | None = None) -> str:
        if expected is not None and self.value != expected:
            self._fail(self.at)
        value = self.value
        self.kind, self.value, self.at = next(self.tokens, ("end", "", len(self.text)))
        return value

    def run(self) -> Iterator[Row]:
        while self.kind != "end":
            word = self.value.lower() if self.kind in {"word", "at"} else ""
            if word.lstrip("@") in {"prefix", "base"}:
                self.take()
                if word.endswith("prefix"):
                    name = self.take()
                    self.prefixes[name[:-1]] = self.iri(self.take())
                else:
                    self.base = self.iri(self.take())
                if word[0] == "@":
                    self.take(".")
            elif word == "graph":
                self.take()
                self.block(self.term()[0])
            elif self.value == "{":
                self.block(None)
            else:
                self.statement()
            yield from self.out
            self.out.clear()

    def block(self, graph: str | None) -> None:
        self.graph = graph
        self.take("{")
        while self.value != "}":
            self.statement(closed=False)
        self.take("}")
        self.graph = None

    def statement(self, closed: bool = True) -> None:
        bracket = self.value == "["
        subject = self.term()
        if self.value == "{" and closed:
            self.block(subject[0])
            return
        if not (bracket and self.value in {".", "}"}):
            self.properties(subject)
        if closed or self.value == ".":
            self.take(".")

    def properties(self, subject: tuple) -> None:
        while True:
            predicate = RDF + "type" if self.kind == "word" and self.value == "a" else None
            if predicate:
                self.take()
            elif self.kind in {"iri", "name"}:
                predicate = self.term()[0]
            else:
                self._fail(self.at)
            while True:
                self.emit(subject, predicate, self.term())
                if self.value != ",":
                    break
                self.take()
            if self.value != ";":
                return
            while self.value == ";":
                self.take()
            if self.value in {".", "]", "}"} or self.kind == "end":
                return

    def emit(self, subject: tuple, predicate: str, obj: tuple) -> None:
        if subject[1] == "literal":
            raise ValueError(f"a literal can't be a subject: {subject[0]!r}")
        self.out.append((subject[0], subject[1], predicate, *obj, self.graph))

    def fresh(self) -> tuple:
        self.count += 1
        return (f"genid{self.scope}-{self.count}", "bnode", None, None)

    def iri(self, token: str) -> str:
        found = unescape(token[1:-1])
        return urljoin(self.base, found) if self.base and not re.match(r"[A-Za-z][\w+.-]*:", found) else found

    def term(self) -> tuple:
        """(text, kind, datatype, language); collections and property lists are emitted on the way."""
        kind, value, at = self.kind, self.value, self.at
        self.take()
        if kind == "iri":
            return (self.iri(value), "iri", None, None)
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"prefix {prefix!r} isn't declared")
            return (self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), "iri", None, None)
        if kind == "bnode":
            return (value[2:], "bnode", None, None)
        if kind == "string":
            quotes = 3 if value[:3] in {'"""', "'''"} and len(value) >= 6 else 1
            text = unescape(value[quotes:-quotes])
            if self.kind == "at":
                return (text, "literal", None, self.take()[1:])
            if self.value == "^^":
                self.take()
                return (text, "literal", self.term()[0], None)
            return (text, "literal", XSD + "string", None)
        if kind == "number":
            name = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
            return (value, "literal", XSD + name, None)
        if kind == "word" and value in {"true", "false"}:
            return (value, "literal", XSD + "boolean", None)
        if value == "[":
            node = self.fresh()
            if self.value != "]":
                self.properties(node)
            self.take("]")
            return node
        if value == "(":
            head = previous = None
            while self.value != ")":
                item = self.term()
                node = self.fresh()
                if previous:
                    self.emit(previous, RDF + "rest", node)
                head, previous = head or node, node
                self.emit(node, RDF + "first", item)
            self.take(")")
            nil = (RDF + "nil", "iri", None, None)
            if previous:
                self.emit(previous, RDF + "rest", nil)
            return head or nil
        self._fail(at)


def triples(text: str | None, base: str = "") -> Iterator[Row]:
    """Triples of one document."""
    return _Parser(text or "", base).run()


def parse(documents: DataFrame) -> DataFrame:
    return parse_each(documents, triples)


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_each(spark, path, triples)

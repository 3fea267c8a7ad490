"""Readers: files or inline text to triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.config import GraphError
from loomgraph.sources import jsonld, lines, rdfxml, turtle

# Format names and file extensions.
FORMATS = {
    "ntriples": "ntriples", "nt": "ntriples", "nt11": "ntriples", "nquads": "nquads", "nq": "nquads",
    "turtle": "turtle", "ttl": "turtle", "trig": "turtle", "n3": "turtle",
    "json-ld": "jsonld", "jsonld": "jsonld", "json": "jsonld",
    "xml": "rdfxml", "rdf": "rdfxml", "owl": "rdfxml", "rdfxml": "rdfxml", "pretty-xml": "rdfxml",
}


def format_of(path: str, named: str | None = None) -> str:
    """The format by name, or else by the file's extension."""
    key = named or path.rstrip("/").rpartition("/")[2].rpartition(".")[2]
    if key.lower() not in FORMATS:
        raise GraphError(f"unknown format {key!r}")
    return FORMATS[key.lower()]


def read_files(spark: SparkSession, path: str | list[str], format: str | None = None, bnode_scope: str = "none") -> DataFrame:  # noqa: A002
    """Triples of files by any path Spark can read.

    :param bnode_scope: ``none``: equal blank node ids of several files are one node; ``file``: each file has its own.
    """
    first = path if isinstance(path, str) else path[0]
    if not isinstance(first, str) or first.split(":", 1)[0].lower() in {"http", "https", "ftp"}:
        raise GraphError("only files are read, not web addresses")
    kind = format_of(first, format)
    if kind in {"ntriples", "nquads"}:
        out = lines.read(spark, path)
    else:
        out = {"turtle": turtle, "jsonld": jsonld, "rdfxml": rdfxml}[kind].read(spark, path)
    return lines.scoped(out) if bnode_scope == "file" else out


def read_data(spark: SparkSession, text: str, format: str = "turtle") -> DataFrame:  # noqa: A002
    """Triples of inline text."""
    kind = format_of("", format)
    if kind in {"ntriples", "nquads"}:
        rows = spark.createDataFrame([("", 0, i, x) for i, x in enumerate(text.split("\n"))], "file string, block long, row long, value string")
        return lines.parse(rows)
    documents = spark.createDataFrame([("", text)], "file string, value string")
    return {"turtle": turtle, "jsonld": jsonld, "rdfxml": rdfxml}[kind].parse(documents)

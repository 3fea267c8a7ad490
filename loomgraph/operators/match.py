"""Reading a graph by patterns, and algebra on triples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.terms import RDF_TYPE
from loomgraph.operators.fold import Graph


def nodes(graph: Graph) -> DataFrame:
    """All nodes: uri, labels (sorted), in order of uri."""
    return graph.labels.groupBy("uri").agg(F.array_sort(F.collect_set("label")).alias("labels")).orderBy("uri")


def nodes_with_props(graph: Graph) -> DataFrame:
    """All nodes in order of uri: uri, labels (sorted), props (array of prop, vals, scalar, sorted by prop; empty if there are none)."""
    props = graph.all_props().groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("prop", "vals", "scalar"))).alias("props"))
    labels = graph.labels.groupBy("uri").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    none = F.array().cast(props.schema["props"].dataType)
    return labels.join(props, "uri", "left").withColumn("props", F.coalesce("props", none)).orderBy("uri")


def edges(graph: Graph) -> DataFrame:
    """All relationships in order of src and dst. Both ends are nodes by construction, so no join is needed."""
    return graph.edges.orderBy("src", "dst", "type")


def by_label(graph: Graph, label: str) -> DataFrame:
    return graph.labels.filter(F.col("label") == label).select("uri")


def by_uri(graph: Graph, uri: str) -> DataFrame:
    """One node's labels, filtered before they are gathered."""
    return graph.labels.filter(F.col("uri") == uri).groupBy("uri").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def by_prefix(graph: Graph, prefix: str) -> DataFrame:
    return graph.node_ids.filter(F.col("uri").startswith(prefix))


def longer_than(graph: Graph, prop: str, size: int) -> DataFrame:
    """Nodes whose array ``prop`` has more than ``size`` values: uri, vals."""
    return graph.arrays.filter((F.col("prop") == prop) & (F.size("vals") > size)).select("uri", "vals")


def values(graph: Graph, props: Sequence[str], of: str = "uri") -> DataFrame:
    """One row for each node that has any of the scalar ``props``, with a column for each (its text)."""
    wanted = graph.props.filter(F.col("prop").isin(list(props)))
    return wanted.groupBy(F.col("uri").alias(of)).pivot("prop", list(props)).agg(F.first("value.lex"))


def hop(graph: Graph, rel: str, src: Column | None = None, dst: Column | None = None) -> DataFrame:
    """(src)-[rel]->(dst) with conditions on the ends' uris, which are applied before any join."""
    found = graph.edges.filter(F.col("type") == rel).select("src", "dst")
    for condition in (src, dst):
        if condition is not None:
            found = found.filter(condition)
    return found


def hop_values(graph: Graph, rel: str, src_props: Sequence[str], dst_props: Sequence[str]) -> DataFrame:
    """A hop with properties of both ends as src_<prop> and dst_<prop>; ends without them have nulls."""
    out = hop(graph, rel)
    for side, props in (("src", src_props), ("dst", dst_props)):
        if props:
            v = values(graph, props, f"_{side}")
            v = v.select(f"_{side}", *(F.col(f"`{p}`").alias(f"{side}_{p}") for p in props))
            out = out.join(v, out[side] == v[f"_{side}"], "left").drop(f"_{side}")
    return out


def pattern(triples: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """Rows of a triple pattern. Terms that begin with ``?`` are variables and become columns; others are constants."""
    out = triples
    columns: dict[str, str] = {}
    for term, column in ((s, "subj"), (p, "pred"), (o, "obj")):
        if not term.startswith("?"):
            out = out.filter(F.col(column) == term)
        elif term[1:] in columns:
            out = out.filter(F.col(column) == F.col(columns[term[1:]]))
        else:
            columns[term[1:]] = column
    kinds = [F.col("obj_kind").alias(f"{o[1:]}_kind")] if o.startswith("?") else []
    return out.select(*(F.col(c).alias(v) for v, c in columns.items()), *kinds)


def join_patterns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on all shared variables; kinds of shared variables are taken from the left."""
    shared = [c for c in left.columns if c in right.columns and not c.endswith("_kind")]
    if not shared:
        raise ValueError("patterns share no variable")
    return left.join(right.drop(*(c for c in right.columns if c.endswith("_kind") and c in left.columns)), shared)


def construct(*branches: DataFrame) -> DataFrame:
    """The set of triples (s, p, o, o_kind) of several branches."""
    out = branches[0].select("s", "p", "o", "o_kind")
    for b in branches[1:]:
        out = out.unionByName(b.select("s", "p", "o", "o_kind"))
    return out.distinct()


def describe(triples: DataFrame, iri: str) -> DataFrame:
    """Triples around one resource: its own, and literals and types of its neighbours either way."""
    spo = pattern(triples, "?s", "?p", "?o")
    own = spo.filter((F.col("s") == iri) | (F.col("o") == iri))
    told = (F.col("o_kind") == "literal") | (F.col("p") == RDF_TYPE)
    out_way = join_patterns(pattern(triples, iri, "?x", "?s").filter(F.col("x") != RDF_TYPE).select("s"), spo).filter(told)
    in_way = join_patterns(pattern(triples, "?s", "?x", iri).select("s"), spo).filter(told)
    return construct(own, out_way, in_way)

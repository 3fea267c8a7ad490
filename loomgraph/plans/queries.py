"""Registered queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.config import MultivalStrategy, VocabStrategy
from loomgraph.functions import vocab
from loomgraph.functions.terms import RDF, RDF_TYPE, XSD, local_part_or_null, namespace_part_or_null, node_uri, typed_value
from loomgraph.operators import fold, match
from loomgraph.operators.store import GraphStore
from loomgraph.plans.tables import EX, IND, VOC, config, triples, triples_sql
from loomgraph.sources import jsonld, lines, rdfxml, read_files, turtle
from loomgraph.streaming.ingest import into_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


_NODE = "CASE WHEN {0}_kind = 'bnode' THEN 'bnode://' || {0} ELSE {0} END"
_SUBJ, _OBJ = _NODE.format("subj"), _NODE.format("obj")
_LOCAL = "regexp_extract({0}, CASE WHEN {0} LIKE '%#%' THEN '[^#]*$' WHEN {0} LIKE '%/%' THEN '[^/]*$' ELSE '[^:]*$' END)"
_IS_LABEL = f"pred = '{RDF_TYPE}' AND obj_kind <> 'literal'"
_ORDER = "(rule, ord)"


def _joined(values: Column) -> Column:
    """Texts of an array of values, joined in order."""
    return F.array_join(F.transform(values, lambda v: v["lex"]), ",")


ALL = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events", "conversations", "labels")


@_query(f"WITH {triples_sql(*ALL)} SELECT CASE WHEN obj_kind = 'literal' THEN 'prop' WHEN pred = '{RDF_TYPE}' THEN 'label' ELSE 'edge' END AS kind, count(*) AS n FROM triples GROUP BY 1")
def classify_counts(spark, sf):
    """Labels, properties and relationships among all triples."""
    return triples(spark, sf, *ALL).groupBy(fold.kind_of().alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT page_id, {_LOCAL.format('url')} AS local FROM pages")
def local_part(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", local_part_or_null("url").alias("local"))


@_query(f"SELECT page_id, left(url, length(url) - length({_LOCAL.format('url')})) AS namespace FROM pages")
def namespace_part(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", namespace_part_or_null("url").alias("namespace"))


def _names(spark, sf, strategy, **more):
    used = vocab.used_names(triples(spark, sf, "nation", "customer", "events", "collision"))
    return used.select("iri", vocab.name_or_null("iri", config(strategy, **more)).alias("name"))


_USED = f"WITH {triples_sql('nation', 'customer', 'events', 'collision')}, used AS (SELECT DISTINCT CASE WHEN {_IS_LABEL} THEN obj ELSE pred END AS iri FROM triples)"
_SHORT = f"CASE WHEN iri LIKE '{VOC}%' THEN 'voc__' WHEN iri LIKE '{IND}%' THEN 'ind__' WHEN iri LIKE 'http://www.w3.org/1999/02/22-rdf-syntax-ns#%' THEN 'rdf__' END || {_LOCAL.format('iri')}"


@_query(f"{_USED} SELECT iri, {_SHORT} AS name FROM used")
def vocab_shorten(spark, sf):
    return _names(spark, sf, VocabStrategy.SHORTEN)


@_query(f"{_USED} SELECT iri, CASE iri WHEN '{VOC}inNation' THEN 'IN_NATION' WHEN '{VOC}Customer' THEN 'CLIENT' ELSE {_LOCAL.format('iri')} END AS name FROM used")
def vocab_map(spark, sf):
    return _names(spark, sf, VocabStrategy.MAP, custom_mappings=[("voc", "inNation", "IN_NATION"), ("voc", "Customer", "CLIENT"), ("voc", "name", VOC + "name")])


@_query(f"{_USED} SELECT iri, iri AS name FROM used")
def vocab_keep(spark, sf):
    return _names(spark, sf, VocabStrategy.KEEP)


@_query(f"{_USED} SELECT iri, {_LOCAL.format('iri')} AS name FROM used")
def vocab_ignore(spark, sf):
    return _names(spark, sf, VocabStrategy.IGNORE)


@_query(f"WITH {triples_sql('conversations')} SELECT {_SUBJ} AS uri, count(*) AS n FROM triples GROUP BY 1")
def bnode_rewrite(spark, sf):
    return triples(spark, sf, "conversations").groupBy(node_uri("subj", "subj_kind").alias("uri")).agg(F.count(F.lit(1)).alias("n"))


_NODES = f"SELECT {_SUBJ} AS uri FROM triples UNION SELECT {_OBJ} FROM triples WHERE obj_kind <> 'literal' AND pred <> '{RDF_TYPE}'"


@_query(f"WITH {triples_sql('orders', 'lineitem', 'conversations')} {_NODES}")
def node_merge(spark, sf):
    """Every subject and every object of a relationship is one node."""
    return fold.fold(triples(spark, sf, "orders", "lineitem", "conversations"), config()).node_ids


_LABELS = f"WITH {{0}}, pairs AS (SELECT DISTINCT {_SUBJ} AS uri, {_LOCAL.format('obj')} AS label FROM triples WHERE {_IS_LABEL} UNION SELECT uri, 'Resource' FROM ({_NODES}))"


@_query(_LABELS.format(triples_sql("customer")) + " SELECT uri, string_agg(label, ',' ORDER BY label) AS labels FROM pairs GROUP BY uri")
def labels_union(spark, sf):
    g = fold.fold(triples(spark, sf, "customer"), config())
    return match.nodes(g).select("uri", F.array_join("labels", ",").alias("labels"))


@_query(f"WITH {triples_sql('events')} SELECT {_SUBJ} AS uri, {_LOCAL.format('pred')} AS prop, arg_max(obj, {_ORDER}) AS value FROM triples WHERE obj_kind = 'literal' GROUP BY ALL")
def props_overwrite(spark, sf):
    """The last value of each property, by arrival."""
    g = fold.fold(triples(spark, sf, "events"), config())
    return g.props.select("uri", "prop", F.col("value.lex").alias("value"))


def _arrays_sql(keep: str) -> str:
    return f"""firsts AS (SELECT {_SUBJ} AS uri, {_LOCAL.format("pred")} AS prop, pred, obj, min({_ORDER}) AS first FROM triples WHERE obj_kind = 'literal' {keep} GROUP BY ALL)"""


@_query(f"WITH {triples_sql('events')}, {_arrays_sql('')} SELECT uri, prop, string_agg(obj, ',' ORDER BY first) AS vals FROM firsts GROUP BY ALL")
def props_array_all(spark, sf):
    """All properties as sets in order of first arrival."""
    g = fold.fold(triples(spark, sf, "events"), config(multival_strategy=MultivalStrategy.ARRAY))
    return g.arrays.select("uri", "prop", _joined(F.col("vals")).alias("vals"))


_LISTED = f"AND pred = '{VOC}lastEvent'"


@_query(
    f"WITH {triples_sql('events')}, {_arrays_sql(_LISTED)} SELECT uri, prop, false AS scalar, string_agg(obj, ',' ORDER BY first) AS vals FROM firsts GROUP BY uri, prop "
    f"UNION ALL SELECT {_SUBJ}, {_LOCAL.format('pred')}, true, arg_max(obj, {_ORDER}) FROM triples WHERE obj_kind = 'literal' AND pred <> '{VOC}lastEvent' GROUP BY ALL"
)
def props_array_listed(spark, sf):
    """Listed properties as arrays, the others as scalars."""
    g = fold.fold(triples(spark, sf, "events"), config(multival_strategy=MultivalStrategy.ARRAY, multival_props=[("voc", "lastEvent")]))
    return g.all_props().select("uri", "prop", "scalar", _joined(F.col("vals")).alias("vals"))


@_query(f"WITH {triples_sql('collision')} SELECT {_SUBJ} AS uri, 'seen' AS prop, arg_max(obj, {_ORDER}) AS value FROM triples GROUP BY 1")
def props_collision(spark, sf):
    """Two predicates with one name are one property."""
    g = fold.fold(triples(spark, sf, "collision"), config())
    return g.props.select("uri", "prop", F.col("value.lex").alias("value"))


_TYPED = f"CASE dtype WHEN '{XSD}decimal' THEN 'double' WHEN '{XSD}integer' THEN 'long' WHEN '{XSD}boolean' THEN 'boolean' ELSE 'string' END"


@_query(f"WITH {triples_sql('customer', 'events', 'labels')} SELECT {_LOCAL.format('pred')} AS prop, {_TYPED} AS vt, count(*) AS n, CAST(sum(CASE WHEN {_TYPED} IN ('double', 'long') THEN CAST(CAST(obj AS DECIMAL(18, 2)) * 100 AS BIGINT) ELSE 0 END) AS BIGINT) AS hundredths FROM triples WHERE obj_kind = 'literal' GROUP BY ALL")
def typed_values(spark, sf):
    """Literals by the type they are kept with."""
    t = triples(spark, sf, "customer", "events", "labels").filter("obj_kind = 'literal'").select(local_part_or_null("pred").alias("prop"), typed_value("obj", "dtype").alias("v"))
    number = F.when(F.col("v.vt").isin("double", "long"), F.col("v.lex").try_cast("double").cast("decimal(18,2)") * 100).otherwise(0)
    return t.groupBy("prop", F.col("v.vt").alias("vt")).agg(F.count(F.lit(1)).alias("n"), F.sum(number.cast("long")).alias("hundredths"))


@_query(f"WITH {triples_sql('events', 'collision')} SELECT {_SUBJ} AS uri, count(DISTINCT CASE WHEN dtype IS NULL THEN 'string' ELSE 'long' END) AS n_types FROM triples GROUP BY 1")
def array_types(spark, sf):
    """Number of value types that would meet if a node's properties were one array."""
    t = triples(spark, sf, "events", "collision").select(node_uri("subj", "subj_kind").alias("uri"), typed_value("obj", "dtype")["vt"].alias("vt"))
    return t.groupBy("uri").agg(F.count_distinct("vt").alias("n_types"))


@_query(f"WITH {triples_sql('lineitem', 'orders')} SELECT DISTINCT {_SUBJ} AS src, {_LOCAL.format('pred')} AS type, {_OBJ} AS dst FROM triples WHERE pred <> '{RDF_TYPE}'")
def edges_merge(spark, sf):
    """Relationships are distinct by both ends and type."""
    return fold.fold(triples(spark, sf, "lineitem", "orders"), config()).edges


@_query(_LABELS.format(triples_sql("region", "nation")) + " SELECT uri, string_agg(label, ',' ORDER BY label) AS labels FROM pairs GROUP BY uri")
def match_nodes(spark, sf):
    g = fold.fold(triples(spark, sf, "region", "nation"), config())
    return match.nodes(g).select("uri", F.array_join("labels", ",").alias("labels"))


@_query(f"WITH {triples_sql('nation', 'supplier')} SELECT DISTINCT subj AS src, {_LOCAL.format('pred')} AS type, obj AS dst FROM triples WHERE obj_kind = 'iri' AND pred <> '{RDF_TYPE}'")
def match_edges(spark, sf):
    return match.edges(fold.fold(triples(spark, sf, "nation", "supplier"), config()))


@_query(f"WITH {triples_sql('events')}, {_arrays_sql(_LISTED)} SELECT uri, count(*) AS n FROM firsts GROUP BY uri HAVING count(*) > 3")
def match_size(spark, sf):
    g = fold.fold(triples(spark, sf, "events"), config(multival_strategy=MultivalStrategy.ARRAY))
    return match.longer_than(g, "lastEvent", 3).select("uri", F.size("vals").cast("long").alias("n"))


@_query(f"WITH {triples_sql('conversations', 'nation')} SELECT uri FROM ({_NODES}) WHERE uri LIKE 'bnode://%'")
def match_prefix(spark, sf):
    return match.by_prefix(fold.fold(triples(spark, sf, "conversations", "nation"), config()), "bnode://")


@_query(_LABELS.format(triples_sql("customer")) + f" SELECT uri, string_agg(label, ',' ORDER BY label) AS labels FROM pairs WHERE uri = '{EX}customer/7' GROUP BY uri")
def match_uri(spark, sf):
    g = fold.fold(triples(spark, sf, "customer"), config())
    return match.by_uri(g, EX + "customer/7").select("uri", F.array_join("labels", ",").alias("labels"))


@_query(
    f"WITH {triples_sql('customer', 'nation')}, names AS (SELECT subj AS uri, arg_max(obj, {_ORDER}) AS name FROM triples WHERE pred = '{VOC}name' GROUP BY 1) "
    f"SELECT DISTINCT t.subj AS src, t.obj AS dst, a.name AS src_name, b.name AS dst_name FROM triples t LEFT JOIN names a ON a.uri = t.subj LEFT JOIN names b ON b.uri = t.obj WHERE t.pred = '{VOC}inNation'"
)
def match_hop(spark, sf):
    """A typed hop with a property of both ends."""
    return match.hop_values(fold.fold(triples(spark, sf, "customer", "nation"), config()), "inNation", ["name"], ["name"])


@_query(f"WITH {triples_sql('customer')} SELECT DISTINCT subj AS uri FROM triples WHERE {_IS_LABEL} AND {_LOCAL.format('obj')} = 'BUILDING'")
def match_label(spark, sf):
    return match.by_label(fold.fold(triples(spark, sf, "customer"), config()), "BUILDING")


@_query(f"WITH {triples_sql('customer', 'nation')} SELECT a.subj AS c, a.obj AS n, b.obj AS r FROM triples a JOIN triples b ON a.obj = b.subj WHERE a.pred = '{VOC}inNation' AND b.pred = '{VOC}inRegion'")
def bgp_two_hop(spark, sf):
    """Two patterns joined on a shared variable."""
    t = triples(spark, sf, "customer", "nation")
    return match.join_patterns(match.pattern(t, "?c", VOC + "inNation", "?n"), match.pattern(t, "?n", VOC + "inRegion", "?r")).select("c", "n", "r")


@_query(f"WITH {triples_sql('customer')} SELECT subj AS s, pred AS p, obj AS o FROM triples WHERE pred <> '{RDF_TYPE}' AND (obj_kind = 'literal' OR obj = '{EX}nation#3')")
def bgp_filter(spark, sf):
    spo = match.pattern(triples(spark, sf, "customer"), "?s", "?p", "?o")
    return spo.filter((F.col("p") != RDF_TYPE) & ((F.col("o_kind") == "literal") | (F.col("o") == EX + "nation#3"))).select("s", "p", "o")


_HUB = EX + "nation#3"
_TOLD = f"(t.obj_kind = 'literal' OR t.pred = '{RDF_TYPE}')"


@_query(
    f"WITH {triples_sql('region', 'nation', 'supplier')} SELECT subj AS s, pred AS p, obj AS o FROM triples WHERE subj = '{_HUB}' OR obj = '{_HUB}' "
    f"UNION SELECT t.subj, t.pred, t.obj FROM triples x JOIN triples t ON t.subj = x.obj WHERE x.subj = '{_HUB}' AND x.pred <> '{RDF_TYPE}' AND {_TOLD} "
    f"UNION SELECT t.subj, t.pred, t.obj FROM triples x JOIN triples t ON t.subj = x.subj WHERE x.obj = '{_HUB}' AND {_TOLD}"
)
def bgp_union_construct(spark, sf):
    """Three branches around one resource, as a set of triples."""
    return match.describe(triples(spark, sf, "region", "nation", "supplier"), _HUB).select("s", "p", "o")


@_query(
    f"WITH {triples_sql('events')} SELECT {_SUBJ} AS uri, {_LOCAL.format('pred')} AS prop, arg_max(obj, (CASE WHEN ord % 2 = 0 THEN 1 ELSE 2 END, rule, ord)) AS value FROM triples WHERE obj_kind = 'literal' GROUP BY ALL"
)
def merge_incremental(spark, sf):
    """Two commits: the second one's values win."""
    t = triples(spark, sf, "events")
    store = GraphStore(spark, config(), in_memory=True).open()
    store.add_all(t.filter("ord.row % 2 = 0"))
    store.commit()
    store.add_all(t.filter("ord.row % 2 <> 0"))
    store.commit()
    return store.graph().props.select("uri", "prop", F.col("value.lex").alias("value"))


@_query(f"WITH {triples_sql('nation', 'supplier', 'orders')}, ids AS ({_NODES}) SELECT count(uri) AS n, count(DISTINCT uri) AS n_distinct FROM ids")
def uniqueness_check(spark, sf):
    ids = fold.fold(triples(spark, sf, "nation", "supplier", "orders"), config()).node_ids
    return ids.agg(F.count("uri").alias("n"), F.count_distinct("uri").alias("n_distinct"))


@_query(f"{_USED} SELECT DISTINCT iri, '{IND}' AS namespace FROM used WHERE iri LIKE '{IND}%'")
def prefix_lookup_missing(spark, sf):
    """IRIs whose namespace SHORTEN has no prefix for."""
    c = config(VocabStrategy.SHORTEN)
    c.delete_custom_prefix("ind")
    return vocab.unnamed(triples(spark, sf, "nation", "customer", "events", "collision"), c)


@_query(
    f"WITH {triples_sql('nation', 'region')} SELECT subj AS uri, max(CASE WHEN pred = '{VOC}name' THEN obj END) AS name FROM triples WHERE obj_kind = 'literal' GROUP BY 1"
)
def wide_view(spark, sf):
    """Properties as columns."""
    return match.values(fold.fold(triples(spark, sf, "nation", "region"), config()), ["name"])


def _inline(spark, sf):
    return spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")


_INLINE_SQL = (
    f"SELECT '{EX}nation#' || n_nationkey AS subj, p.pred, CASE p.k WHEN 1 THEN '{VOC}Nation' WHEN 2 THEN n_name || ' \"x\"' ELSE '{EX}region#' || n_regionkey END AS obj, CASE p.k WHEN 2 THEN 'literal' ELSE 'iri' END AS obj_kind, CASE p.k WHEN 2 THEN 'en' END AS lang "
    f"FROM nation, (VALUES (1, '{RDF_TYPE}'), (2, '{VOC}name'), (3, '{VOC}inRegion')) AS p(k, pred)"
)


@_query(_INLINE_SQL)
def ntriples_parse(spark, sf):
    """Statements of N-Triples text, one a line."""
    n = _inline(spark, sf)
    subj = F.concat(F.lit(f"<{EX}nation#"), "n_nationkey", F.lit("> "))
    text = F.array(
        F.concat(subj, F.lit(f"<{RDF_TYPE}> <{VOC}Nation> .")),
        F.concat(subj, F.lit(f'<{VOC}name> "'), "n_name", F.lit(' \\"x\\""@en .')),
        F.concat(subj, F.lit(f"<{VOC}inRegion> <{EX}region#"), "n_regionkey", F.lit("> . # end")),
    )
    rows = n.select(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.col("n_nationkey").cast("long").alias("row"), F.explode(text).alias("value"))
    return lines.parse(rows).select("subj", "pred", "obj", "obj_kind", "lang")


@_query(_INLINE_SQL)
def turtle_parse(spark, sf):
    """The same statements as Turtle documents."""
    text = F.concat(F.lit(f"@prefix v: <{VOC}> . PREFIX n: <{EX}nation#>\nn:"), "n_nationkey", F.lit(' a v:Nation ; v:name """'), "n_name", F.lit(f' "x\\""""@en ; v:inRegion <{EX}region#'), "n_regionkey", F.lit("> ."))
    return turtle.parse(_inline(spark, sf).select(F.lit("").alias("file"), text.alias("value"))).select("subj", "pred", "obj", "obj_kind", "lang")


@_query(_INLINE_SQL)
def jsonld_parse(spark, sf):
    """The same statements as JSON-LD with an inline context."""
    text = F.concat(F.lit(f'{{"@context": {{"v": "{VOC}", "name": {{"@id": "v:name", "@language": "en"}}, "in": {{"@id": "v:inRegion", "@type": "@id"}}}}, "@id": "{EX}nation#'), "n_nationkey", F.lit('", "@type": "v:Nation", "name": "'), "n_name", F.lit(f' \\"x\\"", "in": "{EX}region#'), "n_regionkey", F.lit('"}'))
    return jsonld.parse(_inline(spark, sf).select(F.lit("").alias("file"), text.alias("value"))).select("subj", "pred", "obj", "obj_kind", "lang")


@_query(_INLINE_SQL)
def rdfxml_parse(spark, sf):
    """The same statements as RDF/XML documents."""
    name = F.replace(F.replace("n_name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    text = F.concat(F.lit(f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:v="{VOC}"><v:Nation rdf:about="{EX}nation#'), "n_nationkey", F.lit('"><v:name xml:lang="en">'), name, F.lit(f' "x"</v:name><v:inRegion rdf:resource="{EX}region#'), "n_regionkey", F.lit('"/></v:Nation></rdf:RDF>'))
    return rdfxml.parse(_inline(spark, sf).select(F.lit("").alias("file"), text.alias("value"))).select("subj", "pred", "obj", "obj_kind", "lang")


_GRAPH_SQL = f"SELECT '{EX}nation#' || n_nationkey AS subj, '{VOC}inRegion' AS pred, '{EX}region#' || n_regionkey AS obj, '{EX}graph/' || n_regionkey AS graph FROM nation"


@_query(_GRAPH_SQL)
def trig_parse(spark, sf):
    """Statements in named graphs, as TriG documents."""
    text = F.concat(F.lit(f"@prefix v: <{VOC}> . <{EX}graph/"), "n_regionkey", F.lit(f"> {{ <{EX}nation#"), "n_nationkey", F.lit(f"> v:inRegion <{EX}region#"), "n_regionkey", F.lit("> . }"))
    return turtle.parse(_inline(spark, sf).select(F.lit("").alias("file"), text.alias("value"))).select("subj", "pred", "obj", "graph")


def _lines_of(spark, sf, graph: bool) -> DataFrame:
    end = [F.lit(f"> <{EX}graph/"), F.col("n_regionkey")] if graph else []
    return _inline(spark, sf).select(F.concat(F.lit(f"<{EX}nation#"), "n_nationkey", F.lit(f"> <{VOC}inRegion> <{EX}region#"), "n_regionkey", *end, F.lit("> .")).alias("value"))


@_query(_GRAPH_SQL)
def nquads_files(spark, sf):
    """N-Quads files, with the format taken from their name."""
    path = f"{_work(spark)}/nations.nq"
    _lines_of(spark, sf, True).write.text(path)
    return read_files(spark, path).select("subj", "pred", "obj", "graph")


@_query(f"SELECT 'bnode://' || n_name AS uri, count(*) OVER () AS n FROM (SELECT DISTINCT n_name FROM nation)")
def bnode_scope(spark, sf):
    """Blank nodes of one name in two files: one node, or with a scope of files two."""
    path = f"{_work(spark)}/files"
    text = _inline(spark, sf).select(F.concat(F.lit("_:"), F.regexp_replace("n_name", "[^A-Za-z0-9_]", "-"), F.lit(f" <{VOC}near> <{EX}here> .")).alias("value"))
    for k in range(2):
        text.coalesce(1).write.text(f"{path}/{k}.nt")
    shared, apart = (read_files(spark, [f"{path}/0.nt", f"{path}/1.nt"], bnode_scope=s).select(node_uri("subj", "subj_kind").alias("uri")).distinct() for s in ("none", "file"))
    names = _inline(spark, sf).select(F.concat(F.lit("bnode://"), "n_name").alias("uri"), F.concat(F.lit("bnode://"), F.regexp_replace("n_name", "[^A-Za-z0-9_]", "-")).alias("made")).distinct()
    return names.join(shared, names["made"] == shared["uri"], "left_semi").select("uri").crossJoin(F.broadcast(apart.agg((F.count(F.lit(1)) / 2).cast("long").alias("n"))))  # one row


def _work(spark) -> str:
    """A folder of the session's shared folder; a local one only if all of Spark runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/queries-{uuid.uuid4().hex}"


_TYPED_NODES = f"(SELECT subj AS uri, {_LOCAL.format('pred')} AS prop, CASE WHEN dtype IS NULL THEN 'string' ELSE 'long' END AS vt FROM triples)"


@_query(f"WITH {triples_sql('collision', 'clash')} SELECT uri, prop, CAST(count(DISTINCT vt) AS INT) AS types FROM {_TYPED_NODES} GROUP BY ALL HAVING count(DISTINCT vt) > 1")
def mixed_types(spark, sf):
    """Arrays with values of different types, which a commit would refuse."""
    return fold.fold(triples(spark, sf, "collision", "clash"), config(multival_strategy=MultivalStrategy.ARRAY)).mixed()


@_query(
    f"WITH {triples_sql('events', 'nation')}, {{0}}, held AS (SELECT subj AS uri, {_LOCAL.format('pred')} || '=' || arg_max(obj, {_ORDER}) AS p FROM triples WHERE obj_kind = 'literal' GROUP BY subj, pred) "
    f"SELECT l.uri, l.labels, coalesce(p.props, '') AS props FROM (SELECT uri, string_agg(label, ',' ORDER BY label) AS labels FROM pairs GROUP BY uri) l LEFT JOIN (SELECT uri, string_agg(p, ',' ORDER BY p) AS props FROM held GROUP BY uri) p ON l.uri = p.uri".replace("{0}", _LABELS.split(", ", 1)[1])
)
def match_nodes_props(spark, sf):
    """Every node with its labels and properties."""
    rows = match.nodes_with_props(fold.fold(triples(spark, sf, "events", "nation"), config()))
    pairs = F.array_sort(F.transform("props", lambda p: F.concat(p["prop"], F.lit("="), F.array_join(F.transform(p["vals"], lambda v: v["lex"]), "|"))))
    return rows.select("uri", F.array_join("labels", ",").alias("labels"), F.array_join(pairs, ",").alias("props"))


@_query(f"SELECT DISTINCT '{EX}nation#' || n_nationkey AS src, 'inRegion' AS type, '{EX}region#' || n_regionkey AS dst FROM nation")
def store_add(spark, sf):
    """Triples added one by one to a store of files, in batches; relationships are committed apart from nodes."""
    store = GraphStore(spark, config(batch_size=10), path=f"{_work(spark)}/store").open()
    for r in _inline(spark, sf).collect():
        store.add((f"{EX}nation#{r['n_nationkey']}", VOC + "inRegion", f"{EX}region#{r['n_regionkey']}"), context=EX + "graph")
    store.commit(commit_nodes=True)
    assert store.num_edges() == 0
    store.commit(commit_rels=True)
    return store.graph().edges


@_query(f"SELECT '{EX}region#' || r_regionkey AS uri, r_name AS name FROM region")
def store_inline(spark, sf):
    """Inline text into a store, after all that it held was deleted."""
    rows = spark.read.parquet(f"{sf}/region.parquet").collect()
    store = GraphStore(spark, config(), path=f"{_work(spark)}/store").open()
    store.parse(data=f"<{EX}gone> <{VOC}name> 'gone' .")
    store.commit()
    store.clear()
    store.parse(data=f"@prefix v: <{VOC}> .\n" + "\n".join(f"<{EX}region#{r['r_regionkey']}> v:name '{r['r_name']}' ." for r in rows))
    store.close()
    store.open(create=False)
    return store.graph().props.select("uri", F.col("value.lex").alias("name"))


@_query(f"WITH {triples_sql('events')} SELECT {_SUBJ} AS uri, {_LOCAL.format('pred')} AS prop, arg_max(obj, {_ORDER}) AS value FROM triples WHERE obj_kind = 'literal' GROUP BY ALL")
def store_compact(spark, sf):
    """Three commits as one, with what no longer matters left out."""
    t = triples(spark, sf, "events")
    store = GraphStore(spark, config(), path=f"{_work(spark)}/store").open()
    for k in range(3):
        store.add_all(t.filter(F.col("ord.row").between(k * 4000, (k + 1) * 4000 - 1) if k < 2 else F.col("ord.row") >= 8000))
        store.commit()
    store.compact()
    return store.graph().props.select("uri", "prop", F.col("value.lex").alias("value"))


_SWITCH = f"FROM triples WHERE pred = '{VOC}lastEvent'"


@_query(
    f"WITH {triples_sql('events')}, late AS (SELECT DISTINCT subj {_SWITCH} AND ord % 3 = 0), kept AS (SELECT subj, obj, min((CASE WHEN ord % 3 = 0 THEN 1 ELSE 0 END, ord)) AS first {_SWITCH} GROUP BY subj, obj) "
    f"SELECT k.subj AS uri, 'lastEvent' AS prop, k.subj NOT IN (SELECT subj FROM late) AS scalar, CASE WHEN k.subj IN (SELECT subj FROM late) THEN string_agg(obj, ',' ORDER BY first) ELSE max(l.value) END AS vals "
    f"FROM kept k JOIN (SELECT subj, arg_max(obj, ord) AS value {_SWITCH} GROUP BY subj) l ON l.subj = k.subj GROUP BY k.subj"
)
def strategy_switch(spark, sf):
    """A commit that overwrites and one that makes arrays: the last one that set a property decides, over all values."""
    t = triples(spark, sf, "events").filter(F.col("pred") == VOC + "lastEvent")
    store = GraphStore(spark, config(), in_memory=True).open()
    store.add_all(t.filter("ord.row % 3 <> 0"))
    store.commit()
    store.config.set_multival_strategy(MultivalStrategy.ARRAY)
    store.add_all(t.filter("ord.row % 3 = 0"))
    store.commit()
    return store.graph().all_props().select("uri", "prop", "scalar", _joined(F.col("vals")).alias("vals"))


@_query(f"SELECT '{EX}user/' || user_id AS uri, 'lastEvent' AS prop, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id")
def stream_events(spark, sf):
    """Events as a stream into a store, then read."""
    work = _work(spark)
    store = GraphStore(spark, config(), path=f"{work}/store").open()
    rows = spark.read.parquet(f"{sf}/events.parquet")

    def to_triples(batch: DataFrame) -> DataFrame:
        return batch.select(
            F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.col("event_id").alias("row")).alias("ord"),
            F.concat(F.lit(EX + "user/"), F.col("user_id")).alias("subj"), F.lit("iri").alias("subj_kind"), F.lit(VOC + "lastEvent").alias("pred"),
            F.col("event_type").alias("obj"), F.lit("literal").alias("obj_kind"), *(F.lit(None).cast("string").alias(c) for c in ("dtype", "lang", "graph")),
        )

    # a file source wants a folder or a pattern; a glob takes one file as well
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf}/events.parque[t]")
    into_store(stream, store, f"{work}/offsets", to_triples, "events").awaitTermination()
    return store.graph().props.select("uri", "prop", F.col("value.lex").alias("value"))

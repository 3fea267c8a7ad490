"""Triples to labels, properties and relationships.

A triple is a label (``rdf:type`` of a non-literal), a property (a literal object) or a
relationship (anything else). Named statements are kept in one flat log; a graph is an
aggregation of the log, so it doesn't matter in how many batches statements arrived.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.config import MixedTypesError, MultivalStrategy, StoreConfig
from loomgraph.functions.terms import RDF_TYPE, as_column, node_uri, typed_value
from loomgraph.functions.vocab import name_or_null

RESOURCE = "Resource"


def kind_of(pred: Column | str = "pred", obj_kind: Column | str = "obj_kind") -> Column:
    """label, prop or edge; a literal is a property whatever its predicate."""
    p, k = as_column(pred), as_column(obj_kind)
    return F.when(k == "literal", "prop").when(p == RDF_TYPE, "label").otherwise("edge")


def is_multivalued(pred: Column | str, config: StoreConfig) -> Column:
    """Whether a predicate (its full IRI) makes an array."""
    if config.multival_strategy is MultivalStrategy.OVERWRITE:
        return F.lit(False)
    return as_column(pred).isin(config.multival_props) if config.multival_props else F.lit(True)


def statements(triples: DataFrame, config: StoreConfig, seq: int = 0) -> DataFrame:
    """The log: kind, uri, name, value (struct), multi, dst, ord (with the commit's number first).

    Properties named ``uri`` are dropped: that name is the node's key.
    """
    kind = kind_of()
    named = name_or_null(F.when(kind == "label", F.col("obj")).otherwise(F.col("pred")), config)
    log = triples.select(
        kind.alias("kind"),
        node_uri("subj", "subj_kind").alias("uri"),
        named.alias("name"),
        F.when(kind == "prop", typed_value("obj", "dtype")).alias("value"),
        (kind.eqNullSafe("prop") & is_multivalued("pred", config)).alias("multi"),
        F.when(kind == "edge", node_uri("obj", "obj_kind")).alias("dst"),
        F.struct(F.lit(seq).cast("long").alias("seq"), "ord.file", "ord.block", "ord.row").alias("ord"),
    )
    return log.filter((F.col("kind") != "prop") | (F.col("name") != "uri"))


@dataclass(frozen=True)
class Graph:
    """A property graph as DataFrames.

    node_ids (uri), labels (uri, label), props (uri, prop, value), arrays (uri, prop, vals),
    edges (src, type, dst); all rows distinct, every node has the label ``Resource``.
    """

    node_ids: DataFrame
    labels: DataFrame
    props: DataFrame
    arrays: DataFrame
    edges: DataFrame

    def all_props(self) -> DataFrame:
        """Scalars and arrays alike: uri, prop, vals, scalar (boolean)."""
        one = self.props.select("uri", "prop", F.array("value").alias("vals"), F.lit(True).alias("scalar"))
        return one.unionByName(self.arrays.select("uri", "prop", "vals", F.lit(False).alias("scalar")))

    def mixed(self) -> DataFrame:
        """Arrays with values of different types: uri, prop, types (how many)."""
        types = F.array_distinct(F.transform("vals", lambda v: v["vt"]))
        return self.arrays.select("uri", "prop", F.size(types).alias("types")).filter("types > 1")

    def check_arrays(self) -> None:
        """Raise if an array has values of different types."""
        bad = self.mixed().orderBy("uri", "prop").limit(1).collect()
        if bad:
            raise MixedTypesError(*bad[0][:2])


def graph_of(log: DataFrame) -> Graph:
    """Aggregate a log.

    The last value of a scalar wins, by ``ord``. An array is the set of its values, in order
    of first arrival. Whether a property is scalar or array follows from the last commit that
    set it: an array if any statement there says so. Values are listed for arrays only, after
    they are made distinct; of a scalar's values no list is built.
    """
    said = log.filter("kind = 'prop'").withColumnRenamed("name", "prop")
    how = said.groupBy("uri", "prop").agg(F.max(F.struct("ord.seq", "multi"))["multi"].alias("multi"), F.max_by("value", "ord").alias("value"))
    some = said.filter("multi").select("uri", "prop").distinct()
    now = how.filter("multi").select("uri", "prop").join(some, ["uri", "prop"], "left_semi")
    each = said.join(now, ["uri", "prop"], "left_semi").groupBy("uri", "prop", "value").agg(F.min("ord").alias("first"))
    listed = each.groupBy("uri", "prop").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "value"))), lambda x: x["value"]).alias("vals"))
    edges = log.filter("kind = 'edge'").select(F.col("uri").alias("src"), F.col("name").alias("type"), "dst").distinct()
    ids = log.select(F.explode(F.array("uri", "dst")).alias("uri")).filter("uri IS NOT NULL").distinct()
    resource = ids.select("uri", F.lit(RESOURCE).alias("label"))
    labels = log.filter("kind = 'label'").select("uri", F.col("name").alias("label")).filter(F.col("label") != RESOURCE).distinct().unionByName(resource)
    return Graph(ids, labels, how.filter("NOT multi").select("uri", "prop", "value"), listed, edges)


def overwritten(log: DataFrame) -> DataFrame:
    """Scalars only (uri, prop, value), without building any list: for logs where nothing is an array."""
    return log.filter("kind = 'prop'").groupBy("uri", F.col("name").alias("prop")).agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("ord"))).alias("value"))


def fold(triples: DataFrame, config: StoreConfig) -> Graph:
    """A graph straight from triples. Under OVERWRITE no list of values is built."""
    log = statements(triples, config)
    graph = graph_of(log)
    if config.multival_strategy is MultivalStrategy.OVERWRITE:
        empty = graph.arrays.limit(0)
        return Graph(graph.node_ids, graph.labels, overwritten(log), empty, graph.edges)
    return graph

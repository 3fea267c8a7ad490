"""RDF triples to a queryable property graph, on Spark DataFrames."""

from loomgraph.config import MultivalStrategy, StoreConfig, VocabStrategy
from loomgraph.operators.store import GraphStore

__all__ = ["GraphStore", "MultivalStrategy", "StoreConfig", "VocabStrategy"]

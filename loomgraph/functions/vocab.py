"""Names of classes, properties and relationships, by strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.config import BadNameError, StoreConfig, UnknownNamespaceError, VocabStrategy
from loomgraph.functions.terms import RDF_TYPE, as_column, local_part_or_null, namespace_part_or_null


def _lookup(table: dict[str, str], key: Column) -> Column:
    """A configured table as a literal map: it is as large as the configuration, whatever the data."""
    if not table:
        return F.lit(None).cast("string")
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def name_or_null(iri: Column | str, config: StoreConfig) -> Column:
    """The name of an IRI, null where the strategy has none. The strategy is chosen when the plan is made."""
    c = as_column(iri)
    local = F.nullif(local_part_or_null(c), F.lit(""))
    match config.vocab_strategy:
        case VocabStrategy.KEEP:
            return c
        case VocabStrategy.IGNORE:
            return local
        case VocabStrategy.MAP:
            return F.coalesce(F.nullif(_lookup(config.custom_mappings, c), c), local)
        case VocabStrategy.SHORTEN:
            return F.concat(_lookup(config.namespaces(), namespace_part_or_null(c)), F.lit("__"), local)
    raise ValueError(f"unknown strategy {config.vocab_strategy!r}")


def used_names(triples: DataFrame) -> DataFrame:
    """Distinct IRIs (iri) that get a name: predicates, and the classes that ``rdf:type`` points to."""
    is_class = (F.col("pred") == RDF_TYPE) & (F.col("obj_kind") != "literal")
    return triples.select(F.when(is_class, F.col("obj")).otherwise(F.col("pred")).alias("iri")).distinct()


def unnamed(triples: DataFrame, config: StoreConfig) -> DataFrame:
    """Distinct IRIs (iri, namespace) in use that the strategy can't name."""
    return used_names(triples).filter(name_or_null("iri", config).isNull()).select("iri", namespace_part_or_null("iri").alias("namespace"))


def check_names(triples: DataFrame, config: StoreConfig) -> None:
    """Raise for the first IRI without a name. An action of its own: an error inside a plan can be pruned away."""
    bad = unnamed(triples, config).orderBy("iri").limit(1).collect()
    if not bad:
        return
    iri, namespace = bad[0]
    if config.vocab_strategy is VocabStrategy.SHORTEN and namespace and namespace not in config.namespaces():
        raise UnknownNamespaceError(namespace)
    raise BadNameError(iri)

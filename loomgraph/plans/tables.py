"""The driver's tables as triples: rules whose expressions both Spark and DuckDB read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.config import StoreConfig, VocabStrategy
from loomgraph.functions.terms import RDF_TYPE, XSD
from loomgraph.sources import tabular
from loomgraph.sources.tabular import Rule

EX = "http://example.org/"
VOC = EX + "voc#"
IND = EX + "ind#"


def _iri(path: str, key: str) -> str:
    return f"'{EX}{path}' || CAST({key} AS STRING)"


def _class(name: str) -> str:
    return f"'{VOC}{name}'"


_money = lambda c: f"CAST(CAST({c} AS DECIMAL(18, 2)) AS STRING)"

#: Rules by name of a group; a query takes the groups it needs.
RULES: dict[str, list[Rule]] = {
    "region": [
        Rule("region", _iri("region#", "r_regionkey"), RDF_TYPE, _class("Region"), "r_regionkey", "iri"),
        Rule("region", _iri("region#", "r_regionkey"), VOC + "name", "r_name", "r_regionkey"),
    ],
    "nation": [
        Rule("nation", _iri("nation#", "n_nationkey"), RDF_TYPE, _class("Nation"), "n_nationkey", "iri"),
        Rule("nation", _iri("nation#", "n_nationkey"), VOC + "name", "n_name", "n_nationkey"),
        Rule("nation", _iri("nation#", "n_nationkey"), VOC + "inRegion", _iri("region#", "n_regionkey"), "n_nationkey", "iri"),
    ],
    "customer": [
        Rule("customer", _iri("customer/", "c_custkey"), RDF_TYPE, _class("Customer"), "c_custkey", "iri"),
        Rule("customer", _iri("customer/", "c_custkey"), RDF_TYPE, f"'{VOC}' || c_mktsegment", "c_custkey", "iri"),
        Rule("customer", _iri("customer/", "c_custkey"), VOC + "name", "c_name", "c_custkey"),
        Rule("customer", _iri("customer/", "c_custkey"), VOC + "balance", _money("c_acctbal"), "c_custkey", dtype=XSD + "decimal"),
        Rule("customer", _iri("customer/", "c_custkey"), VOC + "inNation", _iri("nation#", "c_nationkey"), "c_custkey", "iri"),
    ],
    "supplier": [
        Rule("supplier", _iri("supplier/", "s_suppkey"), RDF_TYPE, _class("Supplier"), "s_suppkey", "iri"),
        Rule("supplier", _iri("supplier/", "s_suppkey"), VOC + "inNation", _iri("nation#", "s_nationkey"), "s_suppkey", "iri"),
    ],
    "orders": [
        Rule("orders", "'urn:order:' || CAST(o_orderkey AS STRING)", RDF_TYPE, _class("Order"), "o_orderkey", "iri"),
        Rule("orders", "'urn:order:' || CAST(o_orderkey AS STRING)", VOC + "placedBy", _iri("customer/", "o_custkey"), "o_orderkey", "iri"),
    ],
    "lineitem": [
        Rule("lineitem", "'urn:order:' || CAST(l_orderkey AS STRING)", VOC + "contains", _iri("part/", "l_partkey"), "l_orderkey", "iri"),
    ],
    "events": [
        Rule("events", _iri("user/", "user_id"), VOC + "lastEvent", "event_type", "event_id"),
        Rule("events", _iri("user/", "user_id"), VOC + "event", "event_id", "event_id", dtype=XSD + "integer"),
    ],
    "collision": [
        Rule("events", _iri("user/", "user_id"), VOC + "seen", "event_type", "event_id"),
        Rule("events", _iri("user/", "user_id"), IND + "seen", "'late-' || event_type", "event_id"),
    ],
    "clash": [
        Rule("events", _iri("user/", "user_id"), VOC + "seen", "CASE WHEN event_id % 5 = 0 THEN event_id END", "event_id", dtype=XSD + "integer"),
    ],
    "conversations": [
        Rule("conversations", "'c' || CAST(conv_id AS STRING) || '_t' || CAST(turn AS STRING)", RDF_TYPE, _class("Turn"), "conv_id * 1000 + turn", "iri", "bnode"),
        Rule("conversations", "'c' || CAST(conv_id AS STRING) || '_t' || CAST(turn AS STRING)", VOC + "role", "role", "conv_id * 1000 + turn", "literal", "bnode"),
        Rule("conversations", "'c' || CAST(conv_id AS STRING) || '_t' || CAST(turn AS STRING)", VOC + "after", "'c' || CAST(conv_id AS STRING) || '_t' || CAST(turn - 1 AS STRING)", "conv_id * 1000 + turn", "bnode", "bnode"),
    ],
    "labels": [
        Rule("labels", _iri("doc#", "doc_id"), VOC + "toxic", "CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END", "doc_id", dtype=XSD + "boolean"),
        Rule("labels", _iri("doc#", "doc_id"), VOC + "quality", "quality", "doc_id", dtype=XSD + "integer"),
    ],
}


def rules_of(*groups: str) -> list[Rule]:
    return [r for g in groups for r in RULES[g]]


def triples(spark: SparkSession, sf_dir: str, *groups: str) -> DataFrame:
    rules = rules_of(*groups)
    return tabular.triples({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in {r.table for r in rules}}, rules)


def triples_sql(*groups: str) -> str:
    """DuckDB SQL for the same triples: rule, ord, subj, subj_kind, pred, obj, obj_kind, dtype."""
    parts = [
        f"SELECT {n} AS rule, CAST({r.order} AS BIGINT) AS ord, {r.subj} AS subj, '{r.subj_kind}' AS subj_kind, '{r.pred}' AS pred, CAST({r.obj} AS VARCHAR) AS obj, '{r.obj_kind}' AS obj_kind, {f"'{r.dtype}'" if r.dtype else 'NULL'} AS dtype FROM {r.table}"
        for n, r in enumerate(rules_of(*groups))
    ]
    return f"triples AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE subj IS NOT NULL AND obj IS NOT NULL)"


def config(strategy: VocabStrategy = VocabStrategy.IGNORE, **more) -> StoreConfig:
    return StoreConfig(custom_prefixes={"voc": VOC, "ind": IND}, vocab_strategy=strategy, **more)

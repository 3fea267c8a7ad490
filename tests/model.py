"""A plain model of the store, one triple at a time, to compare with."""

from loomgraph.config import MultivalStrategy, VocabStrategy
from loomgraph.functions.terms import RDF_TYPE


def local(iri):
    for mark in "#/:":
        if mark in iri:
            return iri.rpartition(mark)[2]
    return None


def name(iri, config):
    part = local(iri)
    space = iri[: len(iri) - len(part)] if part is not None else None
    match config.vocab_strategy:
        case VocabStrategy.KEEP:
            return iri
        case VocabStrategy.IGNORE:
            return part
        case VocabStrategy.MAP:
            mapped = config.custom_mappings.get(iri, iri)
            return mapped if mapped != iri else part
        case VocabStrategy.SHORTEN:
            return f"{config.namespaces()[space]}__{part}"


def fold(triples, config):
    """triples: (subj, subj_kind, pred, obj, obj_kind) in order; gives labels, props (lists are arrays), edges."""
    labels, props, edges = {}, {}, set()
    array = config.multival_strategy is MultivalStrategy.ARRAY
    uri = lambda t, k: f"bnode://{t}" if k == "bnode" else t
    arrays = {}
    for s, sk, p, o, ok in triples:
        if ok == "literal" and array and (not config.multival_props or p in config.multival_props):
            arrays[uri(s, sk), name(p, config)] = True
    for s, sk, p, o, ok in triples:
        me = uri(s, sk)
        labels.setdefault(me, {"Resource"})
        if ok == "literal":
            key = name(p, config)
            if key == "uri":
                continue
            if arrays.get((me, key)):
                held = props.setdefault(me, {}).setdefault(key, [])
                if o not in held:
                    held.append(o)
            else:
                props.setdefault(me, {})[key] = o
        elif p == RDF_TYPE:
            labels[me].add(name(o, config))
        else:
            other = uri(o, ok)
            labels.setdefault(other, {"Resource"})
            edges.add((me, name(p, config), other))
    return labels, props, edges


def of_graph(graph):
    """The same shape from a Graph."""
    labels, props = {}, {}
    for uri, label in graph.labels.collect():
        labels.setdefault(uri, set()).add(label)
    for uri, prop, value in graph.props.collect():
        props.setdefault(uri, {})[prop] = value["lex"]
    for uri, prop, vals in graph.arrays.collect():
        props.setdefault(uri, {})[prop] = [v["lex"] for v in vals]
    assert {r[0] for r in graph.node_ids.collect()} == set(labels)
    return labels, props, {tuple(r) for r in graph.edges.collect()}

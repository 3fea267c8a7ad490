"""Configuration: prefixes, naming and multi-value strategies, and the library's errors."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from enum import Enum

# Prefixes known without configuration.
DEFAULT_PREFIXES = {
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "sch": "http://schema.org/",
    "sh": "http://www.w3.org/ns/shacl#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dct": "http://purl.org/dc/terms/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "exterms": "http://www.example.org/terms/",
    "ex": "http://www.example.org/indiv/",
}


class VocabStrategy(Enum):
    """How IRIs of classes and predicates become names."""

    SHORTEN = "SHORTEN"
    MAP = "MAP"
    KEEP = "KEEP"
    IGNORE = "IGNORE"


class MultivalStrategy(Enum):
    """What several values of one property become: the last one, or an ordered set."""

    OVERWRITE = "OVERWRITE"
    ARRAY = "ARRAY"


class GraphError(Exception):
    """Base of all errors of this library."""


class PrefixNotFoundError(GraphError):
    def __init__(self, prefix: str):
        super().__init__(f"prefix {prefix!r} isn't defined; define it before using it in a mapping or property name")
        self.prefix = prefix


class UnknownNamespaceError(GraphError):
    """SHORTEN met a namespace without a prefix."""

    def __init__(self, namespace: str):
        super().__init__(f"namespace {namespace!r} has no prefix, which SHORTEN needs")
        self.namespace = namespace


class BadNameError(GraphError):
    """An IRI can't be made into a name."""

    def __init__(self, iri: str):
        super().__init__(f"no name can be made of {iri!r}")
        self.iri = iri


class MixedTypesError(GraphError):
    def __init__(self, uri: str, prop: str):
        super().__init__(f"values of array property {prop!r} of {uri!r} must have the same datatype")
        self.uri, self.prop = uri, prop


class StoreSetupError(GraphError):
    """The store was given both, or neither, of two ways to keep its data."""


class StoreConfig:
    """Options of a store. Every instance has prefixes of its own.

    :param custom_prefixes: prefix name to namespace.
    :param custom_mappings: (prefix, local name, new name), used by MAP.
    :param multival_props: (prefix, local name) of properties that ARRAY makes arrays; none: all properties.
    :param batching, batch_size: triples added one by one leave the driver in batches of so many; DataFrames are
        worked on in partitions.
    """

    def __init__(
        self,
        custom_mappings: Iterable[tuple[str, str, str]] = (),
        custom_prefixes: Mapping[str, str] | None = None,
        batching: bool = True,
        batch_size: int = 5000,
        vocab_strategy: VocabStrategy = VocabStrategy.SHORTEN,
        multival_strategy: MultivalStrategy = MultivalStrategy.OVERWRITE,
        multival_props: Iterable[tuple[str, str]] = (),
    ):
        self.default_prefixes = dict(DEFAULT_PREFIXES)
        self.custom_prefixes = {k: str(v) for k, v in (custom_prefixes or {}).items()}
        self.batching, self.batch_size = batching, batch_size
        self.vocab_strategy, self.multival_strategy = vocab_strategy, multival_strategy
        self.custom_mappings: dict[str, str] = {}
        self.multival_props: list[str] = []
        for prefix, local, name in custom_mappings:
            self.set_custom_mapping(prefix, local, name)
        for prefix, local in multival_props:
            self.set_multival_prop(prefix, local)

    def prefixes(self) -> dict[str, str]:
        """Default prefixes overlaid by custom ones."""
        return self.default_prefixes | self.custom_prefixes

    def namespaces(self) -> dict[str, str]:
        """Namespace to prefix; of two prefixes for one namespace the later wins."""
        return {ns: prefix for prefix, ns in self.prefixes().items()}

    def iri(self, prefix: str, local: str) -> str:
        known = self.prefixes()
        if prefix not in known:
            raise PrefixNotFoundError(prefix)
        return known[prefix] + local

    def set_vocab_strategy(self, value: VocabStrategy) -> None:
        self.vocab_strategy = value

    def set_multival_strategy(self, value: MultivalStrategy) -> None:
        self.multival_strategy = value

    def set_default_prefix(self, name: str, namespace: str) -> None:
        self.default_prefixes[name] = str(namespace)

    def set_custom_prefix(self, name: str, namespace: str) -> None:
        if str(namespace) in self.custom_prefixes.values():
            raise GraphError(f"namespace {namespace!r} already has a custom prefix")
        self.custom_prefixes[name] = str(namespace)

    def delete_custom_prefix(self, name: str) -> None:
        self.custom_prefixes.pop(name, None)

    def set_multival_prop(self, prefix: str, local: str) -> None:
        if (iri := self.iri(prefix, local)) not in self.multival_props:
            self.multival_props.append(iri)

    def set_custom_mapping(self, prefix: str, local: str, name: str) -> None:
        self.custom_mappings[self.iri(prefix, local)] = name

    def delete_custom_mapping(self, prefix: str, local: str) -> None:
        self.custom_mappings.pop(self.iri(prefix, local), None)

    def set_batching(self, value: bool) -> None:
        self.batching = value

    def set_batch_size(self, value: int) -> None:
        self.batch_size = value

    def as_dict(self) -> dict:
        return dict(vars(self))

"""The driver's tables as triples, and the registered queries."""

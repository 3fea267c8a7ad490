"""Folding triples into a graph, reading it by patterns, and keeping it."""

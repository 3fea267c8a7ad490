"""Streams of triples into a store."""

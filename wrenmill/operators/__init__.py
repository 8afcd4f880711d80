"""Relational, graph and clustering operators."""

"""Declarative data curation, semantic projection, keyed retrieval and lineage on Spark."""

__version__ = "0.1.0"

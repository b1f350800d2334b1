"""Tessera: retrieval, code-graph and corpus processing as Spark plans."""

from tessera.session import prepare

__all__ = ["prepare"]

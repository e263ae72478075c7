"""Errors are part of the contract: total failure raises, partial failure is counted."""


class GraphError(Exception):
    """Base of all errors of the engine."""


class SchemaError(GraphError):
    """A table lacks a column, or has vectors of the wrong width."""


class EmbeddingError(GraphError):
    """A provider gave no vectors, or ones of the wrong width."""


class ProviderError(GraphError):
    """A language-model provider failed on all its candidates."""


class ExtractionError(GraphError):
    """An extraction or report held nothing usable."""

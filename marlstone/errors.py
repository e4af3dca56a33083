"""One class for each thing that can go wrong."""

from __future__ import annotations


class MarlstoneError(Exception):
    """Any fault that this package reports."""


class SchemaError(MarlstoneError):
    """A fault in a model's text, with its place if known."""

    def __init__(self, message: str, line: int | None = None, col: int | None = None):
        super().__init__(message if line is None else f"{line}:{col or 0}: {message}")
        self.message, self.line, self.col = message, line, col


class ScanError(SchemaError):
    """A character or literal that isn't part of the language."""


class GrammarError(SchemaError):
    """Words in an order that the language lacks."""


class ModelError(SchemaError):
    """Declarations that contradict each other or name what isn't there."""


class QueryError(MarlstoneError):
    """A request that the model doesn't allow."""


class StoreError(MarlstoneError):
    """Rows that can't be written as asked."""


class EvolutionError(MarlstoneError):
    """A change of model that would lose data."""

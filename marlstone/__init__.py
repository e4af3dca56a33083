"""A model-driven layer for entities and measurement series on Spark."""

from .errors import EvolutionError, GrammarError, MarlstoneError, ModelError, QueryError, ScanError, SchemaError, StoreError
from .operators.series import SeriesBinding
from .schema.model import Model, load
from .session import Session, connect
from .sources.store import Binding

__all__ = [
    "Binding", "EvolutionError", "GrammarError", "MarlstoneError", "Model", "ModelError", "QueryError", "ScanError", "SchemaError", "SeriesBinding", "Session", "StoreError", "connect", "load",
]

"""The modelling language: text to a validated model."""

from .model import Entity, Field, Model, load, resolve
from .text import parse, scan

__all__ = ["Entity", "Field", "Model", "load", "parse", "resolve", "scan"]

"""Registered queries with their SQL twins."""

from . import cube, events, files, forms, lookups, records, text  # noqa: F401  (registers)
from .registry import ORACLES, QUERIES  # noqa: F401

"""Queries over the driver's tables, with their SQL statements."""

from . import (  # noqa: F401
    aggregates, cleaning, dimensions, joins, metrics, models, places, profiling, reshape, serving, sources, temporal, windows,
)
from .registry import REGISTRY  # noqa: F401

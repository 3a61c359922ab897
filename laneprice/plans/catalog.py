"""All queries of the price engine."""

from . import queries, queries_board, queries_checks, queries_notes, queries_places, queries_points, queries_roads, queries_sources, queries_text  # noqa: F401
from .registered import ORACLES, QUERIES  # noqa: F401

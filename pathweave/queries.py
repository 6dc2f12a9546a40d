"""All core queries: importing the plans registers them."""

from __future__ import annotations

from .plans import cleaning, concept_graphs, concepts, graphs, hierarchies, pipeline, records, runs, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

"""The named queries and their SQL."""

from __future__ import annotations

from wayline.plans import areas, base, board, geometry, journeys, names, parity, relations, scalars, streams  # noqa: F401  (each registers its queries)

FLAGSHIP = "board_arrivals"
QUERIES = base.QUERIES
ORACLES = base.ORACLES

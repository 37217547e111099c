"""Imports every query module, which registers its queries."""

from quarry.plans import cleaning_and_geo, models_and_neighbours, range_joins, sql_surface, statistics, streams, tables_and_rows, trust_and_frames  # noqa: F401
from quarry.plans.registry import ORACLE, QUERIES  # noqa: F401

"""All queries of the engine."""

from . import catalog_crystal, catalog_materials, catalog_more, catalog_operators, catalog_orientations, catalog_physics, catalog_solvers, catalog_windows  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

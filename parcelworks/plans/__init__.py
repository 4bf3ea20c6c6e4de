"""Queries bound to the given tables."""

from importlib import import_module

MODULES = ["metadata", "geometry", "raster", "masks", "regions", "vectors", "jobs"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"parcelworks.plans.{name}")

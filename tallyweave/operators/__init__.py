"""Sketches and exact aggregates."""


def all_sketches() -> dict:
    """All sketches by name, registered."""
    from . import bottom_k, cardinality, frequency, heavy_hitters, quantile  # noqa: F401
    from .base import REGISTRY

    return REGISTRY

"""Imports every plan module so that the registry is complete."""

from tapeloom.plans import (  # noqa: F401
    similarity,
    breadth,
    dynamics,
    metrics,
    quality,
    patterns,
    projections,
    relational,
    sets,
    shape,
    sources,
    windows,
)

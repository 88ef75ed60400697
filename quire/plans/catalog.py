"""All registered queries of the document engine."""

from __future__ import annotations

from quire.plans import (  # noqa: F401  importing registers
    codecs,
    contents,
    expressions,
    extras,
    forms,
    geometry,
    graphs,
    layout,
    more,
    objects,
    optimize,
    raster,
    scans,
    search,
    structure,
    strings,
)
from quire.plans.registry import REGISTRY, Run


def queries() -> dict[str, Run]:
    return {name: q.run for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}

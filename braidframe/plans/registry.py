"""All queries outside the optional subpackage."""

from __future__ import annotations

from braidframe.plans import aggregates, connectors, inspection, metadata, relational, training

_MODULES = (training, relational, aggregates, metadata, inspection, connectors)

QUERIES: dict = {}
ORACLE: dict = {}
for _m in _MODULES:
    QUERIES.update(_m.QUERIES)
    ORACLE.update(_m.ORACLE)

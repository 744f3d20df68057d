"""The registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from eventloom.plans import matching, rates, scoring, signals, sources, structure, timebase

FAMILIES = (timebase, matching, rates, structure, scoring, signals, sources)
QUERIES = {k: v for m in FAMILIES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in FAMILIES for k, v in m.ORACLES.items()}

"""The query catalogue: every registered query of the core package, each with its independent oracle text."""

from __future__ import annotations

from attestia.plans import grammar, intake, journals, nested, packets, relational, scalar, stateful, statistics, streams, workflow

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (statistics, relational, scalar, nested, stateful, grammar, workflow, packets, intake, streams, journals):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

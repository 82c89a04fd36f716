"""All registered queries of the relational engine and their oracle SQL."""

from __future__ import annotations

from millrace.plans import basics, grouping, joining, storage, tpch

_PLANS = [m.P for m in (basics, grouping, joining, storage, tpch)]
QUERIES = {k: f for p in _PLANS for k, f in p.queries.items()}
ORACLES: dict[str, str] = {k: s for p in _PLANS for k, s in p.oracles.items()}

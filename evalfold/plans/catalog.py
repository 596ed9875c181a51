"""All queries of the library and their DuckDB statements, by name."""

from __future__ import annotations

from evalfold.plans import aggregation, contracts, costs, hashing, ledgers, outcomes, ranking, runs, sampling, statistics, templates  # noqa: F401
from evalfold.plans.registry import ORACLES, QUERIES  # noqa: F401
